"""Random forests and gradient boosting on binned columns, from arrays: what Spark ML defines, without a job for each level of each tree.

As in Spark ML a column is cut at up to bins - 1 thresholds of equal weight, a node takes the best of them over the
columns it draws, forests use Gini impurity, rows drawn again by Poisson counts and leaves that are merged where both say
the same class, and boosting uses variance, the log loss and means as leaves. Only the random draws are others.
"""

from __future__ import annotations

import numpy as np

#: A node of a tree, 14 bytes: feature (-1 in a leaf), number of its left child (the right one is next), threshold or value of the leaf.
NODE = np.dtype([("feature", "<i2"), ("left", "<i4"), ("value", "<f8")])
#: Cells of the histograms that are laid out at once.
CELLS = 1_000_000


def thresholds(column: np.ndarray, weight: np.ndarray, bins: int) -> np.ndarray:
    """The values at which Spark ML would cut a column of which it sees all rows."""
    value, back = np.unique(column, return_inverse=True)
    between = (value[1:] + value[:-1]) / 2
    if len(between) < bins:
        return between
    upto = np.cumsum(np.bincount(back, weight))
    middle, out, last = (upto[1:] + upto[:-1]) / 2, [], -1
    stride = upto[-1] / bins
    while True:
        # the first place, after the last one, from which the next value would lie farther from the aim than this one
        last = max(int(np.searchsorted(middle, stride * (len(out) + 1), "right")), last + 1)
        if last >= len(between):
            return between[out]
        out.append(last)


class Table:
    """Columns as numbers of bins, and the thresholds between them."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, bins: int):
        if not np.isfinite(x).all():
            raise ValueError("features must not be missing")
        bins = min(bins, len(x))
        cuts = [thresholds(c, weight, bins) for c in x.T]
        self.bins, self.many = bins, np.array([len(c) for c in cuts])
        self.cuts = np.array([np.append(c, np.full(bins - len(c), np.inf)) for c in cuts])
        self.codes = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], axis=1).astype(np.uint8 if bins <= 256 else np.int32)


def _gini(s: np.ndarray) -> np.ndarray:
    """Impurity from the weights of both classes (first axis)."""
    total = s[0] + s[1]
    return 1 - (s[0] ** 2 + s[1] ** 2) / total**2


def _variance(s: np.ndarray) -> np.ndarray:
    """Impurity from weight, sum and sum of squares."""
    return (s[2] - s[1] ** 2 / s[0]) / s[0]


def grow(table: Table, rows: np.ndarray, stats: np.ndarray, gini: bool, tries: int, most_depth: int, rng: np.random.Generator) -> list[np.ndarray]:
    """A tree as levels of NODEs; nodes that split hold their threshold. stats: what the impurity takes of each row (two class
    weights, or weight, weighted value and weighted square). Also gives each level's own sums."""
    impurity, mass = (_gini, lambda s: s[0] + s[1]) if gini else (_variance, lambda s: s[0])
    wide, bins = table.codes.shape[1], table.bins
    node, count, first, levels, sums = np.zeros(len(rows), np.int64), 1, 0, [], []
    for depth in range(most_depth + 1):
        own = np.stack([np.bincount(node, s[rows], count) for s in stats])
        level = np.zeros(count, NODE)
        level["feature"] = -1
        levels.append(level)
        sums.append(own)
        live = np.flatnonzero(np.abs(impurity(own)) >= np.finfo(float).eps) if depth < most_depth else np.empty(0, int)
        if not len(live):
            break
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        drawn = np.sort(rng.random((len(live), wide)).argpartition(tries - 1, axis=1)[:, :tries], axis=1) if tries < wide else np.tile(np.arange(wide), (len(live), 1))
        start, stop = np.searchsorted(node, live), np.searchsorted(node, live, "right")
        lot = max(1, CELLS // (tries * bins))
        gain, split = np.zeros(len(live)), np.zeros(len(live), np.int64)
        for i in range(0, len(live), lot):
            part = slice(i, min(i + lot, len(live)))
            size = stop[part] - start[part]
            here = np.repeat(np.arange(len(size)), size)
            mine = rows[np.repeat(start[part] - np.cumsum(size) + size, size) + np.arange(len(here))]
            codes = table.codes[mine[:, None], drawn[part][here]]
            cell = ((here[:, None] * tries + np.arange(tries)) * bins + codes).ravel()
            shape = (len(size), tries, bins)
            have = np.bincount(cell, minlength=np.prod(shape)).reshape(shape).cumsum(axis=2)
            left = np.stack([np.bincount(cell, np.repeat(s[mine], tries), np.prod(shape)).reshape(shape) for s in stats]).cumsum(axis=3)
            total = own[:, live[part]][:, :, None, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                share = mass(left) / mass(total)
                won = impurity(total) - share * impurity(left) - (1 - share) * impurity(total - left)
            usable = (have > 0) & (have < size[:, None, None]) & (np.arange(bins) < table.many[drawn[part]][:, :, None])
            won = np.where(usable, won, -1.0).reshape(len(size), -1)
            split[part] = won.argmax(axis=1)
            gain[part] = won[np.arange(len(size)), split[part]]
        good = gain > 0
        if not good.any():
            break
        at, j, b = live[good], split[good] // bins, split[good] % bins
        f = drawn[good, j]
        first += count
        level["feature"][at], level["value"][at], level["left"][at] = f, table.cuts[f, b], first + 2 * np.arange(len(at))
        child = np.full(count, -1)
        child[at] = 2 * np.arange(len(at))
        of_f, of_b = np.zeros(count, np.int64), np.zeros(count, np.int64)
        of_f[at], of_b[at] = f, b
        kept = child[node] >= 0
        rows, node = rows[kept], node[kept]
        node = child[node] + (table.codes[rows, of_f[node]] > of_b[node])
        count = 2 * len(at)
    return levels, sums


def forest_tree(table: Table, y: np.ndarray, w: np.ndarray, tries: int, most_depth: int, rate: float, again: bool, rng: np.random.Generator) -> np.ndarray:
    """A tree of a forest; its leaves hold the share of class 1."""
    times = rng.poisson(rate, len(y)) if again else np.ones(len(y), int) if rate >= 1 else (rng.random(len(y)) < rate).astype(int)
    rows = np.flatnonzero(times)
    if not len(rows):  # Spark's tree without rows says class 0
        rows, times = np.arange(len(y)), np.ones(len(y), int)
    levels, sums = grow(table, rows, np.stack([w * (1 - y), w * y]) * times, True, tries, most_depth, rng)
    shares = [s[1] / (s[0] + s[1]) for s in sums]
    classes = [s[1] > s[0] for s in sums]
    first = np.cumsum([0] + [len(x) for x in levels])
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        at = np.flatnonzero(level["feature"] >= 0)
        if len(at):  # two leaves that say the same class are one
            kid, under = level["left"][at] - first[k + 1], levels[k + 1]["feature"]
            level["feature"][at[(under[kid] < 0) & (under[kid + 1] < 0) & (classes[k + 1][kid] == classes[k + 1][kid + 1])]] = -1
        leaf = level["feature"] < 0
        level["value"][leaf] = shares[k][leaf]
    return np.concatenate(levels)


def vote(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The value of the leaf of each row."""
    feature, left, value = (np.ascontiguousarray(tree[c]) for c in ("feature", "left", "value"))
    at, live = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(live):
        live = live[feature[at[live]] >= 0]
        here = at[live]
        at[live] = left[here] + (x[live, feature[here]] > value[here])
    return value[at]


def boosted(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int, step: float, tries: int, most_depth: int, rate: float, bins: int, seed: int) -> list[np.ndarray]:
    """Trees whose leaves add up to half the log odds of class 1."""
    table, sign, margin, out = Table(x, w, bins), 2 * y - 1, np.zeros(len(y)), []
    for k in range(rounds):
        rng = np.random.default_rng([seed, k])
        aim = 4 * sign / (1 + np.exp(2 * sign * margin)) if k else sign
        rows = np.flatnonzero(rng.random(len(y)) < rate) if rate < 1 else np.arange(len(y))
        if not len(rows):
            continue
        levels, sums = grow(table, rows, np.stack([w, w * aim, w * aim**2]), False, tries, most_depth, rng)
        for level, s in zip(levels, sums, strict=True):
            leaf = level["feature"] < 0
            level["value"][leaf] = (step if k else 1.0) * (s[1] / s[0])[leaf]
        out.append(np.concatenate(levels))
        margin += vote(out[-1], x)
    return out

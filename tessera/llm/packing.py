"""Best-fit packing of token sequences by a configuration linear program over the histogram of lengths.

The corpus enters the program only as a histogram of at most `capacity` lengths. Columns of the program are
configurations (multisets of lengths that fit one sequence); multiplicative weights hold a price for each length and
knapsack dynamic programming prices columns, which gives a bound on the sequences too. The fractional solution is rounded down and what is left over is packed by
best fit, still in counts. The resulting plan is a few thousand runs "places r to r+k of length l go to sequences s to
s+k at offset o", and each piece finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.byte_bpe import ByteBpe, in_slices
from tessera.llm.common import cut
from tessera.llm.pretokenize import class_table, unpack_classes

_workers: dict[str, LibraryBpe] = {}


def library_classes() -> bytes:
    """Classes of code points as the tokenizer library's own regular expressions know them."""
    from tokenizers import Regex, normalizers

    def members(pattern: str, characters: str) -> set[str]:
        return set(characters).difference(normalizers.Replace(Regex(pattern), "").normalize_str(characters))

    return class_table(members)


def ranks_of(path: str) -> dict[bytes, int]:
    """Bytes and rank of each token in a byte-level tokenizer file, whose ids follow the order of its merges.

    Such files write bytes as characters: the printable ones of Latin-1 as themselves, the others from U+0100 on.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))}
    return {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte for c in token)}


class LibraryBpe(ByteBpe):
    """Matches located by the scan; each distinct one is merged by a compiled library and kept.

    Its ids are those of the `tokenizers` library for the same file: there, too, a match is merged by order of merges.
    """

    def __init__(self, path: str, classes: np.ndarray):
        import tiktoken

        ranks = ranks_of(path)
        super().__init__(ranks, classes)
        self.library = tiktoken.Encoding("matches", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})

    def _miss(self, piece: str) -> bytes:
        return self._keep(piece, self.library.encode_ordinary(piece))


def worker(path: str, packed: bytes) -> LibraryBpe:
    if path not in _workers:
        _workers[path] = LibraryBpe(path, unpack_classes(packed))
    return _workers[path]


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value for each room 0..capacity, and the index of a length to take there (-1: none)."""
    value, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(lengths[0]), capacity + 1):
        fits = np.searchsorted(lengths, room, "right")
        gain = value[room - lengths[:fits]] + prices[:fits]
        best = int(gain.argmax())
        if gain[best] > value[room - 1]:
            value[room], take[room] = gain[best], best
        else:
            value[room], take[room] = value[room - 1], -2  # as with one room less
    return value, take


def traced(take: np.ndarray, lengths: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0 and take[room] != -1:
        if take[room] == -2:
            room -= 1
        else:
            out.append(int(take[room]))
            room -= int(lengths[take[room]])
    return out


def dual_prices(lengths: np.ndarray, need: np.ndarray, capacity: int, rounds: int = 8) -> tuple[np.ndarray, float]:
    """Prices of lengths that no configuration sums to more than 1 of, and the bound need @ prices on the sequences.

    They start from the best of length / capacity with, for some limit, 1 for what leaves less room than the limit and 0
    for what is shorter (limit 0: the volume bound; half the capacity: a sequence for each larger piece). Then
    multiplicative weights: the price of a length falls with its coverage if the best configuration at these prices, found
    by knapsack, were used throughout, and rises where that leaves it short. Any prices over the knapsack's optimum are
    feasible, so each round gives a bound. They end once a run of them gains nothing, a longer one for fewer lengths, or after
    `rounds` such runs.
    """
    patience = int(np.clip(3000 // len(lengths), 16, 80))
    limits = np.append(0, np.unique(np.minimum(lengths, capacity - lengths)))[:, None]
    starts = np.where(lengths > capacity - limits, 1.0, np.where(lengths >= limits, lengths / capacity, 0.0))
    best = starts[(starts @ need).argmax()]
    most, last = float(need @ best), 0
    price = np.maximum(best, 1e-3 * lengths / capacity)
    mean = price
    for t in range(rounds * patience):
        value, take = knapsack(lengths, price, capacity)
        tried = [(price, value[capacity])]
        if t % 8 == 7:
            tried.append((mean, knapsack(lengths, mean, capacity)[0][capacity]))
        for p, top in tried:
            if need @ p > most * top * (1 + 1e-4):
                best, most, last = p / top, float(need @ p) / top, t
        if t - last > patience:
            break
        covered = np.bincount(traced(take, lengths, capacity), minlength=len(lengths)) * (float(need @ price) / value[capacity]) / need
        price = price * np.exp((1 - np.minimum(covered, 4)) * 0.5 / (1 + t) ** 0.5)
        price /= price.max()
        mean = mean + (price - mean) / (t + 1)
    return best, most


def solve_configurations(counts: np.ndarray, capacity: int, rounds: int = 400, columns: int = 48, rate: float = 2.0) -> tuple[dict[tuple[int, ...], tuple[float, float]], float]:
    """A fractional solution of the configuration program and a bound below: for each multiset of lengths how often to use
    it, and the tolerance at which it came in.

    Covering starts from the dual prices above. Every use of a column lowers the weights of its lengths by the factor
    exp(-rate * share covered), and prices follow the weights; each round prices by knapsack and takes the best columns
    through the lengths that are covered least, as far as no length is covered more than needed. Columns are taken whose
    dual prices lack no more than a tolerance to 1; it grows only where no other is left, so any configuration may be one,
    and all pieces are covered at the end.
    """
    lengths = np.flatnonzero(counts[:capacity])
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return {}, 0.0
    need = counts[lengths].astype(float)
    duals, bound = dual_prices(lengths, need, capacity)
    left, solution, loose = need.copy(), {}, 0.0005
    for _ in range(rounds):
        open_ = np.flatnonzero(left > 1e-9 * need)
        if not len(open_):
            break
        sizes = lengths[open_]
        weight = np.exp(rate * (left[open_] / need[open_] - 1))
        prices = (duals[open_] + 1e-6 * sizes / capacity) * (1 + 0.002 * weight)
        value, take = knapsack(sizes, prices, capacity)
        through = prices + value[capacity - sizes]
        step_any = False
        for first in np.lexsort((-through, -np.round(weight, 3)))[:columns]:
            config = [int(first), *traced(take, sizes, capacity - int(sizes[first]))]
            if duals[open_[config]].sum() < 1 - loose:
                continue
            kinds, times = np.unique(open_[config], return_counts=True)
            step = float((left[kinds] / times).min())
            if step > 0:
                left[kinds] = np.maximum(left[kinds] - step * times, 0)
                key = tuple(sorted((int(lengths[open_[i]]) for i in config), reverse=True))
                old = solution.get(key, (0.0, loose))
                solution[key] = (old[0] + step, old[1])
                step_any = True
        if not step_any:  # only then may columns be worse
            loose = min(2 * loose, 1.0)
    return solution, bound


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing in counts: bins of one content are one entry (content, how many)."""
    bins: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]  # by room left
    for length in np.flatnonzero(counts)[::-1].tolist():
        n, room = int(counts[length]), length
        while n:
            while room <= capacity and not bins[room]:
                room += 1
            if room > capacity:
                most = capacity // length
                full, rest = divmod(n, most)
                for times, k in ((most, full), (rest, 1)):
                    if times and k:
                        bins[capacity - times * length].append(((length,) * times, k))
                break
            content, have = bins[room].pop()
            used = min(n, have)
            if have > used:
                bins[room].append((content, have - used))
            bins[room - length].append(((*content, length), used))
            n -= used
            room = min(room, max(room - length, length)) if room - length >= length else room
    return [x for row in bins for x in row]


#: Parts of the fractional solution that are rounded, and tolerances up to which its columns are used; best fit packs the
#: rest, and the fewest sequences win.
PARTS, TOLERANCES = (1.0, 0.9, 0.7, 0.5, 0.0), (0.0005, 0.001, 0.002, 0.004, 0.016, 1.0)


def rounded(solution: dict[tuple[int, ...], tuple[float, float]], need: np.ndarray, capacity: int, part: float, loose: float) -> list[tuple[tuple[int, ...], int]]:
    """Use the columns that came in at tolerance `loose` or less `part` of their times, rounded down, and pack what is left by best fit."""
    left, contents = need.copy(), []
    for config, (times, at) in solution.items():
        kinds, each = np.unique(config, return_counts=True)
        if at <= loose and (k := int(min(np.floor(part * times + 1e-6), (left[kinds] // each).min()))):
            contents.append((config, k))
            left[kinds] -= k * each
    return contents + best_fit(left, capacity)


def plan(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Runs that place every piece: rows (length, first rank, how many, first sequence, offset), sorted by length and rank."""
    need = counts.astype(np.int64)
    need[0] = 0
    whole = [((capacity,), int(need[capacity]))] if need[capacity] else []
    need[capacity] = 0
    solution, bound = solve_configurations(need, capacity)
    packed, fewest = [], np.inf
    for part, loose in product(PARTS, TOLERANCES):
        if fewest <= np.ceil(bound - 1e-6):  # no packing has fewer
            break
        tried = rounded(solution, need, capacity, part, loose)
        if (n := sum(k for _, k in tried)) < fewest:
            packed, fewest = tried, n
    contents = whole + packed
    rank, sequence, runs = np.zeros(capacity + 1, np.int64), 0, []
    for content, k in contents:
        offset = 0
        for length in content:
            runs.append((length, rank[length], k, sequence, offset))
            rank[length] += k
            offset += length
        sequence += k
    out = np.array(runs, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def _pieces(path: str, packed, capacity: int, separator: int, keep_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = worker(path, packed.value)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([separator], "<u4").tobytes()
        for batch in batches:
            for pdf in in_slices(batch):
                rows = []
                for doc, ids in zip(pdf["_id"], bpe.encode_batch([t or "" for t in pdf["_text"]]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    stops = list(range((n - 1) % capacity + 1, n + 1, capacity))
                    start = 0
                    for piece, stop in enumerate(stops):
                        part = ids[4 * start : 4 * stop]
                        length = stop - start
                        rows.append((doc, piece, start, length, zlib.crc32(part), part if keep_ids else None, task, seen[length]))
                        seen[length] += 1
                        start = stop
                names = ["_id", "piece", "start", "length", "ids_crc32", "ids", "_task", "_rank"]
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({"_id": pdf["_id"].dtype}) if len(out) else out
    return run


def _placed(runs):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length, first, _, sequence, offset = runs.value.T
        span = int(first.max(initial=0)) + 1
        keys = length * span + first
        for pdf in batches:
            rank = (pdf["_base"] + pdf["_rank"]).to_numpy()
            at = np.searchsorted(keys, pdf["length"].to_numpy() * span + np.minimum(rank, span - 1), "right") - 1
            yield pdf.drop(columns=["_base", "_rank", "_task"]).assign(sequence_id=sequence[at] + rank - first[at], offset=offset[at])

    return run


def pack_documents(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    separator: int = 0,
    keep_ids: bool = True,
) -> DataFrame:
    """Pack documents into few sequences of at most `capacity` tokens.

    A document is the ids of its whole text by the tokenizer file at `path`, without special tokens, then `separator`.
    Longer ones are cut into pieces of `capacity`, of which the first may be shorter; no other document is cut.

    Returns one row per piece: id_col, piece (from 0), start, length, ids_crc32, ids (little-endian unsigned 32-bit;
    without keep_ids the column is left out), sequence_id, offset. Places in a sequence have no gaps, from offset 0.
    A null or empty text is the separator alone. Rows that repeat an id are packed each on their own and a null id is
    kept. An empty table gives no rows; other columns are ignored, whatever their names.

    The driver sees only the histogram of lengths (`capacity` rows). Ranks come from counts of each task and length,
    so a length that a third of all pieces have makes no large task.
    """
    spark = docs.sparkSession
    packed = spark.sparkContext.broadcast(library_classes())
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    names = f"_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary"
    pieces = cut(rows.mapInPandas(_pieces(path, packed, capacity, separator, keep_ids), f"{names}, _task int, _rank long"))
    if not keep_ids:
        pieces = pieces.drop("ids")
        names = names.removesuffix(", ids binary")
    counts = pieces.groupBy("length", "_task").agg(F.count("*").alias("_n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("_n")).collect():  # at most `capacity` rows
        histogram[length] = n
    runs = spark.sparkContext.broadcast(plan(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long")).alias("_base"))
    return (
        pieces.join(base, ["length", "_task"])
        .select(*(c for c in pieces.columns if c != "length"), "length", "_base")
        .mapInPandas(_placed(runs), f"{names}, sequence_id long, offset long")
        .withColumnRenamed("_id", id_col)
    )

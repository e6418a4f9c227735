"""Near-duplicates of documents by a chosen-path similarity join over word shingles.

Equal shingle sets collapse to one representative. Independent trees branch the representatives recursively by the
token that is least under a hash function of the node's depth and tree. Small nodes are compared exhaustively by short
sketches. In a large node all members are compared with one pivot; those similar to it share its label, and only
children in which two labels meet go on, so a group of copies of any size is settled in one pass. What is still large at
the deepest level is compared exhaustively in blocks. Candidates found in any tree are joined to groups, and inside each
group links are confirmed on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.byte_bpe import in_slices
from tessera.llm.common import cut, shuffle_partitions
from tessera.operators.components import connected_components

TREES, FIRST, DEEPEST, SLOTS = 16, 2, 6, 128
#: A node or group of up to SMALL members is compared in one piece; larger ones in blocks of BLOCK.
SMALL, BLOCK = 200, 150
#: Parts into which the rows of a large group are dealt where they are joined by the group.
SALTS = 64
#: Share of equal sketch slots from which two documents are candidates: over four standard errors below the threshold.
CANDIDATE_ERRORS = 4.2

_rng = np.random.default_rng(20240601)
FUNCTIONS = max(TREES * DEEPEST, SLOTS)
FACTORS = _rng.integers(0, 2**63, FUNCTIONS, np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _rng.integers(0, 2**63, FUNCTIONS, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of `width` words.

    bytes.lower() lowers exactly A-Z and bytes.split() splits at U+0020 and U+0009..U+000D. With fewer words the whole
    sequence is the only shingle; without words the set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, words), np.uint64, len(words))
    wide = min(width, len(words))
    out = _mixed(hashes[: len(words) - wide + 1] + np.uint64(wide))
    for j in range(1, wide):
        out = _mixed(out * _MIX + hashes[j : len(words) - wide + 1 + j])
    return np.unique(out)


def least_values(sets: list[np.ndarray]) -> np.ndarray:
    """The least value of each hash function over each (non-empty) set: len(sets) x FUNCTIONS."""
    out = np.empty((len(sets), FUNCTIONS), np.uint64)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 32_768):
            size += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at:end]])[:-1]])
        buffer = np.empty_like(flat)
        for k in range(FUNCTIONS):
            np.multiply(flat, FACTORS[k], out=buffer)
            buffer += TERMS[k]
            out[at:end, k] = np.minimum.reduceat(buffer, starts)
        at = end
    return out


def _features(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = np.arange(1, TREES + 1, dtype=np.uint64) * _MIX
        for batch in batches:
            for pdf in in_slices(batch, 256):
                sets = [shingle_set(t, width) for t in pdf["_text"]]
                full = [i for i, s in enumerate(sets) if len(s)]
                out = pd.DataFrame({"_id": pdf["_id"].to_numpy(), "_n": [len(s) for s in sets]}).astype({"_id": pdf["_id"].dtype})
                out["_digest"] = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                first, deep, sketches = ([None] * len(sets) for _ in range(3))
                if full:
                    least = least_values([sets[i] for i in full])
                    path, paths = np.tile(trees, (len(full), 1)), []
                    for level in range(DEEPEST):
                        path = _mixed(path * _MIX + least[:, level * TREES : (level + 1) * TREES])
                        paths.append(path)
                    nodes = paths[FIRST - 1].astype(np.int64)
                    deeper = np.stack(paths[FIRST:], 1)
                    sketch = (_mixed(least[:, :SLOTS]) >> np.uint64(56)).astype(np.uint8)
                    for k, i in enumerate(full):
                        first[i], deep[i], sketches[i] = nodes[k], deeper[k].tobytes(), sketch[k].tobytes()
                yield out.assign(_nodes=first, _paths=deep, _sketch=sketches)

    return run


def _runs(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[list[pd.DataFrame]]:
    """Groups of equal key in sorted batches, a list of whole groups at a time; a group may span batches."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        changed = np.flatnonzero((pdf[key].to_numpy()[1:] != pdf[key].to_numpy()[:-1]).any(axis=1)) + 1
        if len(changed):
            cuts = [0, *changed.tolist()]
            yield [pdf.iloc[i:j] for i, j in zip(cuts, cuts[1:])]
        rest = pdf.iloc[changed[-1] :].reset_index(drop=True) if len(changed) else pdf
    if rest is not None and len(rest):
        yield [rest]


def spanning(n: int, rows: Callable[[int], np.ndarray], labels: np.ndarray | None = None) -> np.ndarray:
    """Components of n members: rows(i) gives the members linked to i. A member is asked only while a later one is in
    another component; members of one label are together from the start."""
    root = np.arange(n)
    if labels is not None:
        _, first, back = np.unique(labels, return_index=True, return_inverse=True)
        root = first[back]
    for i in range(n - 1):
        if (root[i + 1 :] != root[i]).any():
            linked = np.unique(root[rows(i)])
            linked = linked[linked != root[i]]
            if len(linked):
                every = np.append(linked, root[i])
                root[np.isin(root, every)] = every.min()
    return root


def sketch_edges(ids: np.ndarray, sketches: np.ndarray, least: float, labels: np.ndarray | None = None) -> list[tuple]:
    """Edges that span the graph of pairs whose sketches agree in `least` of the slots or more."""
    if len(ids) == 2:
        same = labels is not None and labels[0] == labels[1]
        return [(ids[0], ids[1])] if not same and (sketches[0] == sketches[1]).mean() >= least else []
    root = spanning(len(ids), lambda i: np.flatnonzero((sketches == sketches[i]).mean(axis=1) >= least), labels)
    return [(ids[i], ids[r]) for i, r in enumerate(root) if i != r]


def _small_nodes(least: float, key: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in _runs(batches, key):
            found = []
            for g in groups:
                if len(g) > 1:
                    sketches = np.frombuffer(b"".join(g["_sketch"]), np.uint8).reshape(len(g), SLOTS)
                    found += sketch_edges(g["_id"].to_numpy(), sketches, least, g["_label"].to_numpy())
            yield pd.DataFrame(found, columns=["a", "b"])

    return run


def _with_pivot(least: float):
    """Compares each member of a large node with the pivot's sketch; gives its new label and its child node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            sketch = lambda c: np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(len(pdf), SLOTS)
            near = (sketch("_sketch") == sketch("_pivot_sketch")).mean(axis=1) >= least
            paths = np.frombuffer(b"".join(pdf["_paths"]), np.int64).reshape(len(pdf), DEEPEST - FIRST, TREES)
            level, tree = pdf["_level"].to_numpy(), pdf["_tree"].to_numpy()
            deepest = level >= DEEPEST
            child = paths[np.arange(len(pdf)), np.where(deepest, 0, level - FIRST), tree]
            yield pd.DataFrame(
                {
                    "_id": pdf["_id"],
                    "_pivot": pdf["_pivot"],
                    "_near": near,
                    "_label": np.where(near, pdf["_pivot"], pdf["_label"]),
                    "_node": np.where(deepest, pdf["_node"], child),
                    "_tree": tree,
                    "_level": np.where(deepest, level, level + 1).astype(np.int32),
                    "_deepest": deepest,
                }
            )

    return run


def _grouped(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return df.repartition(shuffle_partitions(df.sparkSession), *key).sortWithinPartitions(*key, *order)


def candidate_edges(reps: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) that span the candidate groups. reps: _id, _nodes, _paths, _sketch."""
    sketches = reps.select("_id", "_sketch")
    rows = reps.select("_id", F.posexplode("_nodes").alias("_tree", "_node")).select(
        "_id", "_tree", "_node", F.lit(FIRST).alias("_level"), F.col("_id").alias("_label")
    )
    reps, edges = reps.drop("_nodes"), []
    while True:
        nodes = cut(
            rows.groupBy("_node")
            .agg(
                F.count("*").alias("_size"),
                F.min("_label").alias("_low"),
                F.max("_label").alias("_high"),
                F.min_by("_id", F.xxhash64("_id", "_level")).alias("_pivot"),
            )
            .filter(F.col("_low") != F.col("_high"))
            .select("_node", "_size", "_pivot")
        )
        live = rows.join(nodes, "_node")
        small = live.filter(F.col("_size") <= SMALL).select("_id", "_node", "_label").join(sketches.hint("merge"), "_id")
        edges.append(cut(_grouped(small, ["_node"], ["_id"]).mapInPandas(_small_nodes(least, ["_node"]), "a long, b long")))
        if not nodes.filter(F.col("_size") > SMALL).head(1):
            break
        if not edges[1:]:  # deeper levels read only what large nodes hold
            held = live.filter(F.col("_size") > SMALL).select("_id").distinct()
            reps = cut(reps.join(held.hint("merge"), "_id", "left_semi"))
            sketches = reps.select("_id", "_sketch")
        pivots = nodes.filter(F.col("_size") > SMALL).join(
            sketches.select(F.col("_id").alias("_pivot"), F.col("_sketch").alias("_pivot_sketch")), "_pivot"
        )
        large = cut(
            rows.join(cut(pivots.drop("_size")), "_node")
            .join(reps, "_id")
            .mapInPandas(
                _with_pivot(least),
                "_id long, _pivot long, _near boolean, _label long, _node long, _tree int, _level int, _deepest boolean",
            )
        )
        edges.append(large.filter("_near").select(F.col("_id").alias("a"), F.col("_pivot").alias("b")))
        last = large.filter("_deepest")
        if last.head(1):
            edges.append(_in_blocks(last.select("_id", "_node", "_label", F.col("_pivot").alias("_main")), sketches, "_node", _small_nodes(least, ["_key"])))
        rows = large.filter(~F.col("_deepest")).select("_id", "_tree", "_node", "_level", "_label")
    out = edges[0]
    for more in edges[1:]:
        out = out.union(more)
    return out.filter(F.col("a") != F.col("b"))


def _in_blocks(rows: DataFrame, content: DataFrame, group: str, compare) -> DataFrame:
    """Compare, in blocks, all members of a group whose label isn't the main one with all members of the group.

    Members under the main label are together already. rows: _id, _label, _main and the group's column; content: what
    `compare` needs of each _id. A group makes (members / BLOCK) x (members outside the main label / BLOCK) blocks.
    """
    rest = F.col("_label") != F.col("_main")
    # rows are salted and the few sizes repeated for each salt, so that the rows of one group go to many tasks
    salt = F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")
    rows = rows.withColumn("_salt", salt)
    sizes = rows.groupBy(group, "_salt").agg(F.count("*").alias("_m"), F.count_if(rest).alias("_r")).groupBy(group).agg(F.sum("_m").alias("_m"), F.sum("_r").alias("_r"))
    sizes = cut(sizes.filter("_r > 0").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    chunks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    chunk = lambda n: F.pmod(F.xxhash64("_id"), chunks(n)).cast("int")
    members = rows.join(sizes, [group, "_salt"])
    as_all = members.select("_id", "_label", group, chunk("_m").alias("_i"), F.explode(F.sequence(F.lit(0), chunks("_r") - 1)).alias("_j"))
    as_rest = members.filter(rest).select("_id", "_label", group, F.explode(F.sequence(F.lit(0), chunks("_m") - 1)).alias("_i"), chunk("_r").alias("_j"))
    dealt = as_all.union(as_rest).distinct().withColumn("_key", F.xxhash64(group, "_i", "_j")).select("_id", "_label", "_key")
    return cut(_grouped(dealt.join(content, "_id"), ["_key"], ["_id"]).mapInPandas(compare, "a long, b long"))


def confirmed_edges(sets: list[np.ndarray], ids: np.ndarray, percent: int, labels: np.ndarray | None = None) -> list[tuple]:
    """Edges that span the links of some sets: 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    values, back = np.unique(flat, return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mark = np.zeros(len(values), np.int64)

    def linked(i: int) -> np.ndarray:
        own = back[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        common = np.add.reduceat(mark[back], starts)
        mark[own] = 0
        return np.flatnonzero(100 * common >= percent * (sizes + sizes[i] - common))

    root = spanning(len(sets), linked, labels)
    return [(ids[i], ids[r]) for i, r in enumerate(root) if i != r]


def _confirm(percent: int, width: int, key: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in _runs(batches, key):
            found = []
            for g in groups:
                g = g.drop_duplicates("_id")
                if len(g) > 1:
                    labels = g["_label"].to_numpy() if "_label" in g else None
                    found += confirmed_edges([shingle_set(t, width) for t in g["_text"]], g["_id"].to_numpy(), percent, labels)
            yield pd.DataFrame(found, columns=["a", "b"])

    return run


def confirm(groups: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """(node, component) of the exact links inside each candidate group. groups: node, component; texts: _id, _text."""
    sizes = cut(groups.groupBy(F.struct("component").alias("_k")).agg(F.count("*").alias("_size")).select("_k.component", "_size"))
    members = groups.join(sizes, "component").select(F.col("node").alias("_id"), "component", "_size")
    # texts are dealt by id whatever the number of members: a broadcast would only ever fit small inputs
    held = cut(members.join(texts.hint("merge"), "_id").select("_id", "component", "_size", "_text"))
    chunks = F.ceil(F.col("_size") / BLOCK).cast("int")
    large = held.filter(F.col("_size") > SMALL)
    dealt = held.filter(F.col("_size") <= SMALL).select("_id", "_text", "component", F.lit(0).alias("_i"))
    any_large = bool(sizes.filter(F.col("_size") > SMALL).head(1))
    if any_large:
        # each block of a large group holds the group's least document too
        dealt = dealt.union(large.select("_id", "_text", "component", F.pmod(F.xxhash64("_id"), chunks).cast("int").alias("_i"))).union(
            large.filter(F.col("_id") == F.col("component")).select("_id", "_text", "component", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("_i"))
        )
    dealt = dealt.withColumn("_key", F.xxhash64("component", "_i")).select("_id", "_text", "_key")
    edges = cut(_grouped(dealt, ["_key"], ["_id"]).mapInPandas(_confirm(percent, width, ["_key"]), "a long, b long"))
    found = connected_components(edges, "a", "b")
    if not any_large:
        return found
    labels = large.select("_id", "component").join(found.withColumnsRenamed({"node": "_id", "component": "_root"}), "_id", "left")
    labels = labels.select("_id", "component", F.coalesce("_root", "_id").alias("_label"))
    mains = labels.filter(F.col("_id") == F.col("component")).select("component", F.col("_label").alias("_main"))
    labels = cut(labels.join(mains, "component"))
    if not labels.filter(F.col("_label") != F.col("_main")).head(1):
        return found
    # as a struct, the group isn't what the labels are dealt by
    labels = labels.select("_id", "_label", "_main", F.struct("component").alias("_group"))
    more = _in_blocks(labels, large.select("_id", "_text"), "_group", _confirm(percent, width, ["_key"]))
    return connected_components(edges.union(more), "a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents whose sets of `width`-word shingles are linked by Jaccard similarity >= percent / 100.

    Returns one row per input row: id_col, n_shingles, component_id (least id reachable by links, itself included), kept
    (id = component_id). Words are runs of characters outside U+0020 and U+0009..U+000D with A-Z lowered; with fewer
    than `width` words the whole sequence is one shingle. A null or empty text or one of white space has an empty set,
    n_shingles 0, and is linked with nothing. Ids are integers; rows that repeat an id are one
    node of the graph (each row is returned). A null id is linked with nothing and kept. An empty table gives no rows; other columns
    are ignored, whatever their names.

    Candidates come from TREES trees: a pair of similarity 0.8 that meets in nodes of depth d is missed by all with
    probability (1 - 0.8^d)^16: 8e-8 at depth 2 and 2e-4 at depth 4. Every candidate is confirmed on its full set, so no
    link is wrong. Shuffled are 16 short rows a document, the texts once by id, and those of candidates once by group.
    """
    least = percent / 100 - CANDIDATE_ERRORS * (percent / 100 * (1 - percent / 100) / SLOTS) ** 0.5
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    shape = "_id long, _n long, _digest binary, _nodes array<long>, _paths binary, _sketch binary"
    features = cut(rows.mapInPandas(_features(width), shape))
    usable = features.filter((F.col("_n") > 0) & F.col("_id").isNotNull())
    reps = cut(
        usable.groupBy("_digest")
        .agg(F.min("_id").alias("_id"), *(F.first(c).alias(c) for c in ("_nodes", "_paths", "_sketch")))
    )
    features = cut(features.select("_id", "_n", "_digest"))  # paths and sketches of the others aren't needed any more
    del usable
    candidates = connected_components(candidate_edges(reps.drop("_digest"), least), "a", "b")
    found = confirm(candidates, rows, percent, width)
    roots = reps.select("_id", "_digest").join(found.withColumnsRenamed({"node": "_id", "component": "_root"}), "_id", "left")
    roots = cut(roots.select("_digest", F.coalesce("_root", "_id").alias("_root")))
    component = F.when((F.col("_n") > 0) & F.col("_id").isNotNull(), F.least(F.coalesce("_root", "_id"), "_id")).otherwise(F.col("_id"))
    return (
        features.join(roots, "_digest", "left")
        .select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("_id")).alias("kept"))
    )

"""Near-duplicates of embeddings by product quantisation: inverted lists, residual codes, table look-ups, exact rerank.

A bounded sample of distinct vectors gives coarse centroids and, for their residuals, a codebook for each subspace. Every
vector is held in the list of its nearest centroid with its residual code and the exact error of that code. A query
probes the lists of its nearest centroids; the distance to a coded vector is a sum of table look-ups, and since the error
of each code is known, a candidate is dropped only if the triangle inequality rules its link out. What is left is
reranked by exact cosine in double precision. Links are counted where they are found; only edges that span the links of
a block leave it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.operators.components import connected_components

#: The coarse and product codebooks are fitted on PER_LIST distinct vectors a list, those of least hash, at most
#: PER_LIST * MOST_LISTS = 65536 of them; every vector is indexed.
PER_LIST, LIST_SIZE, MOST_LISTS, PROBES = 32, 256, 2048, 12
#: Scores of vectors against centres that are held at once.
SCORES = 2_000_000
PARTS, CODES, ROUNDS = 8, 64, 8
#: Vectors of a list and queries of a list that one block compares.
ROWS, QUERIES = 1024, 2048


def _blocks(x: np.ndarray, centres: np.ndarray) -> Iterator[np.ndarray]:
    """Scores of some rows after the other, highest for the nearest centre."""
    half, rows = 0.5 * (centres**2).sum(axis=1), max(1, SCORES // len(centres))
    for i in range(0, len(x), rows):
        yield x[i : i + rows] @ centres.T - half


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([score.argmax(axis=1) for score in _blocks(x, centres)]) if len(x) else np.empty(0, np.int64)


def _means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's k-means from k distinct rows; an empty cell keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


@dataclass
class PqIndex:
    centres: np.ndarray  # lists x width
    books: list[np.ndarray]  # for each part: codes x width of the part
    cuts: np.ndarray  # where parts begin and end

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residual codes and the distance of each vector from what its code stands for."""
        rest = x - self.centres[lists]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        error = np.zeros(len(x))
        for p, book in enumerate(self.books):
            part = rest[:, self.cuts[p] : self.cuts[p + 1]]
            codes[:, p] = _nearest(part, book)
            error += ((part - book[codes[:, p]]) ** 2).sum(axis=1)
        return codes, np.sqrt(error)

    def probes(self, x: np.ndarray, most: int) -> np.ndarray:
        """The lists to probe, nearest first; the first is the vector's own."""
        k, out = min(most, len(self.centres)), []
        for score in _blocks(x, self.centres):
            part = np.argpartition(-score, k - 1, axis=1)[:, :k]
            order = np.argsort(-np.take_along_axis(score, part, 1), axis=1, kind="stable")
            out.append(np.take_along_axis(part, order, 1))
        return np.concatenate(out) if out else np.empty((0, k), np.int64)

    def distances(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of queries to the coded vectors of list `at`, by look-ups in a table for each part."""
        rest = queries - self.centres[at]
        out = np.zeros((len(queries), len(codes)))
        for p, book in enumerate(self.books):
            part = rest[:, self.cuts[p] : self.cuts[p + 1]]
            table = (part**2).sum(axis=1)[:, None] - 2 * part @ book.T + (book**2).sum(axis=1)
            out += table[:, codes[:, p]]
        return out


def lists_of(n: int) -> int:
    return int(np.clip(-(-n // LIST_SIZE), 1, MOST_LISTS))


def fit_index(sample: np.ndarray, n: int) -> PqIndex:
    """Coarse centres, and codebooks of what is left of the sample around them: most sample rows are no centres."""
    width = sample.shape[1]
    lists = min(lists_of(n), len(sample))
    centres = _means(sample, lists, 1)
    rest = sample - centres[_nearest(sample, centres)]
    cuts = np.linspace(0, width, min(PARTS, width) + 1).astype(int)
    books = [_means(rest[:, a:b], min(CODES, len(rest)), 2 + i) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return PqIndex(centres, books, cuts)


def _unit_vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Unit vectors as bytes and a digest; both are null for vectors that link with nothing."""
    for pdf in batches:
        units, digests = [], []
        for v in pdf["_vector"]:
            unit = None
            if v is not None and len(v):
                x = np.array([np.nan if c is None else c for c in v], float)
                if np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
                    x /= top
                    unit = (x / np.sqrt(x @ x) + 0.0).tobytes()
            units.append(unit)
            digests.append(unit and hashlib.blake2b(unit, digest_size=16).digest())
        yield pd.DataFrame({"_id": pdf["_id"], "_unit": units, "_digest": digests})


def _indexed(index, probes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.frombuffer(b"".join(pdf["_unit"]), float).reshape(len(pdf), -1)
            near = index.value.probes(x, probes)
            codes, error = index.value.encode(x, near[:, 0])
            yield pdf.assign(_list=near[:, 0].astype(np.int32), _probes=list(near.astype(np.int32)), _codes=[c.tobytes() for c in codes], _error=error)

    return run


def _compared(index, least: float):
    reach = np.sqrt(2 - 2 * least) + 1e-9

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"_id": [], "_links": [], "_to": []}).astype({"_id": "int64", "_links": "int64"})
        at = int(rows["_list"].iloc[0])
        q = np.frombuffer(b"".join(queries["_unit"]), float).reshape(len(queries), -1)
        x = np.frombuffer(b"".join(rows["_unit"]), float).reshape(len(rows), -1)
        codes = np.frombuffer(b"".join(rows["_codes"]), np.uint8).reshape(len(rows), -1)
        far = (reach + rows["_error"].to_numpy()) ** 2 + 1e-9
        qid, xid = queries["_id"].to_numpy(), rows["_id"].to_numpy()
        qn, xn = queries["_size"].to_numpy(), rows["_size"].to_numpy()
        # a query that one of the rows would probe in turn is met there again, and counted from there
        again = np.array([list(p) for p in rows["_probes"]])
        found_q, found_x = np.zeros(len(q), np.int64), np.zeros(len(x), np.int64)
        label = np.arange(len(q) + len(x))
        for i in range(0, len(q), 256):
            a, b = np.nonzero(index.value.distances(q[i : i + 256], at, codes) <= far)
            for j in range(0, len(a), 1 << 16):
                aa, bb = a[j : j + (1 << 16)] + i, b[j : j + (1 << 16)]
                ok = (np.einsum("ij,ij->i", q[aa], x[bb]) >= least) & (qid[aa] != xid[bb])
                aa, bb = aa[ok], bb[ok]
                if not len(aa):
                    continue
                np.add.at(found_q, aa, xn[bb])
                once = ~(again[bb] == queries["_own"].to_numpy()[aa, None]).any(axis=1)
                np.add.at(found_x, bb[once], qn[aa[once]])
                label = _joined(label, aa, bb + len(q))
        ids = np.concatenate([qid, xid])
        links = np.concatenate([found_q, found_x])
        keep = (links > 0) | (ids != ids[label])
        return pd.DataFrame({"_id": ids[keep], "_links": links[keep], "_to": ids[label][keep]})

    return run


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least-label propagation along the edges a-b from the labels so far, until it rests."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        new = new[label] if len(new) == len(label) else new
        if (new == label).all():
            return label
        label = new


def _linked(classes: DataFrame, n: int, least: float, probes: int) -> DataFrame:
    """(_id, _links, _to): links of each class, counted block by block, and edges that span them."""
    spark = classes.sparkSession
    wanted = PER_LIST * lists_of(n)
    # by a limit on the hash, a tenth above the wanted share, so that no task gathers the sample
    place = F.pmod(F.xxhash64("_digest"), F.lit(1 << 40))
    sample = classes.select("_unit", "_id", place.alias("_place")).filter(F.col("_place") < F.lit(int(min(1.0, 1.1 * wanted / n + 100 / n) * (1 << 40)))).toPandas()
    sample = sample.sort_values(["_place", "_id"]).head(wanted)
    index = spark.sparkContext.broadcast(fit_index(np.frombuffer(b"".join(sample["_unit"]), float).reshape(len(sample), -1), n))
    shape = "_unit binary, _id long, _size long, _list int, _probes array<int>, _codes binary, _error double"
    indexed = cut(classes.select("_unit", "_id", "_size").mapInPandas(_indexed(index, probes), shape))
    asked = indexed.select("_id", "_unit", "_size", F.col("_list").alias("_own"), F.explode("_probes").alias("_list"))
    held = indexed.groupBy("_list").agg(F.count("*").alias("_n"))
    asks = asked.groupBy("_list").agg(F.count("*").alias("_m"))
    blocks = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    dealt = F.broadcast(held.join(asks, "_list").select("_list", blocks("_n", ROWS).alias("_a"), blocks("_m", QUERIES).alias("_b")))  # at most MOST_LISTS rows
    chunk = lambda c: F.pmod(F.xxhash64("_id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    key = ["_l", "_i", "_j"]
    left = asked.join(dealt, "_list").select("_id", "_unit", "_size", "_own", F.col("_list").alias("_l"), every("_a").alias("_i"), chunk("_b").alias("_j"))
    right = indexed.join(dealt, "_list").select(
        "_id", "_unit", "_size", "_probes", "_codes", "_error", "_list", F.col("_list").alias("_l"), chunk("_a").alias("_i"), every("_b").alias("_j")
    )
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # new column identities: both sides read one table
    return cut(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_compared(index, least), "_id long, _links long, _to long"))


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, probes: int = PROBES) -> DataFrame:
    """Links of vectors with cosine >= least, in double precision.

    Returns one row per input row: id_col, n_links (other vectors linked directly), component_id (least id reachable),
    kept (id = component_id). A vector that is null, empty or zero, or holds a null or non-finite component, links with
    nothing. Vectors of one direction are compared once, with their count; so repeated rows make no pairs. Vectors of
    different lengths don't link. Ids are integers; a null id links with
    nothing. An empty table gives no rows; other columns are ignored, whatever their names.

    A link is found if either vector probes the other's list (`probes` lists); none below `least` is returned. Lists that
    are larger than ROWS and queries beyond QUERIES are dealt to several blocks, so no task holds a hot list.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_vector"))
    units = cut(rows.mapInPandas(_unit_vectors, "_id long, _unit binary, _digest binary"))
    classes = cut(
        units.filter(F.col("_digest").isNotNull() & F.col("_id").isNotNull())
        .groupBy("_digest", "_unit")
        .agg(F.min("_id").alias("_id"), F.count("*").alias("_size"))
    )
    found = None
    for width, n in sorted((r["_w"], r["_m"]) for r in classes.groupBy(F.length("_unit").alias("_w")).agg(F.count("*").alias("_m")).collect()):
        if n > 1:  # vectors of different lengths never meet
            more = _linked(classes.filter(F.length("_unit") == width), n, least, probes)
            found = more if found is None else found.union(more)
    per_class = classes.select("_digest", F.col("_id").alias("_rep"), "_size")
    if found is not None:
        links = found.groupBy(F.col("_id").alias("_rep")).agg(F.sum("_links").alias("_links"))
        roots = connected_components(found.select(F.col("_id").alias("a"), F.col("_to").alias("b")), "a", "b")
        per_class = per_class.join(links, "_rep", "left").join(roots.withColumnsRenamed({"node": "_rep", "component": "_root"}), "_rep", "left")
    else:
        per_class = per_class.withColumns({"_links": F.lit(0), "_root": F.col("_rep")})
    per_class = cut(per_class.select("_digest", (F.col("_size") - 1 + F.coalesce("_links", F.lit(0))).alias("_links"), F.coalesce("_root", "_rep").alias("_root")))
    alone = F.col("_id").isNull()
    component = F.when(alone, F.col("_id")).otherwise(F.coalesce("_root", "_id"))
    return units.select("_id", "_digest").join(per_class, "_digest", "left").select(
        F.col("_id").alias(id_col),
        F.when(alone, F.lit(0)).otherwise(F.coalesce("_links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("_id")).alias("kept"),
    )

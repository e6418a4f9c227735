"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text is a bag of hashed byte trigrams plus two shares that tell repetition; latent semantic analysis of a bounded
labelled sample gives a projection. Every document is projected, compared by exact cosine products, block by block, with
all labelled vectors, and its nearest ones vote with a weight that rises with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, SHAPES, DIMENSIONS = 4096, 2, 64
#: Bound of the labelled sample, for each of the two labels. The sample and nothing else is gathered and broadcast.
PER_CLASS = 2000
NEIGHBOURS, SHARPNESS = 25, 8
BLOCK = 256


def features(text: str | None) -> np.ndarray:
    """Counts of hashed byte trigrams of the whole text, then the shares of words equal to the one before and seen before."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(BUCKETS + SHAPES, np.float32)
    if len(data) >= 3:
        b = np.frombuffer(data, np.uint8).astype(np.uint32)
        k = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
        k = ((k ^ (k >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(20)
        out[:BUCKETS] = np.bincount(k, minlength=BUCKETS)
    words = data.split()
    if words:
        out[BUCKETS] = sum(map(eq, words, words[1:])) / len(words)
        out[BUCKETS + 1] = 1 - len(set(words)) / len(words)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


@dataclass
class QualityModel:
    idf: np.ndarray
    basis: np.ndarray  # features x dimensions
    vectors: np.ndarray  # labelled, of unit length
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        weighted = counts.copy()
        np.log1p(weighted[:, :BUCKETS], out=weighted[:, :BUCKETS])
        weighted[:, :BUCKETS] *= self.idf
        weighted[:, :BUCKETS] = _unit(weighted[:, :BUCKETS])
        return weighted @ self.basis if len(self.basis) else weighted

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Share of label 1 in the vote; 0.5 without labelled vectors. A text without features hears all of them alike."""
        out = np.full(len(texts), 0.5)
        if not len(self.vectors):
            return out
        for i in range(0, len(texts), BLOCK):
            block = _unit(self.project(np.stack([features(t) for t in texts[i : i + BLOCK]])))
            cosine = block @ self.vectors.T
            k = min(NEIGHBOURS, cosine.shape[1])
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(float) ** SHARPNESS
            total = weight.sum(axis=1)
            vote = np.divide((weight * self.labels[near]).sum(axis=1), total, out=np.full(len(total), self.labels.mean()), where=total > 0)
            out[i : i + BLOCK] = np.clip(vote, 0, 1)
        return out


def held_out(id_col: str) -> Column:
    """Rows that are never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [features(t) for t in pdf["_text"]]
        where = [np.flatnonzero(r) for r in rows]
        yield pd.DataFrame(
            {
                "_id": pdf["_id"].astype(str),
                "_label": pdf["_label"],
                "_at": [w.astype("<u2").tobytes() for w in where],
                "_of": [r[w].astype("<f4").tobytes() for r, w in zip(rows, where, strict=True)],
            }
        )


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS
) -> QualityModel:
    """Learn from at most `per_class` labelled documents of each label that aren't held out, those of least hash of the id.

    Labels other than 0 and 1 are ignored; where an id has several labels the least counts. Language, source and id are
    no inputs. Of rows that repeat an id one counts, of the least text. What the driver gathers is bounded by 2 x
    per_class sparse rows.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(id_col) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_label"))
    order = (F.xxhash64("_id"), F.col("_id"))
    sample = known.filter("_label = 0").orderBy(*order).limit(per_class).union(known.filter("_label = 1").orderBy(*order).limit(per_class))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    found = (
        texts.join(F.broadcast(sample), "_id")  # at most 2 x per_class rows
        .groupBy("_id", "_label")
        .agg(F.min("_text").alias("_text"))
        .mapInPandas(_sparse, "_id string, _label int, _at binary, _of binary")
        .toPandas()
        .sort_values(["_label", "_id"])
    )
    if found["_label"].nunique() < 2:
        return QualityModel(np.ones(BUCKETS, np.float32), np.empty((0, 0), np.float32), np.empty((0, 0), np.float32), np.empty(0))
    counts = np.zeros((len(found), BUCKETS + SHAPES), np.float32)
    for i, (at, of) in enumerate(zip(found["_at"], found["_of"], strict=True)):
        counts[i, np.frombuffer(at, "<u2")] = np.frombuffer(of, "<f4")
    seen = (counts[:, :BUCKETS] > 0).sum(axis=0)
    model = QualityModel((np.log((1 + len(counts)) / (1 + seen)) + 1).astype(np.float32), np.empty((0, 0), np.float32), counts[:0], found["_label"].to_numpy(float))
    weighted = model.project(counts)
    del counts
    # truncated singular vectors by subspace iteration from a fixed start
    wide = min(DIMENSIONS + 16, len(weighted))
    basis = np.random.default_rng(7).standard_normal((BUCKETS + SHAPES, wide)).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(weighted.T @ (weighted @ basis))
    _, _, turn = np.linalg.svd(weighted @ basis, full_matrices=False)
    model.basis = np.ascontiguousarray((basis @ turn.T)[:, :DIMENSIONS])
    model.vectors = _unit(weighted @ model.basis)
    return model


def quality_score(docs: DataFrame, model: QualityModel, text_col: str = "text") -> Column:
    """A column of scores from 0 to 1, higher where label 1 is likelier. Whole texts are read; a null text is the empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score(texts.tolist()))

    return score(F.col(text_col).cast("string"))


def classify_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, per_class: int = PER_CLASS
) -> DataFrame:
    """Score every document. Returns one row per input row: id_col, held_out, score, predicted (1 if score >= threshold).

    Without labelled rows of both kinds every score is 0.5. A null or empty text gets the share of label 1 in the
    labelled sample. Rows that repeat an id or a text get one score each; a null id is not held out. An empty table gives
    no rows; other columns are ignored, whatever their names.
    """
    model = fit_quality(docs, labels, id_col, text_col, label_col, per_class)
    scored = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("held_out"), quality_score(docs, model, text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("_id", id_col)

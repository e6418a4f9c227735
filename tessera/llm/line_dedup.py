"""Line deduplication: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut


def line_hashes(text: str, min_chars: int) -> list[bytes | None]:
    """For each line of the text the 128-bit hash of its key, or None where the key is shorter than min_chars.

    bytes.strip() strips exactly U+0020 and U+0009..U+000D, and bytes.lower() lowers exactly A-Z.
    """
    out = []
    for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n"):
        key = line.strip()
        long = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars)
        out.append(hashlib.blake2b(key, digest_size=16).digest() if long else None)
    return out


def _exploded(min_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, hashes = [], []
            for doc, text in zip(pdf["_id"], pdf["_text"], strict=True):
                found = {h for h in line_hashes(text or "", min_chars) if h}
                ids += [doc] * len(found)
                hashes += found
            yield pd.DataFrame({"_hash": hashes, "_id": pd.Series(ids, dtype=pdf["_id"].dtype)})

    return run


def _reassembled(min_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, lines, dropped = [], [], []
            for text, drop in zip(pdf["_text"], pdf["_drop"], strict=True):
                text = text or ""
                parts = text.split("\n")
                if drop is not None and len(drop):
                    gone = set(map(bytes, drop))
                    stay = [p for p, h in zip(parts, line_hashes(text, min_chars), strict=True) if h not in gone]
                    text = "\n".join(stay)
                else:
                    stay = parts
                texts.append(text)
                lines.append(len(parts))
                dropped.append(len(parts) - len(stay))
            yield pdf.drop(columns="_drop").assign(_text=texts, n_lines=lines, n_dropped=dropped)

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20, carry: tuple[str, ...] = (), counts: bool = True) -> DataFrame:
    """Drop lines that many documents share.

    Texts are split at \\n. A line's key is the line without U+0020 and U+0009..U+000D at both ends and with A-Z
    lowered. A key of at least `min_chars` code points that at least `min_docs` documents hold loses all its lines,
    except in the largest id that holds it; the other lines stay, joined by \\n.

    Returns one row per input row: id_col, text_col (what stays), n_lines (before), n_dropped, and the columns in `carry`
    (one named like a result isn't carried; without `counts` n_lines and n_dropped aren't results). A null text is the
    empty text, and an empty text is one empty line. A line that repeats inside a document counts once for it. Rows that
    repeat an id are one document; each row without an id is one of its own, and a null id is never the largest one
    while another holds the key. Keys are compared by a 128-bit hash. An empty table gives no rows; other columns are
    ignored, whatever their names.

    Scale: only (hash, id) pairs and the keys over the threshold are shuffled besides one exchange of the texts by id;
    counts are combined before the exchange, so a line in a third of all documents makes no large task.
    """
    results = {id_col, text_col} | ({"n_lines", "n_dropped"} if counts else set())
    carry = tuple(c for c in carry if c not in results)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)))
    id_type = rows.schema["_id"].dataType.simpleString()
    pairs = cut(rows.select("_id", "_text").mapInPandas(_exploded(min_chars), f"_hash binary, _id {id_type}"))
    # distinct ids are counted after an exchange by hash and id, so a hash that many documents hold spreads over the tasks
    documents = F.count_distinct("_id") + F.count_if(F.col("_id").isNull())
    common = pairs.groupBy("_hash").agg(documents.alias("_n"), F.max("_id").alias("_last"))
    # written, so that the join reads two exchanges and such a hash can be split there too
    drops = (
        pairs.join(cut(common.filter(F.col("_n") >= min_docs).drop("_n")), "_hash")
        .filter(~F.col("_id").eqNullSafe(F.col("_last")))
        .groupBy(F.col("_id").alias("_of"))
        .agg(F.collect_set("_hash").alias("_drop"))
    )
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", n_lines long, n_dropped long"
    out = rows.join(drops, F.col("_id").eqNullSafe(F.col("_of")), "left").select(*rows.columns, "_drop").mapInPandas(_reassembled(min_chars), shape)
    names = {"_id": id_col, "_text": text_col} | {f"_c{i}": c for i, c in enumerate(carry)}
    return out.select(*(F.col(c).alias(names.get(c, c)) for c in out.columns if c in names or counts))

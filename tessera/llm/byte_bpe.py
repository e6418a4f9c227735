"""Byte-level BPE: vectorised pre-tokenisation, cached merging of pairs, decoding by retained offsets."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.pretokenize import class_table, split_batch, unpack_classes

#: Matches that are kept with their ids by each Python worker, and the longest that is kept (characters).
CACHE_ROWS, CACHE_CHARS = 400_000, 48
_workers: dict[str, ByteBpe] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary in a .tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def library_classes() -> bytes:
    """Classes of code points as the public BPE library's own regular expressions know them (its Unicode version)."""
    import tiktoken

    def members(pattern: str, characters: str) -> set[str]:
        bytewise = {bytes([i]): i for i in range(256)}
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=bytewise, special_tokens={})
        return set(bytes(probe.encode_ordinary(characters)).decode())

    return class_table(members)


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: merge the adjacent pair of lowest rank, the leftmost first, until none is in the vocabulary.

    A heap over a linked list of parts, so a match of n bytes takes n log n steps.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    ends = list(range(1, n + 1))  # of the part that starts at i
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or ends[i] >= n or ends[ends[i]] != end or ends[i] == end:
            continue
        gone = ends[i]
        alive[gone] = False
        ends[i] = end
        if end < n:
            before[end] = i
            if (rank := ranks.get(piece[i : ends[end]])) is not None:
                heapq.heappush(heap, (rank, i, ends[end]))
        if (p := before[i]) >= 0 and (rank := ranks.get(piece[p:end])) is not None:
            heapq.heappush(heap, (rank, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class ByteBpe:
    """Encoder and decoder of one vocabulary. Ids are held as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], classes: np.ndarray):
        self.ranks, self.classes = ranks, classes
        self.cache: dict[str, bytes] = {}
        self.ids = np.full(max(ranks.values(), default=-1) + 1, 0, np.int64)
        tokens = sorted(ranks.items(), key=lambda x: x[1])
        self.buffer = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)
        self.lengths, self.offsets = self.ids.copy(), self.ids.copy()
        place = 0
        for token, i in tokens:
            self.lengths[i], self.offsets[i] = len(token), place
            place += len(token)

    def _miss(self, piece: str) -> bytes:
        return self._keep(piece, merge_pairs(piece.encode("utf-8", "surrogatepass"), self.ranks))

    def _keep(self, piece: str, ids: list[int]) -> bytes:
        found = np.array(ids, "<u4").tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_ROWS:
                self.cache.clear()
            self.cache[piece] = found
        return found

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out = []
        for pieces in split_batch(texts, self.classes):
            known = list(map(self.cache.get, pieces))
            if None in known:
                known = [self.cache.get(p) or self._miss(p) for p in pieces]
            out.append(b"".join(known))
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for, gathered from the vocabulary by each id's offset and length."""
        numbers = np.frombuffer(ids, "<u4")
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.buffer[np.repeat(self.offsets[numbers] - (ends - lengths), lengths) + np.arange(total)].tobytes()

    def spans(self, ids: bytes) -> np.ndarray:
        """Where each id starts in the encoded text, in bytes; a last entry is the end."""
        return np.concatenate([[0], np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])])


def worker(path: str, packed: bytes) -> ByteBpe:
    """This Python worker's encoder for a vocabulary file."""
    if path not in _workers:
        _workers[path] = ByteBpe(read_ranks(path), unpack_classes(packed))
    return _workers[path]


def in_slices(pdf: pd.DataFrame, most: int = 512) -> Iterator[pd.DataFrame]:
    for i in range(0, len(pdf), most):
        yield pdf.iloc[i : i + most]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts by the vocabulary at `path` and decode the ids again.

    Returns one row per input row: id_col, ids (binary, little-endian unsigned 32-bit integers), n_tokens, decoded
    (binary). A null text is the empty text; an empty text has no ids. Each match of the split pattern is encoded on its
    own and special tokens are plain text. Whole texts of any length are encoded: a match of n bytes takes n log n
    steps. Other columns are ignored, whatever their names, and ids may be null or repeat. No row leaves its partition.
    """
    packed = docs.sparkSession.sparkContext.broadcast(library_classes())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = worker(path, packed.value)
        for batch in batches:
            for pdf in in_slices(batch):
                ids = bpe.encode_batch([t or "" for t in pdf["_text"]])
                yield pd.DataFrame({"_id": pdf["_id"].to_numpy(), "ids": ids, "n_tokens": [len(x) // 4 for x in ids], "decoded": list(map(bpe.decode, ids))})

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"_id {kind}, ids binary, n_tokens long, decoded binary").withColumnRenamed("_id", id_col)

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.byte_bpe import ByteBpe, encode_decode, library_classes, merge_pairs, read_ranks
from tessera.llm.pretokenize import COUNT, FLAT, OF_CLASS, scan, split_batch, unpack_classes

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = read_ranks(PATH)
CLASSES = unpack_classes(library_classes())
ORACLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BPE = ByteBpe(RANKS, CLASSES)
PARTS = ["'s", "'re", "'ll", "'l", "'", "don't", " ", "  ", "\n", "\t", " ", "é", "Straße", "12", "½", "!?", "漢字", "a", " the", "<|endoftext|>", "\x1c", "\U0001f600", "'ve'd''m"]


def ids(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


def test_scan_is_the_running_composition():
    rng = np.random.default_rng(1)
    f = OF_CLASS[rng.integers(0, 9, 10_007)]
    out, now = scan(f), f[0]
    for i in range(1, len(f)):
        now = FLAT[now * COUNT + f[i]]
        assert out[i] == now


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_any_text_like_the_library(texts):
    for text, got in zip(texts, BPE.encode_batch(texts), strict=True):
        assert ids(got) == ORACLE.encode_ordinary(text)
        assert BPE.decode(got) == text.encode()


def test_hard_parts_like_the_library():
    rng = random.Random(3)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(40))) for _ in range(3000)]
    for text, got, pieces in zip(texts, BPE.encode_batch(texts), split_batch(texts, CLASSES), strict=True):
        assert ids(got) == ORACLE.encode_ordinary(text), (text, pieces)
        assert "".join(pieces) == text and BPE.decode(got) == text.encode()
        assert BPE.spans(got)[-1] == len(text.encode())


def test_long_matches():
    rng = random.Random(5)
    for piece in ("a" * 20_000, "".join(rng.choices("abcdefgh", k=30_000)), " " * 9_999, "é" * 5_000):
        assert merge_pairs(piece.encode(), RANKS) == ORACLE._encode_single_piece(piece.encode())


@pytest.mark.parametrize("empty", [False, True])
def test_operator_on_odd_rows(spark, empty):
    rows = [] if empty else [(1, None, "x"), (2, "", "y"), (2, "Two  words's", None), (None, "z " * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = encode_decode(df, PATH).collect()
    assert len(got) == len(rows)
    by_text = {(r.doc_id, bytes(r.decoded)): r for r in got}
    for doc, text, _ in rows:
        r = by_text[doc, (text or "").encode()]
        assert ids(r.ids) == ORACLE.encode_ordinary(text or "") and r.n_tokens == len(r.ids) // 4


def test_query_like_the_library(spark):
    from tessera.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op3_byte_bpe"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(got)
    for r in rows:
        want = np.array(ORACLE.encode_ordinary(r.text or ""), "<u4")
        assert got[r.doc_id].n_tokens == len(want)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(want.tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.packing import LibraryBpe, best_fit, library_classes, pack_documents, plan, solve_configurations
from tessera.llm.pretokenize import unpack_classes

PATH = public_tokenizers.path("byte_bpe_50k.json")
ORACLE = Tokenizer.from_file(PATH)
ORACLE.encode_special_tokens = True
BPE = LibraryBpe(PATH, unpack_classes(library_classes()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_ids_like_the_library(texts):
    for text, got in zip(texts, BPE.encode_batch(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ORACLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_places_all_within_capacity(found):
    counts = np.zeros(65, np.int64)
    for length, n in found.items():
        counts[length] = n
    runs = plan(counts, 64)
    placed = np.bincount(runs[:, 0], runs[:, 2], minlength=65) if len(runs) else np.zeros(65)
    assert (placed == counts).all()
    used = {}
    for length, _, k, sequence, offset in runs.tolist():
        for s in range(sequence, sequence + k):
            used.setdefault(s, []).append((offset, length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(used) <= sum(k for _, k in best_fit(counts, 64))
    assert len(used) >= solve_configurations(counts, 64)[1] + counts[64] - 1e-6


def fewest(lengths, capacity):
    """The least number of sequences, over all ways to fill one after the other."""
    best = {0: (0, 0)}  # pieces placed, as bits: sequences closed and tokens in the open one, the least
    for done in range(1 << len(lengths)):
        for i, length in enumerate(lengths):
            if not done >> i & 1:
                closed, full = best[done]
                state = (closed, full + length) if full + length <= capacity else (closed + 1, length)
                best[done | 1 << i] = min(best.get(done | 1 << i, (len(lengths), 0)), state)
    closed, full = best[(1 << len(lengths)) - 1]
    return closed + (full > 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_plan_against_the_optimum(lengths):
    counts = np.bincount(lengths, minlength=21)
    runs, want = plan(counts, 20), fewest(lengths, 20)
    assert solve_configurations(counts, 20)[1] + counts[20] <= want + 1e-6
    assert want <= (runs[:, 3] + runs[:, 2]).max() <= want + 1


@pytest.mark.parametrize(
    ("found", "most"),
    [({700: 100, 900: 100, 1100: 50}, 125), ({500: 90, 600: 80, 650: 77}, 75), ({k: 3 for k in range(1025, 2048, 3)}, 1023), ({400: 100, 510: 60, 620: 200, 690: 30}, None)],
)
def test_configurations_carry_all_tokens(found, most):
    """Histograms whose configurations all leave room: the program covers them, near its own bound."""
    counts = np.zeros(2049, np.int64)
    counts[list(found)] = list(found.values())
    solution, bound = solve_configurations(counts, 2048)
    covered = np.zeros(2049)
    for config, (times, _) in solution.items():
        assert sum(config) <= 2048
        np.add.at(covered, list(config), times)
    assert covered == pytest.approx(counts)
    assert bound - 1e-6 <= sum(times for times, _ in solution.values()) <= 1.03 * bound + 1
    runs = plan(counts, 2048)
    n = (runs[:, 3] + runs[:, 2]).max()
    assert n == most or most is None and n <= 1.03 * bound + 1


def test_plan_is_near_the_volume_bound():
    counts = np.zeros(2049, np.int64)
    counts[1:2048] = np.random.default_rng(2).integers(0, 400, 2047) * np.linspace(2, 0.1, 2047) ** 2 // 1
    runs = plan(counts, 2048)
    assert (runs[:, 3] + runs[:, 2]).max() <= 1.002 * (counts * np.arange(2049)).sum() / 2048 + 2


def check_packing(rows, docs, capacity):
    texts = {d: t or "" for d, t in docs}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for doc, pieces in by_doc.items():
        ids = [*ORACLE.encode(texts[doc], add_special_tokens=False).ids, 0]
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert sum(r.length for r in pieces) == len(ids) and all(r.length == capacity for r in pieces[1:])
        for r in pieces:
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity


@pytest.mark.parametrize("capacity", [7, 2048])
def test_operator_on_odd_rows(spark, capacity):
    docs = [(1, None), (2, ""), (3, "a b c d e f g"), (4, "word " * 5000), (5, "x"), (6, "a b c d e f g"), (None, "null id")]
    df = spark.createDataFrame([(d, t, "extra") for d, t in docs], "doc_id long, text string, length string")
    rows = pack_documents(df.repartition(3), PATH, capacity=capacity).collect()
    check_packing(rows, docs, capacity)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_query(spark):
    from tessera.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op9_best_fit_packing"](spark, sf).collect()
    check_packing(rows, docs, 2048)
    assert len({r.sequence_id for r in rows}) <= 1.02 * sum(r.length for r in rows) / 2048 + 1

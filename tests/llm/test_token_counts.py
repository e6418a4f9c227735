import random

import public_tokenizers
from tokenizers import Tokenizer, models, pre_tokenizers

from tessera.llm.token_counts import UnigramCounter, count_tokens, rank_vocabulary

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(vocabulary, byte_fallback):
    unknown = min(s for _, s in vocabulary)
    t = Tokenizer(models.Unigram([*vocabulary, ("<unk>", unknown)], unk_id=len(vocabulary), byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    return t


def test_counts_like_the_library():
    vocabulary = rank_vocabulary(PATH)
    ours, theirs = UnigramCounter(vocabulary), library(vocabulary, True)
    rng = random.Random(4)
    parts = ["the", " ", "  ", "\n", "é", "漢", "Straße", "▁", "anerth", "!", "\U0001f600", "\x00", "12345", "<0x0A>", "tion", "don't"]
    texts = ["", " ", "a", "▁", " a", "x" * 5000] + ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(2000)]
    for text in texts:
        assert ours.text(text)[1] == len(theirs.encode(text).ids), repr(text)


def test_ties_and_unknown_runs_like_the_library():
    vocabulary = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("bb", -2.0), ("▁", -1.0), ("▁a", -2.0)]
    ours, theirs = UnigramCounter(vocabulary), library(vocabulary, False)
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choices("ab cd", k=rng.randrange(12)))
        assert ours.text(text)[1] == len(theirs.encode(text).ids), repr(text)


def test_operator_on_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "a b", 3), (2, "word " * 20_000, 4)], "doc_id long, text string, n_tokens int")
    theirs = library(rank_vocabulary(PATH), True)
    got = sorted((r.doc_id or 0, r.n_tokens) for r in count_tokens(df, PATH).collect())
    assert got == sorted([(1, 0), (2, 0), (0, len(theirs.encode("a b").ids)), (2, len(theirs.encode("word " * 20_000).ids))])
    assert count_tokens(df.limit(0), PATH).count() == 0


def test_query_like_the_library(spark):
    from tessera.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    theirs = library(rank_vocabulary(PATH), True)
    got = {r.doc_id: r.n_tokens for r in QUERIES["op4_token_counts"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got == {r.doc_id: len(theirs.encode(r.text or "").ids) for r in rows}

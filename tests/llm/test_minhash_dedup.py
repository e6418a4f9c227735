import random
import re

import pytest

from tessera.llm import minhash_dedup
from tessera.llm.minhash_dedup import near_duplicates
from tessera.operators.components import connected_components

SCHEMA = "doc_id long, text string, _id string, component string"


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(width, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute(docs, width, percent=80):
    ids = [d for d, _ in docs]
    sets = [shingles(t, width) for _, t in docs]
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(ids[i]), find(ids[j])))
                root[b] = a
    return {d: (len(s), find(d)) for d, s in zip(ids, sets, strict=True)}


def ran(spark, docs, width=2):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA).repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, width=width).collect()}


def corpus(rng, groups, copies, words=60, edits=5):
    vocabulary = [f"w{i}" for i in range(3000)]
    docs = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=words)
        for _ in range(rng.randrange(1, copies)):
            own = list(base)
            for _ in range(rng.randrange(edits)):
                own[rng.randrange(words)] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(own)))
    return docs


def test_like_brute_force_on_groups(spark):
    docs = corpus(random.Random(1), 40, 8)
    assert ran(spark, docs) == brute(docs, 2)


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "SMALL", 5)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    docs = corpus(random.Random(2), 8, 40, edits=9)
    assert ran(spark, docs) == brute(docs, 2)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE "), (6, "one two"), (7, "One\ttwo"), (8, "x " * 30_000), (9, "x " * 20_000), (10, "É é"), (11, "é é")]
    assert ran(spark, docs) == brute(docs, 2)
    assert ran(spark, docs, 5) == brute(docs, 5)
    assert ran(spark, []) == {}
    rows = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (5, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates(rows).collect()) == [(0, 0, True), (3, 3, True), (3, 3, True), (5, 3, False)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(40)] + [(5, 5), (None, 3)]
    root = {}
    for a, b in edges:
        if a is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in got} == root and len(got) == len(root)

import math

import numpy as np
import pytest

from tessera.llm import embedding_dedup as module
from tessera.llm.embedding_dedup import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, _id string"


def brute(rows, least=0.9):
    good = {}
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            good[i] = x / np.linalg.norm(x)
    root, links = {i: i for i, _ in rows}, dict.fromkeys((i for i, _ in rows), 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(good)
    for a in ids:
        for b in ids:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= least:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (links[i], find(i)) for i, _ in rows}


def ran(spark, rows):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(3)
    return {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(df).collect()}


@pytest.mark.parametrize("blocks", [False, True])
def test_like_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(module, "ROWS", 7)
        monkeypatch.setattr(module, "QUERIES", 11)
        monkeypatch.setattr(module, "LIST_SIZE", 40)
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(30):
        base = rng.standard_normal(32)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows), (base + 0.2 * rng.standard_normal(32)).tolist()))
    rows += [(len(rows) + i, rows[0][1]) for i in range(25)]
    assert ran(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [1.0, float("inf")]), (7, [1.0, 0.0]), (8, [2.0, 0.1]), (9, [1.0, 0.0]), (10, [1.0]), (11, [1e30, 0.0]), (12, [-0.0, 1.0])]
    assert ran(spark, rows) == brute(rows)
    assert ran(spark, []) == {}
    assert ran(spark, [(1, None)]) == {1: (0, 1)}


def test_recall_at_the_threshold(spark):
    """Pairs whose cosine lies just above the threshold, in the width of the corpus tables."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        x = rng.standard_normal(64)
        x /= np.linalg.norm(x)
        y = rng.standard_normal(64)
        y -= (y @ x) * x
        c = rng.uniform(0.902, 0.93)
        rows += [(2 * i, x.tolist()), (2 * i + 1, (c * x + math.sqrt(1 - c * c) * y / np.linalg.norm(y)).tolist())]
    got = ran(spark, rows)
    recall = sum(got[2 * i + 1][1] == 2 * i for i in range(600)) / 600
    assert recall >= 0.9, recall
    print("recall", recall)

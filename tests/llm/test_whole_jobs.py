import numpy as np

from tessera.llm import embedding_dedup as embedding
from tessera.llm.license_scan import TEMPLATES, scan_licences


def test_notices_in_long_lines_and_across_breaks(spark):
    mit = TEMPLATES["MIT"][1] + ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies'
    gpl = TEMPLATES["GPL-3.0"][1] + " as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    bsd = TEMPLATES["BSD-3-Clause"][0].replace("or without", "or\nwithout").replace("that the", "that the\n")
    inline = "some prose about many other things that we saw on the way home. Released under the MIT License."
    texts = [mit, gpl, bsd, inline, inline[::-1], "we saw the MIT campus and a license plate", ("word " * 30 + "license ") * 300 + inline]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "concat('d', doc_id, '/LICENSE') AS path", "text")
    got = {r.doc_id: r.own_licence for r in scan_licences(df).collect()}
    assert [got[i] for i in range(7)] == ["MIT", "GPL-3.0", "BSD-3-Clause", "MIT", None, None, "MIT"]


def test_recall_with_sparse_probes(spark, monkeypatch):
    """Many more lists than probes; brute force gives the links."""
    monkeypatch.setattr(embedding, "LIST_SIZE", 4)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        x, y = rng.standard_normal((2, 64))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        c = rng.uniform(0.902, 0.93)
        rows += [(2 * i, x.tolist()), (2 * i + 1, (c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y)).tolist())]
    units = np.array([v for _, v in rows], np.float32).astype(float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    links = int((np.triu(units @ units.T, 1) >= 0.9).sum())
    found = sum(r.n_links for r in embedding.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()) / 2
    print("recall", found / links, "of", links)
    assert found / links >= 0.9


def test_probes_of_vectors_that_the_index_has_not_seen():
    """391 lists, as for 100000 vectors, against 12 probes."""
    rng = np.random.default_rng(7)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    sample, x, y = unit(rng.standard_normal((16_384, 64))), unit(rng.standard_normal((2000, 64))), rng.standard_normal((2000, 64))
    c = rng.uniform(0.902, 0.93, (2000, 1))
    y = c * x + np.sqrt(1 - c * c) * unit(y - (y * x).sum(axis=1, keepdims=True) * x)
    index = embedding.fit_index(sample, 100_000)
    a, b = index.probes(x, embedding.PROBES), index.probes(y, embedding.PROBES)
    assert ((a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)).mean() >= 0.98


def test_index_with_the_most_lists(monkeypatch):
    """A table far beyond the lists: sample rows are no centres, so that codebooks tell residuals apart."""
    monkeypatch.setattr(embedding, "MOST_LISTS", 256)
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    index = embedding.fit_index(unit(rng.standard_normal((256 * embedding.PER_LIST, 64))), 10_000_000)
    assert len(index.centres) == 256 and all(np.abs(book).max() > 0.05 for book in index.books)
    x, y, c = unit(rng.standard_normal((1000, 64))), rng.standard_normal((1000, 64)), rng.uniform(0.9, 0.92, (1000, 1))
    y = c * x + np.sqrt(1 - c * c) * unit(y - (y * x).sum(axis=1, keepdims=True) * x)
    a, b = index.probes(x, embedding.PROBES), index.probes(y, embedding.PROBES)
    assert ((a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)).mean() >= 0.95
    codes, error = index.encode(x, a[:, 0])
    assert len(np.unique(codes, axis=0)) > 900 and error.max() < 1.2

from tessera.llm.license_scan import TEMPLATES, THRESHOLD, heavy_words, scan_licences, weights
from tessera.llm.url_filter import filter_urls


def test_urls_on_odd_rows(spark):
    captures = [(1, "http://a.example.com/x/y", 5), (2, "https://user@EXAMPLE.com:80/", 5), (3, None, 5), (4, "nonsense", 5), (5, "http://example.com./", 20), (6, "http://notexample.com", 5), (7, "http://b.org/de/page?q#f", 5), (8, "http://b.org/den", 5), (9, "http://example.com", None), (9, "http://example.com", 9), (None, "http://example.com", 10), (10, "http://" + "a." * 500 + "example.com/" + "p/" * 500, 3)]
    entries = [("example.com", "add", 3), ("example.com", "remove", 10), ("Example.com", "ADD", 20), ("b.org/de", "add", 1), ("b.org/de", "add", 1), ("a.example.com", "add", 5), ("a.example.com", "remove", 5), (None, "add", 1), ("x", None, 1)]
    c = spark.createDataFrame([(*r, "k") for r in captures], "page_id long, url string, fetched_at int, key string").repartition(3)
    e = spark.createDataFrame(entries, "key string, action string, at int")
    got = filter_urls(c, e).collect()
    assert len(got) == len(captures)
    assert sorted((r.page_id or 0, r.fetched_at or 0) for r in got if r.blocked) == [(1, 5), (2, 5), (5, 20), (7, 5), (9, 9), (10, 3)]
    assert {r.page_id: r.matched_key for r in got if r.blocked} == {1: "example.com", 2: "example.com", 5: "example.com", 7: "b.org/de", 9: "example.com", 10: "example.com"}
    assert {r.listed_since for r in got if r.page_id == 5} == {20}
    assert filter_urls(c.limit(0), e).count() == 0
    assert not any(r.blocked for r in filter_urls(c, e.limit(0)).collect())


def test_heavy_words_lose_no_line():
    rows, _, _ = weights(TEMPLATES)
    heavy = set(heavy_words(rows, THRESHOLD))
    for key in {k for _, k, _, _ in rows}:
        assert sum(x * x for _, k, w, x in rows if k == key and w not in heavy) < THRESHOLD**2


def test_licences_on_odd_rows(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    files = [
        (1, "r/LICENSE", mit), (2, "r/a/f.txt", "no"), (3, "r/a/b/LICENSE.md", f"x\n{apache}"), (4, "r/a/b/c/f", None), (5, "r/a/b/g", f"# {mit.upper()}"),
        (6, "other/f", ""), (7, None, "t"), (8, "top.txt", "t"), (9, "r//a//h", "the license of it"), (10, "r/copying/f", apache), (11, "r/z/COPYING", "none"), (11, "r/z/COPYING", "none"), (None, "r/q", "word " * 50_000 + "\n" + mit),
    ]
    df = spark.createDataFrame([(*r, "w") for r in files], "doc_id long, path string, text string, word string").repartition(3)
    got = {(r.doc_id, r.path): (r.licence, r.origin, r.from_dir) for r in scan_licences(df).collect()}
    assert got[1, "r/LICENSE"] == ("MIT", "own", None)
    assert got[2, "r/a/f.txt"] == ("MIT", "inherited", "r")
    assert got[3, "r/a/b/LICENSE.md"] == ("Apache-2.0", "own", None)
    assert got[4, "r/a/b/c/f"] == ("Apache-2.0", "inherited", "r/a/b")
    assert got[5, "r/a/b/g"][:2] == ("MIT", "own")
    assert got[6, "other/f"] == got[7, None] == got[8, "top.txt"] == (None, "none", None)
    assert got[9, "r/a/h"] == got[11, "r/z/COPYING"] == ("MIT", "inherited", "r")
    assert got[10, "r/copying/f"] == ("Apache-2.0", "own", None) and got[None, "r/q"] == ("MIT", "own", None)
    assert len(scan_licences(df).collect()) == len(files)
    assert scan_licences(df.limit(0)).count() == 0

import hashlib
import re

from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.line_dedup import line_dedup


def test_exact_on_odd_rows(spark):
    rows = [(5, "a b"), (3, "ab"), (4, "a\tb "), (1, None), (2, ""), (6, " "), (7, "x" * 300_000), (8, "x" * 300_000), (9, "é"), (9, "é"), (None, "é")]
    df = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id long, text string, group_size int, _best string").repartition(4)
    for fan_in in (2, 16):
        got = exact_dedup(df, fan_in=fan_in).collect()
        assert len(got) == len(rows)
        by_id = {r.doc_id: r for r in got}
        assert (by_id[5].keep_id, by_id[3].keep_id, by_id[4].keep_id, by_id[4].kept, by_id[4].group_size) == (4, 4, 4, True, 3)
        assert by_id[1].keep_id == by_id[2].keep_id == by_id[6].keep_id == 6
        assert by_id[8].keep_id == 7 and not by_id[8].kept
        assert by_id[9].group_size == 3 and by_id[None].kept
        assert by_id[5].text_sha256 == hashlib.sha256(b"ab").hexdigest()
    assert exact_dedup(df.limit(0)).count() == 0


def brute_lines(rows, least=3, chars=20):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(k, []).append(i)
    out = {}
    for i, t in rows:
        parts = (t or "").split("\n")
        stay = [x for x in parts if not (len(key(x)) >= chars and len(held[key(x)]) >= least and max(held[key(x)]) != i)]
        out[i] = ("\n".join(stay), len(parts), len(parts) - len(stay))
    return out


def test_lines_on_odd_rows(spark):
    long = "This line is long enough to count"
    rows = [(1, None), (2, ""), (3, f"{long}\nown\n{long}"), (4, f" {long.upper()}\r\n\n"), (5, f"x\n{long}\t"), (6, "short\n" * 3), (7, "short"), (8, "short"), (9, "é" * 19), (10, "é" * 19), (11, "é" * 19)]
    rows += [(20 + i, "\n".join(f"line number {j} of a long text" for j in range(2000))) for i in range(3)]
    rows += [(30 + i, "É" * 20) for i in range(3)] + [(33, "é" * 20)]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, n_lines int, _hash string").repartition(3)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup(df).collect()}
    assert got == brute_lines(rows)
    carried = line_dedup(df, carry=("_hash",)).collect()
    assert {r._hash for r in carried} == {"z"} and len(carried) == len(rows)
    assert line_dedup(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, long), (1, long), (1, long), (2, long)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in line_dedup(odd).collect()) == [(0, ""), (1, ""), (1, ""), (2, long)]

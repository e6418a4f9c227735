"""Licence scan: sparse TF-IDF cosine of lines and runs of words to licence templates, then inheritance from the nearest directory above.

DataFrame expressions only. A line or run can reach the threshold only if it holds one of a template's heavy words: the words
outside are too light together. So a text without heavy words is left after one pass over it, and no licence is lost.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, or_empty

# The sentences by which public licences ask to be named.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
THRESHOLD = 0.7
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[^/]*)?$"
WORD = "[a-z0-9]+"


# Function words, whose weight is cut to LIGHT so that no line is like a template by them alone.
FUNCTION_WORDS = set("a an and any are as at be by can for from in is it may not of on or that the this to under was were with you".split())
LIGHT = 0.25


def weights(templates: dict[str, list[str]]) -> tuple[list[tuple[str, str, str, float]], dict[str, float], float]:
    """(licence, template, word, unit TF-IDF weight) rows, the idf of each of their words and of function words, and that of all others."""
    texts = [(name, f"{name}#{i}", Counter(re.findall(WORD, t.lower()))) for name, group in sorted(templates.items()) for i, t in enumerate(group)]
    seen = Counter(w for _, _, words in texts for w in words)
    idf = {w: (math.log((1 + len(texts)) / (1 + seen[w])) + 1) * (LIGHT if w in FUNCTION_WORDS else 1) for w in sorted({*seen, *FUNCTION_WORDS})}
    rows = []
    for name, key, words in texts:
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in words.items()))
        rows += [(name, key, w, n * idf[w] / norm) for w, n in sorted(words.items())]
    return rows, idf, math.log(1 + len(texts)) + 1


def heavy_words(rows: list[tuple[str, str, str, float]], threshold: float) -> list[str]:
    """Words such that those left of each template weigh less than the threshold together; long and rare ones first."""
    heavy: set[str] = set()
    common = Counter(w for _, _, w, _ in rows)
    for key in sorted({k for _, k, _, _ in rows}):
        own = sorted(((x, w) for _, k, w, x in rows if k == key), key=lambda x: (x[1] in FUNCTION_WORDS, x[1] not in heavy, len(x[1]) < 4, -x[0], -common[x[1]], x[1]))
        left = sum(x * x for x, _ in own)
        for x, w in own:
            if left < (threshold - 1e-6) ** 2:
                break
            heavy.add(w)
            left -= x * x
    return sorted(heavy)


def alignments(templates: dict[str, list[str]], heavy: list[str]) -> dict[str, list[tuple[int, int]]]:
    """For each heavy word, (words before it, words in all) of each place where a template has it."""
    found: dict[str, set[tuple[int, int]]] = {w: set() for w in heavy}
    for text in (t for group in templates.values() for t in group):
        words = re.findall(WORD, text.lower())
        for i, w in enumerate(words):
            if w in found:
                found[w].add((i, len(words)))
    return {w: sorted(x) for w, x in found.items()}


def windows(text: Column, places: dict[str, list[tuple[int, int]]]) -> Column:
    """Distinct runs of adjacent words, as long as a template, with a heavy word where the template has it.

    Words are those of the whole text, so a notice is met inside a longer line and across line breaks.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))

    def around(w: Column) -> Column:
        at = F.filter(F.transform(w, lambda x, i: F.when(x.isin(list(places)), i)), lambda i: i.isNotNull())

        def of(i: Column) -> Column:
            own = F.get(w, i)
            runs = None
            for word, shapes in places.items():
                pairs = F.array(*(F.struct(F.lit(k).alias("before"), F.lit(n).alias("long")) for k, n in shapes))
                runs = F.when(own == word, pairs) if runs is None else runs.when(own == word, pairs)
            return F.transform(
                runs, lambda r: F.array_join(F.slice(w, F.greatest(i - r["before"], F.lit(0)) + 1, r["long"] + F.least(i - r["before"], F.lit(0))), " ")
            )

        return F.array_distinct(F.flatten(F.transform(at, of)))

    return F.get(F.transform(F.array(words), around), F.lit(0))  # the words are found once


def scan_licences(
    files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """The licence of each file: its own, or that of the licence file in the nearest directory at or above it.

    Every line of the whole text, and every run of adjacent words around a heavy word as long as a template that has the
    word (inside a line or across line breaks), is compared, in lower case and by words of [a-z0-9], with every template;
    a file's own licence is that of its best line or run with cosine >= threshold (ties: first by name). A licence file (LICENSE, COPYING or
    NOTICE, with any suffix) passes its own licence on to its directory and all below; of several in a directory the best
    score, then the least id, counts. A file with a licence of its own doesn't inherit.

    Returns one row per input row: id_col, path_col, own_licence, own_score (rounded to 6 places), licence, origin ('own',
    'inherited' or 'none'), from_dir (of an inherited one). A null text is the empty text, a null path has no directory.
    Rows that repeat are scanned each; ids may be null. An empty table gives no rows; other columns are ignored.

    The template table is fixed and the only thing broadcast. Texts aren't shuffled; directories are resolved once each.
    """
    rows, idf, other = weights(templates or TEMPLATES)
    spark = files.sparkSession
    vocabulary = F.broadcast(spark.createDataFrame(rows, "licence string, template string, word string, weight double"))
    known = F.broadcast(spark.createDataFrame(sorted(idf.items()), "word string, idf double"))
    loud = heavy_words(rows, threshold)
    places = alignments(templates or TEMPLATES, loud)
    heavy = r"(?i)(?<![a-z0-9])(?:" + "|".join(loud) + r")(?![a-z0-9])"
    text = or_empty(text_col)
    path = F.regexp_replace(F.col(path_col).cast("string"), "/+", "/")
    # a heavy word is looked for in the text before it is cut to lines
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(heavy))
    listed = F.when(text.rlike(heavy), F.concat(lines, windows(text, places))).otherwise(F.array().cast("array<string>"))
    base = cut(files.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), path.alias("_path"), listed.alias("_lines")))
    words = base.select("_row", F.posexplode("_lines").alias("_line", "_text")).select("_row", "_line", F.explode(F.expr(f"regexp_extract_all(lower(_text), '{WORD}', 0)")).alias("word"))
    counted = words.groupBy("_row", "_line", "word").agg(F.count("*").alias("_n"))
    valued = counted.join(known, "word", "left").withColumn("_x", F.col("_n") * F.coalesce("idf", F.lit(other)))
    norms = valued.groupBy("_row", "_line").agg(F.sqrt(F.sum(F.col("_x") * F.col("_x"))).alias("_norm"))
    dots = valued.join(vocabulary, "word").groupBy("_row", "_line", "licence", "template").agg(F.sum(F.col("_x") * F.col("weight")).alias("_dot"))
    scored = dots.join(norms, ["_row", "_line"]).select("_row", "licence", F.round(F.col("_dot") / F.col("_norm"), 6).alias("_score")).filter(F.col("_score") >= threshold)
    best = scored.groupBy("_row").agg(F.min(F.struct((-F.col("_score")).alias("s"), F.col("licence").alias("n"))).alias("_best"))
    folder = F.when(F.col("_path").isNull(), None).otherwise(F.regexp_replace(F.col("_path"), "/?[^/]*$", ""))
    found = cut(
        base.select("_row", "_id", "_path", folder.alias("_dir"))
        .join(best, "_row", "left")
        .select("_id", "_path", "_dir", F.col("_best.n").alias("_own"), (-F.col("_best.s")).alias("_score"))
    )
    holders = (
        found.filter(F.col("_own").isNotNull() & F.col("_path").rlike(LICENCE_FILE))
        .groupBy("_dir")
        .agg(F.min(F.struct((-F.col("_score")).alias("s"), F.col("_id").alias("i"), F.col("_own").alias("n"))).alias("_h"))
        .select(F.col("_dir").alias("_above"), F.col("_h.n").alias("_licence"))
    )
    parts = F.split("_dir", "/")
    above = F.when(F.col("_dir") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    )
    nearest = (
        found.filter(F.col("_dir").isNotNull()).select("_dir").distinct()
        .select("_dir", F.posexplode(above).alias("_depth", "_above"))
        .join(cut(holders), "_above")
        .groupBy("_dir")
        .agg(F.max(F.struct("_depth", "_above", "_licence")).alias("_near"))
    )
    inherited = F.when(F.col("_own").isNull(), F.col("_near._licence"))
    return found.join(cut(nearest), "_dir", "left").select(
        F.col("_id").alias(id_col),
        F.col("_path").alias(path_col),
        F.col("_own").alias("own_licence"),
        F.col("_score").alias("own_score"),
        F.coalesce("_own", inherited).alias("licence"),
        F.when(F.col("_own").isNotNull(), "own").when(inherited.isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(inherited.isNotNull(), F.col("_near._above")).alias("from_dir"),
    )

"""License scan: exact set-similarity join of text blocks with license templates.

A block is a line or, where a notice is wrapped, a run of adjacent lines. Block and template are sets of lower-cased
words; a pair qualifies if the block holds at least ``threshold`` of the template's words. Texts are cut into words once; the words
that any template has are written to the shared folder, all others as nulls. Words are ordered by their frequency over the lines
of the corpus, rarest first. A template's prefix is its |T| - o + 1 rarest words, o the overlap it needs: a block without any of them
cannot qualify (prefix filter). The join is by equal words: a block's words meet an index from prefix words to templates. A block has to
have o words of templates at all (length filter), and from the first common word on both sides have to have enough words left
(positional filter). What is left is verified by intersection, once a pair, at the rarest common word.

The index is made of the templates, a configuration; it is broadcast up to ``MOST_INDEXED`` rows and shuffled beyond. The frequency count
shuffles one row a template word; nothing else moves.

A run qualifies for a template if none of its lines does so alone and some stretch of its words that crosses a line end holds
enough of the template's words among at most ``SPREAD`` times as many words as the template has: words that are
scattered over a page are no notice. Of overlapping runs the one that ends first counts, of these the shortest. Only
documents that hold a prefix word are searched for runs, in Python, and for those templates only that they hold enough words of.

Defined results: null or empty texts have no blocks; an empty table or no templates give no rows. Repeated rows give repeated results.
Null ids pass through. Texts count whole whatever their length. A block that several templates reach is reported for each; ties in
frequency go by the word.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, list_of, materialize

TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "mit": "Released under the MIT License",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "lgpl-3.0": "licensed under the GNU Lesser General Public License, version 3",
    "bsd-3-clause": "Redistribution and use in source and binary forms are permitted",
    "mpl-2.0": "subject to the terms of the Mozilla Public License, version 2.0",
    "cc-by-4.0": "licensed under a Creative Commons Attribution 4.0 International License",
    "all-rights-reserved": "Copyright all rights reserved",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
THRESHOLD, SPREAD, MOST_INDEXED = 0.8, 2, 1_000_000
_WORD = r"[\p{L}\p{N}]+"


def template_words(template: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[^\W_]+", template.lower())))


def need(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def lexed(docs: DataFrame, vocabulary: list[str], least: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, lines)`` of the documents with at least ``least`` words of the vocabulary: of each line its words, null where they aren't of it."""
    known = lambda w: F.when(w.isin(*vocabulary), w)
    lines = F.transform(F.split(F.lower(col(text_col)), "\n"), lambda line: F.transform(F.regexp_extract_all(line, F.lit(_WORD), F.lit(0)), known))
    # the generator keeps the filter from cutting each text once more
    some = docs.select(col(id_col).alias("doc_id"), F.explode(F.array(F.struct(lines.alias("lines")))).alias("d"))
    some = some.select("doc_id", "d.lines").where(F.size(F.array_distinct(F.array_compact(F.flatten("lines")))) >= least)
    return materialize(some, "lexed")


def blocks(texts: DataFrame, least: int) -> DataFrame:
    """``(doc_id, block, words)``: each line that has at least ``least`` distinct words of the vocabulary."""
    lines = texts.select("doc_id", F.posexplode("lines").alias("block", "line"))
    return lines.select("doc_id", "block", F.explode_outer(F.array(F.array_distinct(F.array_compact("line")))).alias("words")).where(F.size("words") >= least)


def frequencies(texts: DataFrame) -> dict[str, int]:
    """Number of lines that hold each template word; as many numbers as there are template words."""
    rows = texts.select(F.explode("lines").alias("line")).select(F.explode(F.array_distinct(F.array_compact("line"))).alias("w"))
    return {r.w: r.n for r in rows.groupBy("w").agg(F.count("*").alias("n")).collect()}


def wrapped(lines: list[list[str | None]], sets: list[tuple[set[str], int]], having: dict[str, list[int]], spread: int = SPREAD) -> list[tuple[int, int, int]]:
    """``(first line, template's index, overlap)`` of the runs of two or more lines that qualify for ``(words, need)``; ``having``: from words to templates."""
    tokens = [(at, w, i) for at, (w, i) in enumerate((w, i) for i, line in enumerate(lines) for w in line) if w is not None]
    counts = Counter(k for w in {w for _, w, _ in tokens} for k in having[w])
    out = []
    for k in sorted(k for k, n in counts.items() if n >= sets[k][1]):
        words, o = sets[k]
        mine = [x for x in tokens if x[1] in words]
        # no run goes over a line that qualifies by itself
        alone = {i for i in {i for _, _, i in mine} if len(words.intersection(lines[i])) >= o}
        stretch: deque[tuple[int, str, int]] = deque()
        held: Counter[str] = Counter()
        for at, w, i in mine:
            if i in alone:
                stretch.clear()
                held.clear()
                continue
            stretch.append((at, w, i))
            held[w] += 1
            while stretch[0][0] <= at - spread * len(words) or held[stretch[0][1]] > 1:
                gone = stretch.popleft()[1]
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
            if len(held) >= o:
                start = stretch[0][2]
                out.append((start, k, len(words.intersection(w for line in lines[start : i + 1] for w in line))))
                stretch.clear()
                held.clear()
    return out


def wrapped_rows(texts: DataFrame, sets: dict[str, list[str]], prefix: list[str], threshold: float) -> DataFrame:
    """``(doc_id, block, k, overlap)`` for runs of two or more lines, k the template's place in ``sets``."""
    given = [(set(s), need(len(s), threshold)) for s in sets.values()]
    having: dict[str, list[int]] = {}
    for k, (words, _) in enumerate(given):
        for w in words:
            having.setdefault(w, []).append(k)

    @F.arrow_udf("array<struct<block: int, k: int, overlap: int>>")
    def runs(v: pa.Array) -> pa.Array:
        rows = [wrapped(lines, given, having) for lines in v.to_pylist()]
        flat = [r for x in rows for r in x]
        struct = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int32()) for k in range(3)], ["block", "k", "overlap"])
        return list_of(np.fromiter(map(len, rows), np.int64, len(rows)), struct)

    some = texts.where((F.size("lines") > 1) & F.exists(F.flatten("lines"), lambda w: w.isin(*prefix)))
    return some.select("doc_id", F.explode(runs.asNondeterministic()(F.col("lines"))).alias("h")).select("doc_id", "h.*")


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", runs: bool = False) -> DataFrame:
    """``(doc_id, block, template, overlap, containment)`` of every block and template at or over the threshold.

    ``block`` is the number of its first line. ``runs``: whether runs of adjacent lines are blocks too.
    """
    spark = docs.sparkSession
    sets = {name: template_words(t) for name, t in templates.items() if template_words(t)}
    vocabulary = sorted({w for s in sets.values() for w in s})
    if not vocabulary:
        return docs.select(col(id_col).alias("doc_id"), F.lit(0).alias("block"), F.lit("").alias("template"), F.lit(0).alias("overlap"), F.lit(0.0).alias("containment")).where("false")
    least = min(need(len(s), threshold) for s in sets.values())
    texts = lexed(docs, vocabulary, least, id_col, text_col)
    freq = frequencies(texts)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (freq.get(w, 0), w)))}
    ordered = {n: sorted(s, key=rank.get) for n, s in sets.items()}
    prefixes = {n: s[: len(s) - need(len(s), threshold) + 1] for n, s in ordered.items()}
    any_prefix = sorted({w for p in prefixes.values() for w in p})
    index = [(w, k, at, len(ordered[n]), need(len(ordered[n]), threshold), [rank[x] for x in ordered[n]]) for k, (n, p) in enumerate(prefixes.items()) for at, w in enumerate(p)]
    table = spark.createDataFrame(index, "prefix_word string, k int, at int, size int, need int, own array<int>")
    table = F.broadcast(table) if len(index) <= MOST_INDEXED else table
    rows = blocks(texts, least).where(F.exists("words", lambda w: w.isin(*any_prefix)))
    # the block's template words in the global order
    ranks = F.create_map(*[x for w, i in rank.items() for x in (F.lit(w), F.lit(i))])
    rows = rows.withColumn("ranked", F.array_sort(F.transform("words", lambda w: ranks[w])))
    pairs = rows.select("doc_id", "block", "ranked", F.explode(F.filter("words", lambda w: w.isin(*any_prefix))).alias("word")).join(table, F.col("word") == F.col("prefix_word"))
    mine = F.element_at("own", F.col("at") + 1)
    common = F.array_intersect("ranked", "own")
    possible = (F.size("ranked") >= F.col("need")) & (F.col("size") - F.col("at") >= F.col("need")) & (F.size("ranked") + 1 - F.array_position("ranked", mine) >= F.col("need"))
    pairs = pairs.where(possible).select("doc_id", "block", "k", "need", mine.alias("mine"), F.explode_outer(F.array(common)).alias("common"))
    found = pairs.where((F.size("common") >= F.col("need")) & (F.element_at("common", 1) == F.col("mine"))).select("doc_id", "block", "k", F.size("common").alias("overlap"))
    if runs:
        found = found.unionByName(wrapped_rows(texts, sets, any_prefix, threshold))
    names = spark.createDataFrame([(k, n, float(len(s))) for k, (n, s) in enumerate(sets.items())], "k int, template string, words double")
    names = F.broadcast(names) if len(sets) <= MOST_INDEXED else names
    return found.join(names, "k").select("doc_id", "block", "template", "overlap", (F.col("overlap") / F.col("words")).alias("containment"))


def oracle(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    values = ", ".join("('" + n + "', " + str(need(len(template_words(t)), threshold)) + ", [" + ", ".join(f"'{w}'" for w in template_words(t)) + "])" for n, t in templates.items())
    return rf"""
    WITH templates(template, need, tw) AS (VALUES {values}),
    lines AS (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS line, generate_subscripts(string_split(lower(text), chr(10)), 1) - 1 AS block FROM documents),
    sets AS (SELECT doc_id, block, list_distinct(regexp_extract_all(line, '[\p{{L}}\p{{N}}]+')) AS bw FROM lines),
    pairs AS (SELECT doc_id, block, template, need, len(tw) AS size, len(list_intersect(bw, tw)) AS overlap FROM sets, templates)
    SELECT doc_id, CAST(block AS INTEGER) AS block, template, CAST(overlap AS INTEGER) AS overlap, CAST(overlap AS DOUBLE) / size AS containment FROM pairs WHERE overlap >= need
    """

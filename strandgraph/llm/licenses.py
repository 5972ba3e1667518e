"""License scans: exact set-similarity join of text blocks against license templates.

Everything runs as DataFrame functions. A block is a line, or a stretch of words that line
breaks cut: as many words as the template has, divided by the threshold, wherever no line of
it meets the template alone. So a wrapped notice counts like one on a line, and a stretch
cannot gather its words from afar. Blocks and templates are sets of words. Tokens are ordered by how often they occur in all documents, rarest first. A block contains
a template if it holds at least ``need`` = ceil(threshold * size) of its tokens, so

* prefix filter: one of the template's size - need + 1 rarest tokens stands among the
  block's first |block| - need + 1;
* length filter: the block has at least ``need`` tokens of the vocabulary;
* positional filter: tokens before, at and after the meeting place can still reach ``need``.

What passes is verified by intersection; no block is left out otherwise. Stretches are tried
from every template word before a meeting place, by the same prefix. Regular expressions
run only on texts and lines that hold their literal words, which a plain search finds.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.llm.common import col, stored

THRESHOLD = 0.9
#: Phrases of the base scan and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Openings of public license texts and common notices, with labels.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("reserved", "All rights reserved"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_BYTE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def lowered(text: Column) -> Column:
    """Lower case. Only A-Z can become an ASCII letter: the Kelvin sign is kept out of the way."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))


def _split(text: Column) -> Column:
    # Spark's extraction of all matches takes some twenty times as long
    return F.array_remove(F.split(text, _GAP), "")


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _places(words: Column) -> Column:
    """Structs (start, label) of the phrase places in an array of words, in order."""

    def label(word: Column, at: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, name in PHRASES.items():
            first, *rest = phrase.split()
            same = word == first
            for k, w in enumerate(rest, 1):
                same = same & F.coalesce(F.get(words, at + k) == w, F.lit(False))
            out = F.when(same, F.lit(name)).otherwise(out)
        return F.struct(at.cast("long").alias("start"), out.alias("label"))

    return F.filter(F.transform(words, label), lambda p: p["label"].isNotNull())


def _holds_phrase(text: Column) -> Column:
    """Whether the words of a phrase stand in the text one after another."""

    def holds(phrase: str) -> Column:
        words = phrase.split()
        alone = f"{words[0]}(?<!{_WORD_BYTE}{words[0]}){''.join(_GAP + w for w in words[1:])}(?!{_WORD_BYTE})"
        return reduce(and_, [text.contains(w) for w in words]) & text.rlike(alone)

    return reduce(or_, map(holds, PHRASES))


def _holds_any(text: Column, words: list[str]) -> Column:
    """Whether the text holds one of the strings, inside words too."""
    return reduce(or_, [text.contains(w) for w in words], F.lit(False))


def token_ranks(tokens: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Rank of each vocabulary token by its occurrences in all of ``tokens(token)``, rarest first.

    One count per vocabulary token reaches the driver; the vocabulary is the templates'.
    """
    known = tokens.filter(F.col("token").isin(vocabulary))
    counts = {r.token: r.n for r in known.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {t: k for k, t in enumerate(sorted(vocabulary, key=lambda t: (counts.get(t, 0), t)))}


def _known(text: Column, vocabulary: list[str], rank_of: Column) -> Column:
    """Structs (place, line, token) of the vocabulary's words in a text, in order."""
    lines = F.transform(F.split(text, "\n"), lambda line, k: F.transform(_split(line), lambda w: F.struct(k.alias("line"), w.alias("word"))))
    placed = F.transform(F.flatten(lines), lambda x, at: F.struct(at.alias("place"), x["line"].alias("line"), x["word"].alias("word")))
    kept = F.filter(placed, lambda x: x["word"].isin(vocabulary))
    return F.transform(kept, lambda x: F.struct(x["place"].alias("place"), x["line"].alias("line"), rank_of[x["word"]].alias("token")))


def _across_lines(base: DataFrame, prefixes: DataFrame, rare: list[int], widest: int) -> DataFrame:
    """``(row, block, label, containment, line)`` of the stretches of ``base(row, known)`` that meet a template across lines.

    line is that of a stretch's first word if it does not overlap the one before, else null; block is null.
    """
    # a known word has a place of its own, so those within ``widest`` places are within as many elements
    cut = lambda k: F.slice("known", F.greatest(k - widest + 2, F.lit(1)), 2 * widest)
    meeting = F.filter(F.transform("known", lambda x, k: F.struct(x.alias("at"), k.alias("k"))), lambda x: x["at"]["token"].isin(rare))
    meeting = F.transform(meeting, lambda x: F.struct(x["at"]["token"].alias("token"), x["at"]["place"].alias("place"), cut(x["k"]).alias("near")))
    near = base.select("row", F.explode(meeting).alias("x")).select("row", "x.*")
    near = near.join(F.broadcast(prefixes), "token")
    width, need = F.col("width"), F.col("need")
    mine = near.withColumn("near", F.filter("near", lambda x: F.array_contains("ordered", x["token"]) & (F.abs(x["place"] - F.col("place")) < width)))
    mine = mine.filter((F.size("near") >= need) & (F.element_at("near", -1)["line"] > F.element_at("near", 1)["line"]))

    def stretch(s: Column) -> Column:
        inside = F.filter("near", lambda x: (x["place"] >= s["place"]) & (x["place"] < s["place"] + width))
        return F.struct(
            s["place"].alias("start"), s["line"].alias("first"), F.element_at(inside, -1)["line"].alias("last"),
            F.size(F.array_distinct(F.transform(inside, lambda x: x["token"]))).alias("n"),
        )

    starts = F.transform(F.filter("near", lambda s: s["place"] <= F.col("place")), stretch)
    starts = F.filter(starts, lambda s: (s["n"] >= need) & (s["last"] > s["first"]))
    met = mine.select("row", "template", "label", "size", "need", "ordered", "width", F.explode(starts).alias("s")).select("*", "s.*").drop("s").distinct()
    met = met.join(base.select("row", "known"), "row")
    own = F.filter("known", lambda x: F.array_contains("ordered", x["token"]) & x["line"].between(F.col("first"), F.col("last")))
    alone = F.exists(
        F.sequence("first", "last"),
        lambda k: F.size(F.array_distinct(F.transform(F.filter(own, lambda x: x["line"] == k), lambda x: x["token"]))) >= need,
    )
    before = F.lag("start").over(Window.partitionBy("row", "template").orderBy("start"))
    met = met.filter(~alone).withColumn("opens", F.coalesce(F.col("start") - before >= width, F.lit(True)))
    return met.select("row", F.lit(None).cast("int").alias("block"), "label", (F.col("n") / F.col("size")).alias("containment"), F.when(F.col("opens"), F.col("first")).alias("line"))


def scan_licenses(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``docs`` with the base scan's and the join's findings.

    Columns: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    n_blocks (distinct lines that meet a template, and lines in which stretches across lines
    that meet one begin; stretches of one template that overlap count once). score is 1 if a phrase stands in the
    text, else the best containment found, else 0. Null and empty texts have no words and
    no labels; repeated rows all return; an empty table gives no rows.
    """
    templates = TEMPLATES if templates is None else templates
    tokens = [(label, sorted(set(words_of(text)))) for label, text in templates]
    vocabulary = sorted({t for _, ts in tokens for t in ts})
    text = lowered(col(text_col))
    ranks = token_ranks(docs.select(F.explode(_split(text)).alias("token")), vocabulary)

    rows = []
    for k, (label, ts) in enumerate(tokens):
        ordered = sorted(ranks[t] for t in ts)
        need = math.ceil(threshold * len(ordered) - 1e-9)
        width = math.floor(len(words_of(templates[k][1])) / threshold + 1e-9)
        rows += [(k, label, len(ordered), need, ordered, at, ordered[at], width) for at in range(len(ordered) - need + 1)]
    schema = "template int, label string, size int, need int, ordered array<int>, at int, token int, width int"
    prefixes = docs.sparkSession.createDataFrame(rows, schema)
    rare = sorted({vocabulary_token for vocabulary_token, r in ranks.items() if r in {row[6] for row in rows}})
    hint = f"(?<!{_WORD_BYTE})(?:{'|'.join(map(re.escape, rare))})(?!{_WORD_BYTE})"

    base = docs.select(col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    base = base.select("doc_id", "text", F.size(_split(F.col("text"))).cast("long").alias("n_words"))
    lines = F.filter(F.split("text", "\n"), lambda line: _holds_any(line, rare) & line.rlike(hint))
    rank_of = F.create_map(*[F.lit(x) for t, r in ranks.items() for x in (t, r)])
    base = base.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "text",
        F.when(_holds_phrase(F.col("text")), _places(_split(F.col("text")))).alias("places"),
        F.when(_holds_any(F.col("text"), rare), F.array_distinct(lines)).alias("lines"),
    )
    wrapped = (F.size("lines") > 0) & F.col("text").contains("\n")
    base = stored(base.withColumn("known", F.when(wrapped, _known(F.col("text"), vocabulary, rank_of))).drop("text"))

    blocks = base.select("row", F.posexplode("lines").alias("block", "line"))
    blocks = blocks.select("row", "block", F.array_sort(F.transform(F.array_intersect(_split(F.col("line")), _strings(vocabulary)), lambda t: rank_of[t])).alias("held"))
    blocks = blocks.select("row", "block", "held", F.posexplode("held").alias("place", "token"))
    n = F.size("held")
    meets = blocks.join(F.broadcast(prefixes), "token").filter(
        (n >= F.col("need"))
        & (F.col("place") <= n - F.col("need"))
        & (F.least("place", "at") + 1 + F.least(n - F.col("place") - 1, F.col("size") - F.col("at") - 1) >= F.col("need"))
    )
    overlap = F.size(F.array_intersect("held", "ordered"))
    verified = meets.filter(overlap >= F.col("need")).select("row", "block", "label", (overlap / F.col("size")).alias("containment"))
    verified = verified.withColumn("line", F.lit(None).cast("int")).unionByName(_across_lines(base, prefixes, sorted({r[6] for r in rows}), max((r[7] for r in rows), default=0)))
    found = verified.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"), (F.count_distinct("block") + F.count_distinct("line")).alias("n_blocks"))

    base_labels = F.coalesce(F.array_distinct(F.transform("places", lambda p: p["label"])), F.array().cast("array<string>"))
    starts = F.transform("places", lambda p: p["start"])
    return base.join(found, "row", "left").select(
        "doc_id", "n_words", F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size(base_labels) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )

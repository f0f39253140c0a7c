"""License scans: base phrases and an exact containment join with templates.  DataFrame functions only.

Base: the places where a phrase's words stand consecutively.

Join: a text block is any run of as many words as a template has, and a quarter
more, wherever lines break.  It meets the template if it has at least `threshold`
of the template's distinct words.  Words are ordered by the number of documents
that have them, rarest first.  Of a template of m words, of which c must be
found, a block without any of the m - c + 1 rarest can't meet it (prefix
filter), nor can one in a text with fewer than c of its words (length filter).
Blocks are looked for around each such word alone, and counted there only with the
words from its place in the order on, since a block with a rarer one is counted
around that (positional filter).  What passes is verified on whole sets, so every
block that meets a template is found.  The templates have a fixed size and are
part of the plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.shared import spread
from .shared import checkpointed

# Phrases, and opening sentences of public licenses, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
]
#: Templates of related licenses differ in two words of twenty.
THRESHOLD = 0.95
#: Words of a block for each word of its template.
SLACK = 1.25
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a lower-cased text."""
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def lowered(name: str) -> Column:
    return F.translate(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")), UPPER, LOWER)


def spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def places(flat: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Number of places of a phrase in " w0 w1 ... ", and the first and last start in words; nulls without any."""
    own = f" {phrase} "
    has = flat.contains(own)
    first = spaces(F.substring_index(flat, own, 1))
    last = F.length(flat) - F.instr(F.reverse(flat), own[::-1]) - len(own) + 2
    return (
        F.when(has, F.regexp_count(flat, F.lit(f"(?= \\Q{phrase}\\E )"))).otherwise(0).cast("long"),
        F.when(has, first),
        F.when(has, spaces(F.substring(flat, F.lit(1), last)) - 1),
    )


def joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def ordered(often: dict[str, int], templates: list[tuple[str, str]], threshold: float, slack: float) -> list[Column]:
    """For each template: label, its distinct words rarest first, those of which a block must have one, how many it must have, and the words of a block."""
    out = []
    words = lambda ws: F.array(*map(F.lit, ws))
    for label, text in templates:
        own = sorted(set(text.split()), key=lambda w: (often.get(w, 0), w))
        need = math.ceil(threshold * len(own) - 1e-9)
        out.append(F.struct(F.lit(label).alias("label"), words(own).alias("tokens"), words(own[: len(own) - need + 1]).alias("prefix"), F.lit(need).alias("need"), F.lit(math.ceil(slack * len(text.split()))).alias("width")))
    return out


def scanned(docs: DataFrame, id: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, slack: float = SLACK) -> DataFrame:
    """A row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Texts are lower-cased A-Z; words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`;
    null texts are empty.  labels: base ones, and those of every template that a
    block of the text meets.  score: 1 with a base label, else the largest share of a
    template that a block which meets it has, else 0.  Rows with equal id and text
    are judged alike.  Phrases may share words with one another, and with themselves.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    rows = spread(docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))).select("id", lowered("text").alias("text"))
    key = [F.xxhash64("text").alias("h"), F.octet_length("text").alias("size")]
    vocabulary = F.array(*map(F.lit, sorted({w for _, t in templates for w in t.split()}))).cast("array<string>")
    words = rows.select("id", *key, words_of(F.col("text")).alias("words"))
    flat = words.select("id", "h", "size", F.size("words").cast("long").alias("n_words"), F.array_intersect("words", vocabulary).alias("known"), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("flat"))
    found = [(label, *places(F.col("flat"), phrase)) for phrase, label in phrases.items()]
    null = F.lit(None).cast("long")
    base = flat.select(
        "id", "h", "size", "n_words", "known",
        sum((n for _, n, _, _ in found), F.lit(0)).cast("long").alias("n_base"),
        F.least(*(a for _, _, a, _ in found), null, null).alias("first_word"),
        F.greatest(*(b for _, _, _, b in found), null, null).alias("last_word"),
        F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(n > 0, label) for label, n, _, _ in found))).alias("own"),
    )
    base = checkpointed(base)
    often = {r.w: r["count"] for r in base.select(F.explode("known").alias("w")).groupBy("w").count().collect()}  # one row per word of the templates at most
    none = F.array().cast("array<string>")
    if templates:
        each = F.array(*ordered(often, templates, threshold, slack))
        hopeful = words.withColumn("known", F.array_intersect("words", vocabulary)).select("id", "h", "size", "words", F.explode(F.filter(each, lambda t: F.size(F.array_intersect("known", t["tokens"])) >= t["need"])).alias("t"))
        width, tokens = F.col("t.width"), F.col("t.tokens")
        at = F.array_compact(F.transform("words", lambda w, p: F.when(F.array_contains(F.col("t.prefix"), w), p)))
        near = F.transform(
            at,
            lambda p: F.struct(
                F.array_position(tokens, F.element_at("words", p + 1)).cast("int").alias("rank"),
                F.least(p + 1, width).alias("upto"),  # the word itself in what follows, from 1
                F.slice("words", F.greatest(p + 2 - width, F.lit(1)), F.least(p + 1, width) + width - 1).alias("words"),
            ),
        )
        around = hopeful.select("id", "h", "size", "t", F.explode(near).alias("near")).select("id", "h", "size", "t", "near", F.slice(tokens, F.col("near.rank"), F.size(tokens)).alias("rest"))
        around = around.filter(F.size(F.array_intersect("near.words", "rest")) >= F.col("t.need"))
        most = F.array_max(F.transform(F.sequence(F.lit(1), F.col("near.upto")), lambda s: F.size(F.array_intersect(F.slice("near.words", s, width), F.col("rest")))))
        met = around.select("id", "h", "size", "t.label", (most / F.size(tokens)).alias("share"), (most >= F.col("t.need")).alias("met")).filter("met")
    else:
        met = base.select("id", "h", "size", F.lit("").alias("label"), F.lit(0.0).alias("share")).limit(0)
    labels = checkpointed(met.groupBy("id", "h", "size").agg(F.collect_set("label").alias("more"), F.max("share").alias("best")))

    b, m = base.alias("b"), labels.alias("m")
    out = b.join(m, F.col("b.id").eqNullSafe(F.col("m.id")) & (F.col("b.h") == F.col("m.h")) & (F.col("b.size") == F.col("m.size")), "left")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select(F.col("b.id").alias(id), "n_words", "n_base", "first_word", "last_word", joined(F.col("own")).alias("base_labels"), joined(F.concat("own", F.coalesce("more", none))).alias("labels"), score.alias("score"))

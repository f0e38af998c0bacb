"""License scans: phrases at word places, and notices found by an exact set-similarity join.

A notice is known by a template, the set of its words.  Texts are cut into overlapping blocks,
and every block that contains at least THRESHOLD of a template's words is found: words are ordered by
how many documents hold them, rarest first; a block and a template that meet must share one of
the first words of both (prefix filter), the block must be large enough (length filter), and the
words after the shared one must suffice on both sides (position filter).  What remains is verified.

Everything is DataFrame expressions.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import column, lower_ascii

# Phrases of the base labels, by label.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

# Usual wordings of notices, by label; a label may have several.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
                   "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
#: Share of a template's words that a block must contain, in percent.
THRESHOLD = 85
#: Templates of up to so many words are looked for in blocks of twice as many, at every half block:
#: each run of so many words lies whole in a block.
REACHES = (16, 64)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OUTPUTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def template_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, "".join(c.lower() if c < "\x7f" else c for c in text)) if w]


def prepared(templates: list[tuple[str, str]], threshold: int) -> list[dict]:
    """Templates as word sets, with the words a block must share and the reach of their blocks."""
    out = []
    for label, text in templates:
        run = template_words(text)
        words = sorted(set(run))
        reach = next((r for r in REACHES if len(run) <= r), None)
        if not words or reach is None:
            raise ValueError(f"a template has 1 to {REACHES[-1]} words: {text[:40]!r}")
        out.append({"label": label, "words": words, "need": -(-threshold * len(words) // 100), "reach": reach})
    return out


def _table(rows: DataFrame, structs: list[Column]) -> DataFrame:
    """A small table of literals."""
    return rows.sparkSession.range(1).select(F.inline(F.array(*structs)))


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _h1, _h2, _flat, _spaced) per row: words joined by one space, and each word between two spaces of its own."""
    text = F.coalesce(column(text_col), F.lit(""))
    flat = F.trim(F.regexp_replace(lower_ascii(text), SEPARATORS, " "))
    rows = docs.select(column(id_col).alias("_id"), F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit("text"), text).alias("_h2"),
                       flat.alias("_flat"))
    spaced = F.when(F.col("_flat") == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.replace("_flat", F.lit(" "), F.lit("  ")), F.lit(" ")))
    return rows.withColumn("_spaced", spaced)


def _words(flat: str) -> Column:
    return F.when(F.col(flat) == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def _count(text: Column) -> Column:
    """Words of a part of `_spaced`."""
    return F.expr("CAST(0 AS BIGINT)") + (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))).cast("long") / 2


def _based(rows: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """Counts, places and labels of the phrases; each word has its own spaces, so neighbouring places never overlap."""
    n_words = _count(F.col("_spaced")).cast("long")
    counts, firsts, lasts, labels = [], [], [], []
    for label, phrase in sorted(phrases.items()):
        run = template_words(phrase)
        mark = " " + "  ".join(run) + " "
        found = F.contains("_spaced", F.lit(mark))
        gap = F.octet_length("_spaced") - F.octet_length(F.replace("_spaced", F.lit(mark), F.lit("")))
        counts.append(F.when(found, (gap / len(mark.encode())).cast("long")).otherwise(F.lit(0).cast("long")))
        firsts.append(F.when(found, _count(F.substring_index("_spaced", mark, 1)).cast("long")))
        lasts.append(F.when(found, n_words - len(run) - _count(F.substring_index("_spaced", mark, -1)).cast("long")))
        labels.append(F.when(found, F.lit(label)))
    one = lambda columns, pick: columns[0] if len(columns) == 1 else pick(*columns)
    return rows.select("_id", "_h1", "_h2", n_words.alias("n_words"), reduce(lambda a, b: a + b, counts).alias("n_base"),
                       one(firsts, F.least).alias("first_word"), one(lasts, F.greatest).alias("last_word"),
                       F.array_sort(F.array_compact(F.array(*labels))).alias("_base"))


def _by_frequency(rows: DataFrame, words: list[str]) -> list[str]:
    """The templates' words, those of the fewest documents first; counted over all rows.

    The driver reads one count per word of the templates.
    """
    held = rows.select(F.explode(F.array_intersect(_strings(words), _words("_flat"))).alias("word"))
    counts = {r.word: r["count"] for r in held.groupBy("word").count().collect()}
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def found_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: list[tuple[str, str]] = TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """(_id, _h1, _h2, block long, reach int, label, containment double): every block and template that meet, no pair lost.

    A block is a run of 2 * reach words from word block * reach on, the last one as long as the
    text lasts; containment is the share of the template's distinct words in it.
    """
    known = prepared(templates, threshold)
    rows = _scanned(docs, id_col, text_col)
    order = _by_frequency(rows, sorted({w for t in known for w in t["words"]}))
    at = {w: i for i, w in enumerate(order)}
    cells, least = [], {}
    for number, t in enumerate(known):
        mine = sorted(t["words"], key=at.__getitem__)
        least[t["reach"]] = min(least.get(t["reach"], len(mine)), t["need"])
        cells += [F.struct(F.lit(w).alias("word"), F.lit(t["reach"]).alias("reach"), F.lit(number).alias("template"), F.lit(t["label"]).alias("label"),
                           F.lit(i).alias("place"), F.lit(t["need"]).alias("need"), _strings(mine).alias("words"))
                  for i, w in enumerate(mine[:len(mine) - t["need"] + 1])]
    # Texts with too few of the words are out before they are cut.
    held = F.array_intersect(_strings(order), "_words")
    rows = rows.select("_id", "_h1", "_h2", _words("_flat").alias("_words")).where(F.size(held) >= min(least.values()))

    def blocks(reach: int) -> Column:
        last = F.greatest(F.ceil(F.size("_words") / reach).cast("int") - 2, F.lit(0))
        cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(
            k.cast("long").alias("block"), F.lit(reach).alias("reach"),
            F.array_intersect(_strings(order), F.slice("_words", k * reach + 1, F.lit(2 * reach))).alias("held")))
        return F.filter(cut, lambda b: F.size(b["held"]) >= least[reach])

    cut = (rows.select("_id", "_h1", "_h2", F.explode(F.concat(*[blocks(r) for r in sorted(least)])).alias("b"))
           .select("_id", "_h1", "_h2", "b.*").withColumn("_least", F.create_map(*[F.lit(x) for kv in least.items() for x in kv])[F.col("reach")]))
    probes = cut.select("*", F.posexplode(F.slice("held", F.lit(1), F.size("held") - F.col("_least") + 1)).alias("_place", "word"))
    met = probes.join(_table(docs, cells), ["word", "reach"])
    size, mine = F.size("held"), F.size("words")
    suffices = (size >= F.col("need")) & (F.least(mine - F.col("place"), size - F.col("_place")) >= F.col("need"))
    both = F.array_intersect("words", "held")
    # Of the prefix words a pair shares, the first one alone gives the pair.
    met = met.where(suffices).where((F.size(both) >= F.col("need")) & (F.get(both, F.lit(0)) == F.col("word")))
    return met.select("_id", "_h1", "_h2", "block", "reach", "label", (F.size(both) / mine).alias("containment"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES,
                  templates: list[tuple[str, str]] = TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row.

    Words are runs of 0-9, a-z (A-Z lower-cased) and everything beyond ASCII.  n_base counts all
    places where the words of a phrase stand in a row, first_word and last_word are the smallest
    and largest start of these (words from 0; null without any).  labels are the base labels and those
    of the templates of which some block holds `threshold` percent of the distinct words or more; both
    lists are distinct, sorted and comma-joined.  score is 1 where a phrase stands, else the
    largest share of a template found, else 0.

    A null or empty text has no words; very long texts are read whole and cut inside their row; repeated
    rows and null ids give a row each; an empty table gives an empty table; columns other
    than the id and the text are not read.  The driver reads one count per word of the templates.
    """
    rows = _based(_scanned(docs, id_col, text_col), phrases)
    found = (found_notices(docs, id_col, text_col, templates, threshold).groupBy("_id", "_h1", "_h2")
             .agg(F.collect_set("label").alias("_found"), F.max("containment").alias("_best"))
             .select(F.col("_id").alias("_fid"), F.col("_h1").alias("_f1"), F.col("_h2").alias("_f2"), "_found", "_best"))
    joined = rows.join(found, F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_h1") == F.col("_f1")) & (F.col("_h2") == F.col("_f2")), "left")
    every = F.array_sort(F.array_distinct(F.concat("_base", F.coalesce("_found", F.array().cast("array<string>")))))
    return joined.select(
        F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"))

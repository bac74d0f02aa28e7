"""License scan as an exact set-similarity join of text blocks with license templates, in DataFrame operations only.

Blocks are every LINES adjacent lines of a text, so a sentence that is wrapped over as many is found whole. A block meets
a template if it holds at least THRESHOLD of the template's distinct words, and those without which it is another
license. Words are ordered by how many documents have them, the rarest first, and both sides are sorted in that order.
The length filter drops documents and blocks with fewer of a template's words than are needed. A template need only be
looked up by its prefix: a block that misses all of the first |T| - need + 1 words can't hold ``need`` of the rest. The
positional filter drops a block whose first common word stands so late among its own words that those from there on
can't reach ``need``. The rest are verified exactly.

Texts are read once: what is written down for each row are its counts, which template words it has, and the text itself
only if it has enough of some template's words. Templates are a fixed list, so they are broadcast and no text is
shuffled: only matches are, by row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import common

#: Share of a template's words that a block must hold, and lines in a block.
THRESHOLD, LINES = 0.8, 3
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Base phrases with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Sentences by which texts state their license, with the labels they give and the words they must have.
TEMPLATES = (
    ("mit", "Released under the MIT License.", "mit"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission"),
    ("apache", "Licensed under the Apache License, Version 2.0.", "apache"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org", "compliance"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", "gnu general public"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general public"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 3.", "gnu lesser"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", "cc by nc"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla"),
)

Templates = tuple[tuple[str, str, str], ...]


def lowered(text: Column) -> Column:
    """A-Z in lower case as far as ASCII words can tell.

    ``lower`` also changes other letters, which no ASCII word sees but for the two whose lower case is or holds an ASCII
    letter; texts with those take the slower, literal way.
    """
    odd = F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212a"))
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def normal(text: Column) -> Column:
    """The words of a text in lower case, one space between them; empty if there are none."""
    return F.trim(F.regexp_replace(lowered(F.coalesce(text, F.lit(""))), SEPARATORS, " "))


def _local(spark: SparkSession, rows: list[Column]) -> DataFrame:
    """Literal structs as a table."""
    return spark.range(1).select(F.inline(F.array(*rows)))


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _starts(words: Column, phrase: str) -> Column:
    """Places, words from 0, where the phrase's words stand consecutively."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        hit = F.element_at(words, i + 1) == parts[0]
        for k, part in enumerate(parts[1:], 2):
            hit = hit & (F.element_at(words, i + k) == part)
        return hit

    last = F.size(words) - len(parts)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


@dataclass(frozen=True)
class Template:
    """A template's distinct words in some order, how many of them a block needs, and which of them in any case."""

    number: int
    label: str
    words: tuple[str, ...]
    need: int
    must: tuple[str, ...]


def _plain(text: str) -> list[str]:
    return list(dict.fromkeys("".join(c if c.isalnum() else " " for c in text.lower()).split()))


def templates(given: Templates = TEMPLATES, threshold: float = THRESHOLD) -> list[Template]:
    if not given or not all(text.isascii() and must.isascii() for _, text, must in given):
        raise ValueError("there must be templates, in ASCII")
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is over 0 and at most 1")
    found = [Template(k, label, tuple(_plain(text)), math.ceil(len(_plain(text)) * threshold), tuple(_plain(must))) for k, (label, text, must) in enumerate(given)]
    if any(not t.words or not set(t.must) <= set(t.words) for t in found):
        raise ValueError("a template has words, and those it must have among them")
    return found


def measured(docs: DataFrame, wanted: list[Template]) -> DataFrame:
    """A row for each of ``docs``: row, doc_id, n_words, places and labels of base phrases, template words, and text if it may match."""
    vocabulary = sorted({w for t in wanted for w in t.words})
    base = docs.select("doc_id", "text", normal(F.col("text")).alias("normal"))
    base = base.withColumn("words", F.when(F.col("normal") == "", F.array().cast("array<string>")).otherwise(F.split("normal", " ")))
    base = base.withColumn("present", F.array_intersect(_strings(vocabulary), F.col("words")))
    may = F.lit(False)
    for t in wanted:
        may = may | (F.size(F.array_intersect(_strings(list(t.words)), F.col("present"))) >= t.need)
    columns = []
    for phrase, label in PHRASES:
        columns.append(F.when(F.contains(F.col("normal"), F.lit(phrase)), _starts(F.col("words"), phrase)).otherwise(F.array().cast("array<int>")).alias(label))
    return base.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), F.struct(*columns).alias("places"), "present", F.when(may, F.col("text")).alias("text"))


def in_order(rows: DataFrame, wanted: list[Template]) -> tuple[list[str], list[Template]]:
    """The templates' words, those that the fewest documents have first, and the templates with theirs in that order."""
    counts = dict(rows.select(F.explode("present").alias("word")).groupBy("word").count().collect())  # at most one a template word
    order = sorted({w for t in wanted for w in t.words}, key=lambda w: (counts.get(w, 0), w))
    place = {w: k for k, w in enumerate(order)}
    return order, [Template(t.number, t.label, tuple(sorted(t.words, key=place.__getitem__)), t.need, t.must) for t in wanted]


def blocks(rows: DataFrame, lines: int = LINES) -> DataFrame:
    """(row, line, block): every ``lines`` adjacent lines of a text, or all of it if it has fewer."""
    split = rows.filter("text is not null").select("row", F.split("text", "\n").alias("each"))
    at = F.sequence(F.lit(0), F.greatest(F.size("each") - lines, F.lit(0)))
    return split.select("row", F.explode(F.transform(at, lambda i: F.struct(i.alias("line"), F.array_join(F.slice("each", i + 1, lines), " ").alias("block")))).alias("b")).select("row", "b.*")


def pairs(found: DataFrame, order: list[str], wanted: list[Template]) -> DataFrame:
    """Blocks with each template whose prefix they meet, once, by the first common word; t_at and b_at are its places."""
    sorted_blocks = found.withColumn("b_words", F.array_intersect(_strings(order), F.split(normal(F.col("block")), " ")))
    fixed = [F.struct(F.lit(t.number).alias("template"), F.lit(t.label).alias("label"), _strings(list(t.words)).alias("t_words"), F.lit(t.need).alias("need"), _strings(list(t.must)).alias("must")) for t in wanted]
    prefixes = _local(found.sparkSession, fixed).select("*", F.posexplode(F.slice("t_words", 1, F.size("t_words") - F.col("need") + 1)).alias("t_at", "word"))
    met = sorted_blocks.filter(F.size("b_words") >= min(t.need for t in wanted)).select("row", "line", "b_words", F.posexplode("b_words").alias("b_at", "word")).join(F.broadcast(prefixes), "word")
    met = met.filter(F.size("b_words") >= F.col("need")).withColumn("shared", F.array_intersect("t_words", "b_words"))
    return met.filter(F.element_at("shared", 1) == F.col("word"))


def possible() -> Column:
    """The positional filter: from the first common word on, either side still has as many words as are needed."""
    return (F.size("b_words") - F.col("b_at") >= F.col("need")) & (F.size("t_words") - F.col("t_at") >= F.col("need"))


def similarity_join(found: DataFrame, order: list[str], wanted: list[Template]) -> DataFrame:
    """Every (row, line, label, template, containment) where the block holds what is needed of the template's words."""
    met = pairs(found, order, wanted).filter(possible())
    met = met.filter((F.size("shared") >= F.col("need")) & (F.size(F.array_except("must", "b_words")) == 0))
    return met.select("row", "line", "label", "template", (F.size("shared") / F.size("t_words")).alias("containment"))


def scan(docs: DataFrame, threshold: float = THRESHOLD, given: Templates = TEMPLATES) -> DataFrame:
    """Per row of ``docs``: its words, the places of base phrases, and labels by phrases and by similar blocks.

    Null and empty texts have no words, places or labels. Rows are told apart by a number, so rows that share an id, null
    or not, have their own results. score is the largest containment found, and 1 if a base phrase occurs. An empty table
    gives an empty one.
    """
    wanted = templates(given, threshold)
    rows = common.stored(measured(docs, wanted))
    order, wanted = in_order(rows, wanted)
    matches = similarity_join(blocks(rows), order, wanted).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    labels = F.array_compact(F.array(*[F.when(F.size(f"places.{label}") > 0, F.lit(label)) for _, label in PHRASES]))
    base = rows.select("row", "doc_id", "n_words", F.concat(*[f"places.{label}" for _, label in PHRASES]).alias("places"), F.array_sort(labels).alias("base"))
    both = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return base.join(matches, "row", "left").select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )

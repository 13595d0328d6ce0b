"""License scan: fixed phrases, and an exact containment join of text blocks with notice templates. DataFrame functions only.

A text block is a run of words; a template is found in a block that holds at least ``threshold`` of its
distinct words. The join orders the templates' words by their document frequency over all texts, rarest
first. Of ``size`` words of which ``need`` have to be shared, one of the rarest ``size - need + 1`` is
shared (prefix filter, on both sides); a block of fewer words than ``need`` can't qualify (length filter);
and where a shared word stands too far back in either order for ``need`` shared words to be left, the pair
goes before it is compared (positional filter). Words that no template has are dropped from the blocks
beforehand, which changes no intersection.
"""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The phrases as they are given, with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Notices as their publishers word them, with their labels; none is longer than a block's step.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("gpl", "you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Words from one block's start to the next, and a block's words: a passage of up to STEP + 1 words lies whole in some block.
STEP, BLOCK = 32, 64
THRESHOLD = Fraction(9, 10)


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(_UPPER, _LOWER)))


def lowered(text: Column) -> Column:
    """A-Z lower-cased (in plain ASCII that is what ``lower`` does, faster), null as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def split_words(text: Column) -> Column:
    """The words of a text; one empty string where there are none."""
    return F.split(F.trim(F.regexp_replace(lowered(text), BETWEEN, " ")), " ")


def spelled(text: Column) -> Column:
    """The words of a text with a blank before and after each, so that two blanks part them; two blanks without words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered(text), BETWEEN, "  ")), F.lit(" "))


def _n_words(spelt: Column) -> Column:
    """Two blanks a word."""
    blanks = F.octet_length(spelt) - F.octet_length(F.replace(spelt, F.lit(" "), F.lit("")))
    return F.when(F.octet_length(spelt) <= 2, 0).otherwise(F.floor(blanks / 2)).cast("long")


def _phrases(rows: DataFrame, phrases: tuple[tuple[str, str], ...]) -> DataFrame:
    """Adds n_base, first_word, last_word and the array base_labels from ``spelt`` and ``n_words``."""
    spelt, nothing = F.col("spelt"), F.lit(None).cast("long")
    places, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases:
        words = words_of(phrase)
        key = "".join(f" {w} " for w in words)
        there = F.contains(spelt, F.lit(key))
        # places that overlap count each, so they are looked for by lookahead
        places.append(F.when(there, F.regexp_count(spelt, F.lit(f"(?={re.escape(key)})"))).otherwise(0).cast("long"))
        firsts.append(F.when(there, _n_words(F.substring_index(spelt, key, 1))).otherwise(nothing))
        lasts.append(F.when(there, F.col("n_words") - _n_words(F.substring_index(spelt, key, -1)) - len(words)).otherwise(nothing))
        labels.append(F.when(there, F.lit(label)))
    total = places[0]
    for p in places[1:]:
        total = total + p
    found = F.filter(F.array(*labels), lambda x: x.isNotNull())
    return rows.withColumns({"n_base": total, "first_word": F.array_min(F.array(*firsts)), "last_word": F.array_max(F.array(*lasts)), "base": F.array_sort(F.array_distinct(found))})


def _template_rows(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """``(template, label, tokens)`` from literals."""
    sets = [(i, label, sorted(set(words_of(text)))) for i, (label, text) in enumerate(templates)]
    if long := [text for _, text in templates if len(words_of(text)) > STEP + 1]:
        raise ValueError(f"a template of more than {STEP + 1} words may lie in no block whole: {long[0][:60]}")
    rows = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.array(*map(F.lit, tokens)).alias("tokens")) for i, label, tokens in sets if tokens]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _blocks(words: Column, ordered: Column) -> Column:
    """The template words of each block of a text, in the global order (that of ``ordered``)."""
    # the words are bound as a lambda's variable, so that they are split once a text
    of = lambda ws: F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(ws) - BLOCK) / STEP).cast("int"))),
        lambda i: F.array_intersect(ordered, F.slice(ws, i * STEP + 1, F.lit(BLOCK))),
    )
    return F.transform(F.array(words), of)[0]


def containments(rows: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, *, threshold: Fraction = THRESHOLD) -> DataFrame:
    """``(doc_id, sha, template, label, containment)`` of every template that a block of the text holds to ``threshold``.

    ``rows(doc_id, sha, text)``; the containment is the share of the template's distinct words in the
    best block. Only template words are ever counted, ordered or joined, so the tables beside the texts
    are as small as the templates.
    """
    num, den = threshold.numerator, threshold.denominator
    plain = _template_rows(rows.sparkSession, templates)
    vocabulary = F.array(*map(F.lit, sorted({w for _, text in templates for w in words_of(text)})))
    frequency = rows.select(F.explode(F.array_intersect(vocabulary, split_words(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    counted = plain.select("template", "label", F.explode("tokens").alias("token")).join(frequency, "token", "left").select("template", "label", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token").alias("x"))
    ranked = counted.groupBy("template", "label").agg(F.array_sort(F.collect_list("x"))["token"].alias("needed"))
    ranked = ranked.withColumn("size", F.size("needed")).withColumn("need", F.expr(f"({num} * size + {den - 1}) div {den}").cast("int"))
    index = ranked.select("*", F.posexplode(F.slice("needed", F.lit(1), F.col("size") - F.col("need") + 1)).alias("place", "token"))
    order = counted.groupBy().agg(F.array_sort(F.collect_set("x"))["token"].alias("ordered"))
    order = order.crossJoin(index.groupBy().agg(F.collect_set("token").alias("prefixes"), F.min("need").alias("least")))
    # one row, as wide as the templates
    blocks = rows.crossJoin(F.broadcast(order)).select("doc_id", "sha", "prefixes", F.explode(F.filter(_blocks(split_words(F.col("text")), F.col("ordered")), lambda b: (F.size(b) >= F.col("least")) & F.arrays_overlap(b, F.col("prefixes")))).alias("held"))
    keyed = blocks.select("doc_id", "sha", "held", F.explode(F.array_intersect("prefixes", "held")).alias("token"))
    # the index has a row for each prefix word of each template
    met = keyed.join(F.broadcast(index), "token").withColumns({"n": F.size("held"), "at": F.array_position("held", F.col("token")) - 1})
    left = F.least(F.col("size") - 1 - F.col("place"), F.col("n") - 1 - F.col("at"))
    met = met.where((F.col("n") >= F.col("need")) & (F.col("at") <= F.col("n") - F.col("need")) & (left + 1 >= F.col("need")))
    met = met.withColumn("shared", F.size(F.array_intersect("needed", "held"))).where("shared >= need")
    return met.groupBy("doc_id", "sha", "template", "label").agg(F.max(F.col("shared") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: tuple[tuple[str, str], ...] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: Fraction = THRESHOLD) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts the places of the fixed phrases, ``first_word`` and ``last_word`` are the least and
    greatest of their first words' numbers (null without any). ``labels`` adds those of the templates found.
    ``score`` is 1 with a phrase, else the greatest containment found, 0 without any.

    Null and empty texts have no words, no labels and score 0. A very long text is many blocks, of which
    only those with a rare template word leave its task. Repeated rows get a row each, with equal values;
    rows of null id are scanned like others; an empty table gives none; other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha1(F.coalesce(text, F.lit("")).cast("binary")).alias("sha"), text.alias("text"))
    found = containments(rows, templates, threshold=threshold).groupBy("doc_id", "sha").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    spelt = rows.select("doc_id", "sha", spelled(F.col("text")).alias("spelt"))
    based = _phrases(spelt.withColumn("n_words", _n_words(F.col("spelt"))), phrases).drop("spelt")
    a, b = based.alias("a"), found.alias("b")
    out = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.sha") == F.col("b.sha")), "left")
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", none)))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("a.doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"), F.concat_ws(",", labels).alias("labels"), score.alias("score"))

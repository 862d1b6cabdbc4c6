"""License notices in texts, found by diagonal voting.

Every three consecutive words of a text and of the templates form a gram. All grams of all texts are joined
with the grams of the templates by hash and, for certainty, by their words. A hit votes for its diagonal:
the gram's place in the text minus its place in the template. Votes are aggregated by (text, template,
diagonal); diagonals at most NEAR apart, as left by inserted or missing words, are merged into one span. A
span is verified by the share of the template's words that its hits cover; from SHARE on its label counts.

DataFrame expressions only. Only hits are shuffled; the templates are a bounded parameter, and whole texts
stay where they are read. A text is told apart by doc_id and two hashes, so copies under one id count once.

Defined results: a null text is empty; an empty one has no words, no labels and score 0; null and repeated
doc_ids keep their rows; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRAM_WORDS = 3
#: Diagonals up to this far apart belong to one span.
NEAR = 3
#: Least share of a template's words in a span.
SHARE = 0.8
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that name a license, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Opening or customary sentences of public licenses, with their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
]


def normal(text: Column) -> Column:
    """The words of a text, A-Z in lower case, with one space between them."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.trim(F.regexp_replace(lower, NO_WORD, " "))


def grams(words: Column) -> Column:
    """Each word with the next ones; the last entries of an array hold fewer than GRAM_WORDS words."""
    return F.transform(words, lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, GRAM_WORDS)]))


def template_grams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """template, label, length, at and gram."""
    rows = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("template"), F.lit(k).alias("label"), F.lit(t).alias("text")) for i, (k, t) in enumerate(templates)])))
    rows = rows.select("template", "label", F.split(normal(F.col("text")), " ").alias("words"))
    rows = rows.select("template", "label", F.size("words").alias("length"), F.posexplode(grams(F.col("words"))).alias("at", "gram"))
    return rows.where(F.col("at") + GRAM_WORDS <= F.col("length"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), F.xxhash64(F.lit("second"), text).alias("check"),
        normal(text).alias("normal"),
    )


KEY = ["doc_id", "hash", "check"]


def votes(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Key of the text, template, label, length, diagonal and covered: the places of the template it was voted at."""
    each = _keyed(docs).select(*KEY, F.split("normal", " ").alias("words"))
    each = each.select(*KEY, F.posexplode(grams(F.col("words"))).alias("place", "words"))
    known = template_grams(docs.sparkSession, templates).withColumn("gram_hash", F.xxhash64("gram"))
    hits = each.withColumn("gram_hash", F.xxhash64("words")).join(known, "gram_hash").where(F.col("words") == F.col("gram"))
    diagonal = (F.col("place") - F.col("at")).alias("diagonal")
    return hits.groupBy(*KEY, "template", "label", "length", diagonal).agg(F.collect_set("at").alias("covered"))


def spans(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Key of the text, template, label, first_word, last_word and share of every span, verified or not."""
    order = W.partitionBy(*KEY, "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > NEAR).cast("int"), F.lit(0))
    merged = votes(docs, templates).withColumn("new", new).withColumn("span", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    offsets = F.array(*[F.lit(k) for k in range(GRAM_WORDS)])
    words = F.explode(F.array_distinct(F.flatten(F.transform("covered", lambda t: F.transform(offsets, lambda k: t + k))))).alias("at")
    each = merged.select(*KEY, "template", "label", "length", "span", "diagonal", words)
    place = F.col("at") + F.col("diagonal")
    return each.groupBy(*KEY, "template", "label", "length", "span").agg(
        F.min(place).cast("long").alias("first_word"), F.max(place).cast("long").alias("last_word"),
        (F.count_distinct("at") / F.col("length")).alias("share"),
    ).drop("length", "span")


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Per row: words, places of the phrases, their labels, all labels, and the largest share found of a phrase or template."""
    spaced = F.concat(F.lit(" "), "normal", F.lit(" ")).alias("spaced")
    any_phrase = "|".join(phrases)
    label = F.create_map(*[F.lit(x) for pair in phrases.items() for x in pair])
    n_spaces = lambda text: (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")
    base = _keyed(docs).select(*KEY, F.when(F.col("normal") == "", 0).otherwise(F.size(F.split("normal", " "))).cast("long").alias("n_words"), spaced)
    base = base.withColumn("found", F.regexp_extract_all("spaced", F.lit(f" (?=({any_phrase}) )"), F.lit(1)))
    some = F.size("found") > 0
    base = base.select(
        *KEY, "n_words", F.size("found").cast("long").alias("n_base"),
        F.when(some, n_spaces(F.substring("spaced", F.lit(1), F.regexp_instr("spaced", F.lit(f" (?=(?:{any_phrase}) )")) - 1))).alias("first_word"),
        F.when(some, n_spaces(F.regexp_extract("spaced", f"(?s)^.*(?= (?:{any_phrase}) )", 0))).alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("found", lambda x: label[x]))).alias("base"),
    )
    kept = F.collect_set(F.when(F.col("share") >= SHARE, F.col("label"))).alias("own")
    own = spans(docs, templates).groupBy(*[F.col(k).alias(f"_{k}") for k in KEY]).agg(kept, F.max("share").alias("share"), F.count_if(F.col("share") >= SHARE).alias("n_spans"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("hash") == F.col("_hash")) & (F.col("check") == F.col("_check"))
    share = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    labels = F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    return base.join(own, same, "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        share.alias("score"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )

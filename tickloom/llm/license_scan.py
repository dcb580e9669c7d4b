"""License scans by diagonal voting, in DataFrame functions only.

All rolling word k-grams of every text are joined to the positions at which license
templates hold them. A hit votes for the diagonal (text position minus template
position) it lies on; neighbouring diagonals, which a few added or lost words make,
are merged, and a span counts once its votes cover enough of the template.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import lower_ascii

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3  # words in a k-gram
NEIGHBOUR = 4  # diagonals at most this far apart belong together
COVER = 0.6  # share of a template's k-grams that a span must hold
MOST_TEMPLATE_GRAMS = 100_000  # templates are broadcast; more than this is refused

# Phrases that name a license, and the labels they give.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Public license notices, one template each.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "Released under the MIT License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced"),
)


@dataclass(frozen=True)
class Scan:
    """The two results: one row for each input row, and one for each verified span."""

    documents: DataFrame
    spans: DataFrame


def words(text: Column) -> Column:
    """Words of a text in lower ASCII case; none for a null text."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def gram(array: Column, at: Column, k: int) -> Column:
    """The ``k`` words from place ``at`` (from 0) on, joined by blanks."""
    return F.concat_ws(" ", *[F.get(array, at + j) for j in range(k)])


def grams_of(rows: DataFrame, k: int) -> DataFrame:
    """One row for each rolling k-gram: its place ``at``, text ``gram`` and hash ``h``."""
    rows = rows.where(F.size("_words") >= k)
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("_words") - k)))
    return rows.withColumn("h", F.xxhash64(*[F.get("_words", F.col("at") + j) for j in range(k)])).withColumn("gram", gram(F.col("_words"), F.col("at"), k)).drop("_words")


def template_grams(spark: SparkSession, templates: tuple, k: int) -> DataFrame:
    frame = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string")
    rows = frame.select("template", "label", words(F.col("text")).alias("_words"))
    rows = rows.withColumn("n_grams", F.size("_words") - k + 1)
    grams = grams_of(rows, k)
    return grams.select("template", "label", "n_grams", F.col("at").alias("t_at"), F.col("h").alias("t_h"), F.col("gram").alias("t_gram"))


def phrase_places(phrase: str) -> Column:
    """Places in ``_words`` at which the phrase's words stand consecutively."""
    own = phrase.split()
    at = F.filter(
        F.sequence(F.lit(0), F.size("_words") - 1),
        lambda i: (F.get("_words", i + len(own) - 1) == own[-1]) & (gram(F.col("_words"), i, len(own)) == phrase),
    )
    return F.when(F.array_contains("_words", own[-1]), at).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, templates: tuple = TEMPLATES, phrases: tuple = PHRASES, key: str = "doc_id", text: str = "text", k: int = GRAM, cover: float = COVER) -> Scan:
    """License phrases and template spans of every text.

    ``documents``: ``key, n_words, n_base, first_word, last_word, base_labels, labels, score``, a row for each input
    row. ``spans``: ``key, text_hash, template, label, first_word, end_word, votes, coverage`` for
    each span that covers ``cover`` of a template (any wording of the same label counts). A null text counts
    as empty: no words, empty labels, score 0. The score is 1 with a phrase, else the best coverage.
    Rows with equal key and text share their spans; a null key is a key like any other.
    """
    spark = docs.sparkSession
    assert sum(len(t.split()) for _, t in templates) <= MOST_TEMPLATE_GRAMS, "too many template words to broadcast"
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    rows = rows.select("_key", F.xxhash64("_text").alias("_hash"), words(F.col("_text")).alias("_words"))

    # Votes: all rolling k-grams against the templates; few rows are left after the join.
    found = F.broadcast(template_grams(spark, templates, k))
    hits = grams_of(rows, k).join(found, (F.col("h") == F.col("t_h")) & (F.col("gram") == F.col("t_gram")))
    place = ["_key", "_hash", "template", "label", "n_grams"]
    hits = hits.select(*place, "at", "t_at").distinct()
    diagonals = hits.groupBy(*place, (F.col("at") - F.col("t_at")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("at").alias("first"), F.max("at").alias("last"), F.collect_set("t_at").alias("held")
    )
    # A text has no more diagonals for one template than words, so a window holds a text's own rows only.
    along = Window.partitionBy(*place).orderBy("diagonal")
    gap = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= NEIGHBOUR, 0).otherwise(1)
    merged = diagonals.withColumn("_new", gap).withColumn("band", F.sum("_new").over(along))
    bands = merged.groupBy(*place, "band").agg(
        F.sum("votes").alias("votes"), F.min("first").alias("first_word"), (F.max("last") + k).alias("end_word"),
        F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("held"),
    )
    spans = bands.withColumn("coverage", F.col("held") / F.col("n_grams")).where(
        # verified: enough of the template, within a stretch not much longer than it
        (F.col("coverage") >= cover) & (F.col("end_word") - F.col("first_word") <= 2 * (F.col("n_grams") + k) + NEIGHBOUR)
    )
    by_text = spans.groupBy("_key", "_hash").agg(F.collect_set("label").alias("_found"), F.max("coverage").alias("_best"))

    # Phrases: looked for only in texts that hold a phrase's last word.
    places, labels = [phrase_places(phrase) for phrase, _ in phrases], [label for _, label in phrases]
    base = rows.select("_key", "_hash", F.size("_words").cast("long").alias("n_words"), *[p.alias(f"_p{i}") for i, p in enumerate(places)])
    every = F.flatten(F.array(*[F.col(f"_p{i}") for i in range(len(places))]))
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"_p{i}") > 0, label) for i, label in enumerate(labels)]))
    base = base.select("_key", "_hash", "n_words", every.alias("_every"), base_labels.alias("_base"))
    joined = base.join(by_text.withColumnsRenamed({"_key": "_k", "_hash": "_h"}), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")), "left")
    none = F.array().cast("array<string>")
    distinct = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    documents = joined.select(
        F.col("_key").alias(key),
        "n_words",
        F.size("_every").cast("long").alias("n_base"),
        F.array_min("_every").cast("long").alias("first_word"),
        F.array_max("_every").cast("long").alias("last_word"),
        distinct(F.col("_base")).alias("base_labels"),
        distinct(F.concat("_base", F.coalesce("_found", none))).alias("labels"),
        F.when(F.size("_every") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).cast("double").alias("score"),
    )
    spans = spans.select(F.col("_key").alias(key), F.col("_hash").alias("text_hash"), "template", "label", "first_word", "end_word", "votes", "coverage")
    return Scan(documents, spans)


def scan_sql(templates: tuple = TEMPLATES) -> str:
    """The same ``documents`` over the table of that name in SQL, with the usual phrases, k and cover."""
    quoted = ", ".join("({}, '{}', '{}')".format(i, label, text.replace("'", "''")) for i, (label, text) in enumerate(templates))
    split = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
    gram = "w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]"
    return f"""
WITH words AS (
  SELECT doc_id, {split} AS w FROM documents
), templates(template, label, text) AS (
  VALUES {quoted}
), template_words AS (
  SELECT template, label, {split} AS w FROM templates
), template_grams AS (
  SELECT template, label, n_grams, i AS t_at, {gram} AS gram
  FROM (SELECT *, len(w) - 2 AS n_grams, unnest(range(0, len(w) - 2)) AS i FROM template_words)
), grams AS (
  SELECT doc_id, i AS d_at, {gram} AS gram FROM (SELECT *, unnest(range(0, len(w) - 2)) AS i FROM words WHERE len(w) >= 3)
), hits AS (
  SELECT DISTINCT doc_id, template, label, n_grams, d_at, t_at FROM grams JOIN template_grams USING (gram)
), diagonals AS (
  SELECT doc_id, template, label, n_grams, d_at - t_at AS diagonal, min(d_at) AS first_at, max(d_at) AS last_at, list(t_at) AS held
  FROM hits GROUP BY doc_id, template, label, n_grams, d_at - t_at
), marked AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= 4 THEN 0 ELSE 1 END AS fresh FROM diagonals
), banded AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS band FROM marked
), bands AS (
  SELECT doc_id, label, n_grams, min(first_at) AS first_at, max(last_at) + 3 AS end_at, len(list_distinct(flatten(list(held)))) AS held
  FROM banded GROUP BY doc_id, template, label, n_grams, band
), spans AS (
  SELECT doc_id, label, held / CAST(n_grams AS DOUBLE) AS coverage FROM bands
  WHERE held / CAST(n_grams AS DOUBLE) >= 0.6 AND end_at - first_at <= 2 * (n_grams + 3) + 4
), found AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(coverage) AS best FROM spans GROUP BY doc_id
), places AS (
  SELECT doc_id, len(w) AS n_words,
         [i FOR i IN range(0, len(w)) IF w[i + 1] = 'mit' AND w[i + 2] = 'license'] AS mit,
         [i FOR i IN range(0, len(w)) IF w[i + 1] = 'apache' AND w[i + 2] = 'license'] AS apache,
         [i FOR i IN range(0, len(w)) IF w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license'] AS gpl FROM words
), base AS (
  SELECT doc_id, n_words, mit || apache || gpl AS every,
         (CASE WHEN len(apache) > 0 THEN ['apache'] ELSE [] END) || (CASE WHEN len(gpl) > 0 THEN ['gpl'] ELSE [] END)
         || (CASE WHEN len(mit) > 0 THEN ['mit'] ELSE [] END) AS labels FROM places
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(every) AS BIGINT) AS n_base, CAST(list_min(every) AS BIGINT) AS first_word,
       CAST(list_max(every) AS BIGINT) AS last_word, array_to_string(base.labels, ',') AS base_labels,
       array_to_string(list_sort(list_distinct(base.labels || coalesce(found.labels, []))), ',') AS labels,
       CASE WHEN len(every) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM base LEFT JOIN found USING (doc_id)
"""

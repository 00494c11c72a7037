"""Licence scan: units of a text compared to licence templates.

Text is normalised (lower case, everything but letters and digits to one
space). Its units are its lines, its paragraphs (between blank lines) and
the whole text. A unit and a template are compared by the Dice coefficient
over their word bigrams, repeats counted: twice the shared bigrams over the
sum of both numbers. Since at most the smaller number can be shared, a
threshold d bounds the unit's size to between d/(2-d) and (2-d)/d of the
template's; templates outside these bounds are never compared.

All of it is column expressions on one row: no shuffle, no join, no Python.
The templates are a parameter and travel as literals in the plan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklane.llm.common import table

MIN_DICE = 0.8

# Notices by which works name their licence, and short licence
# texts, as published.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you "
     "may not use this file except in compliance with the License. You may "
     "obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause",
     "Redistribution and use in source and binary forms, with or without "
     "modification, are permitted provided that the following conditions "
     "are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons "
     "Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public "
     "License, version 3."),
    ("GPL-3.0-header",
     "This program is free software: you can redistribute it and/or modify "
     "it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation, either version 3 of the License, or "
     "(at your option) any later version."),
    ("ISC",
     "Permission to use, copy, modify, and/or distribute this software for "
     "any purpose with or without fee is hereby granted, provided that the "
     "above copyright notice and this permission notice appear in all "
     "copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT-text",
     "Permission is hereby granted, free of charge, to any person obtaining "
     "a copy of this software and associated documentation files (the "
     "\"Software\"), to deal in the Software without restriction, including "
     "without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software, and to "
     "permit persons to whom the Software is furnished to do so, subject to "
     "the following conditions:"),
)


def normalised(text: Column) -> Column:
    """Lower case; runs of other characters than letters, digits and line
    ends become one space. Null is empty."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))),
                            r"[^\p{L}\p{N}\n]+", " ")


def words(line: Column) -> Column:
    return F.filter(F.split(line, "[ \n]"), lambda w: w != "")


def bigrams(own: Column) -> Column:
    """Adjacent word pairs of a word array, in order, repeats kept."""
    return F.when(F.size(own) < 2, F.array().cast("array<string>")).otherwise(
        F.zip_with(F.slice(own, 1, F.size(own) - 1),
                   F.slice(own, 2, F.size(own) - 1),
                   lambda a, b: F.concat(a, F.lit(" "), b)))


def _shared(a: Column, b: Column) -> Column:
    """Size of the multiset intersection."""
    def times(xs: Column, g: Column) -> Column:
        return F.size(F.filter(xs, lambda x: x == g))
    return F.aggregate(F.array_intersect(a, b), F.lit(0),
                       lambda n, g: n + F.least(times(a, g), times(b, g)))


def _known(spark: SparkSession, templates) -> list[tuple[str, list[str]]]:
    """Bigrams of the templates, by the same expressions as the texts'. A
    small table of a parameter's rows."""
    if not templates:
        return []
    rows = spark.createDataFrame(list(templates), "id string, text string")
    return [(r.id, r.grams) for r in rows.select("id", bigrams(words(
        normalised(F.col("text")))).alias("grams")).collect() if r.grams]


def license_scan(documents: DataFrame, keep: Sequence[str] = ("doc_id",),
                 templates: Sequence[tuple[str, str]] = TEMPLATES,
                 min_dice: float = MIN_DICE) -> DataFrame:
    """One row for each row of ``documents``: the columns in ``keep``,
    ``licenses`` (ids of all templates that some unit matches, sorted,
    comma-joined, empty if none), ``best_license`` and ``best_dice`` (null
    if none; ties go to the first id) and ``n_matches`` (distinct units and
    templates that match).

    Null and empty texts match nothing; repeated rows and repeated lines
    don't add up; a template of fewer than two words matches nothing; other
    columns aren't read; an empty table gives no rows."""
    if not 0 < min_dice <= 1:
        raise ValueError("min_dice must be in (0, 1]")
    low, high = min_dice / (2 - min_dice), (2 - min_dice) / min_dice
    rows = documents.select(*keep, normalised(F.col("text")).alias("_text"))
    known = _known(documents.sparkSession, templates)
    if not known:
        known = [("", ["\n"])]      # no unit has this bigram
    least = math.floor(min(len(g) for _, g in known) * low)
    most = math.ceil(max(len(g) for _, g in known) * high)
    literals = F.array(*[F.struct(
        F.lit(k).alias("id"), F.lit(len(g)).alias("n"),
        F.array(*map(F.lit, g)).alias("grams")) for k, g in known])

    def fits(w: Column) -> Column:
        return (F.size(w) - 1).between(least, most)
    none = F.array().cast("array<array<string>>")
    rows = rows.select(*keep, "_text", F.transform(
        F.split("_text", "\n"), words).alias("_lines"))
    total = F.aggregate("_lines", F.lit(0), lambda n, w: n + F.size(w))
    blocks = F.when(F.col("_text").rlike("\n ?\n"), F.filter(F.transform(
        F.split("_text", "\n ?\n"), words), fits)).otherwise(none)
    whole = F.when((total - 1).between(least, most), F.array(
        words(F.col("_text")))).otherwise(none)
    rows = rows.select(*keep, F.array_distinct(F.concat(
        F.filter("_lines", fits), blocks, whole)).alias("_units"))

    def matches(unit: Column) -> Column:
        near = F.filter(literals, lambda t: F.size(unit).between(
            t["n"] * low, t["n"] * high) & F.arrays_overlap(
                unit, t["grams"]))
        return F.filter(F.transform(near, lambda t: F.struct(
            (-(_shared(unit, t["grams"]) * 2.0
               / (F.size(unit) + t["n"]))).alias("d"),
            t["id"].alias("id"))), lambda m: m["d"] <= -min_dice)
    rows = rows.select(*keep, F.flatten(F.transform(
        F.transform("_units", bigrams), matches)).alias("_found"))
    best = F.array_min("_found")
    return rows.select(
        *keep,
        F.array_join(F.array_sort(F.array_distinct(F.transform(
            "_found", lambda m: m["id"]))), ",").alias("licenses"),
        best["id"].alias("best_license"), (-best["d"]).alias("best_dice"),
        F.size("_found").cast("long").alias("n_matches"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in every document."""
    return license_scan(table(spark, sf_dir, "documents"))


def oracle_sql(templates: Sequence[tuple[str, str]] = TEMPLATES,
               min_dice: float = MIN_DICE) -> str:
    """The same in DuckDB: units as rows, joined to templates by size."""
    values = ", ".join("('" + k.replace("'", "''") + "', '"
                       + t.replace("'", "''") + "')" for k, t in templates)
    low, high = min_dice / (2 - min_dice), (2 - min_dice) / min_dice
    norm = ("regexp_replace(lower(coalesce(text, '')), "
            "'[^\\p{L}\\p{N}\\n]+', ' ', 'g')")
    wordy = "list_filter(string_split_regex({}, '[ \\n]'), lambda w: w <> '')"
    grams = ("list_transform(range(1, greatest(len(w), 1)), "
             "lambda i: w[i] || ' ' || w[i + 1])")
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {norm} AS t FROM documents),
units AS (
  SELECT DISTINCT r, {wordy.format('u')} AS w FROM (
    SELECT r, unnest(string_split(t, chr(10))) AS u FROM docs
    UNION ALL SELECT r, unnest(string_split_regex(t, '\\n ?\\n')) FROM docs
    UNION ALL SELECT r, t FROM docs)),
sized AS (SELECT r, {grams} AS g FROM units WHERE len(w) > 1),
known AS (
  SELECT id, {grams} AS g FROM (
    SELECT id, {wordy.format(norm)} AS w
    FROM (VALUES {values}) v(id, text))),
scored AS (
  SELECT s.r, k.id, 2.0::DOUBLE * list_sum(list_transform(
      list_distinct(list_intersect(s.g, k.g)),
      lambda x: least(len(list_filter(s.g, lambda y: y = x)),
                 len(list_filter(k.g, lambda y: y = x)))))
    / (len(s.g) + len(k.g)) AS d
  FROM sized s JOIN known k
    ON len(s.g) BETWEEN len(k.g) * {low!r} AND len(k.g) * {high!r}
  WHERE list_has_any(s.g, k.g)),
found AS (SELECT * FROM scored WHERE d >= {min_dice!r}),
per_row AS (
  SELECT r, string_agg(DISTINCT id, ',' ORDER BY id) AS licenses,
    min({{'d': -d, 'id': id}}) AS best, count(*) AS n FROM found GROUP BY r)
SELECT doc_id, coalesce(licenses, '') AS licenses,
  best.id AS best_license, -best.d AS best_dice,
  coalesce(n, 0)::BIGINT AS n_matches
FROM docs LEFT JOIN per_row USING (r)"""

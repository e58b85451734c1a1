"""License scan by diagonal voting, in DataFrame operations only.

1. Texts become words; where the words of a phrase stand consecutively is the base result.
2. All rolling runs of ``GRAM`` words are joined with their positions in the templates by hash and
   text, so every vote is a true match. The templates are fixed and few, hence broadcast.
3. Votes are added up by document, template and diagonal (position in the document less position
   in the template); only votes leave the scan.
4. Diagonals at most ``NEIGHBOUR`` apart become one span: inserted or missing words move the
   diagonal. A span is verified by the share of the template's positions that it holds.
5. Of each template the best span of at least ``MIN_SHARE`` stays and gives its label.

The score is 1 where a phrase stands, else the greatest share of a span that stays, else 0.

Defined results: a null text is empty and has no words; texts of any length are taken whole;
repeated rows get the same result each; a row without doc_id has a result of its own; of equally
good spans of one template the first is reported; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.llm.common import materialize, table

#: Words in a run, largest step between diagonals of a span, least share of a template.
GRAM, NEIGHBOUR, MIN_SHARE = 4, 4, 0.6
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases and the labels that they give.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Notices of well-known licenses, as published, and their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SEPARATORS), lambda w: w != "")


def grams_of(words: Column) -> Column:
    """All runs of GRAM words in order, joined by one space; the n-th starts at word n."""
    run = lambda i: F.concat_ws(" ", *(F.get(words, i + k) for k in range(GRAM)))
    return F.when(F.size(words) >= GRAM, F.transform(F.sequence(F.lit(0), F.size(words) - GRAM), run)).otherwise(F.array().cast("array<string>"))


def places_of(words: Column, phrase: str) -> Column:
    """Words from 0 at which a phrase starts; long texts without one of its words are passed over."""
    own = phrase.split()
    here = lambda i: reduce(Column.__and__, (F.get(words, i + k) == w for k, w in enumerate(own)))
    may = reduce(Column.__and__, (F.array_contains(words, w) for w in own)) & (F.size(words) >= len(own))
    return F.when(may, F.filter(F.sequence(F.lit(0), F.size(words) - len(own)), here)).otherwise(F.array().cast("array<int>"))


def template_grams(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """template, label, share (of one position), place, gram and its hash."""
    fixed = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("notice")) for i, (label, text) in enumerate(templates)))
    rows = spark.range(1).select(F.inline(fixed)).select("template", "label", grams_of(words_of(F.col("notice"))).alias("grams"))
    rows = rows.select("template", "label", F.size("grams").alias("of"), F.posexplode("grams").alias("place", "gram"))
    return rows.withColumn("gram_hash", F.xxhash64("gram"))


def _labels(of: list[tuple[str, Column]]) -> Column:
    """Sorted distinct labels whose condition holds."""
    return F.array_sort(F.array_distinct(F.filter(F.array(*(F.when(holds, F.lit(label)) for label, holds in of)), lambda x: x.isNotNull())))


def license_spans(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES) -> DataFrame:
    """For each row of docs(doc_id, text): n_words, the base columns, the base labels as an array,
    and spans: the best span of each template as (label, first_word, n_words, share)."""
    spark = docs.sparkSession
    known = F.broadcast(template_grams(spark, templates))  # as many rows as the fixed notices have words
    read = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words"))
    placed = read.select("row", "doc_id", "words", *(places_of(F.col("words"), p).alias(f"at_{i}") for i, (p, _) in enumerate(phrases)))
    starts = F.concat(*(F.col(f"at_{i}") for i in range(len(phrases))))
    based = placed.select(
        "row",
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        sum((F.size(f"at_{i}") for i in range(len(phrases))), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        _labels([(label, F.size(f"at_{i}") > 0) for i, (_, label) in enumerate(phrases)]).alias("base_labels"),
        grams_of(F.col("words")).alias("grams"),
    )
    # One row for the document itself, at 0, and one for each run.
    own = F.concat(F.array(F.lit(None).cast("string")), F.col("grams"))
    runs = based.select(*(c for c in based.columns if c != "grams"), F.posexplode(own).alias("at", "gram")).withColumn("gram_hash", F.xxhash64("gram"))
    found = runs.join(known, ["gram_hash", "gram"], "left").where("at = 0 or template is not null").drop("gram_hash", "gram")
    cells = materialize(found, "licenses")

    votes = cells.where("at > 0").groupBy("row", "template", "label", "of", (F.col("at") - 1 - F.col("place")).alias("diagonal"))
    votes = votes.agg(F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last"))
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(line) > NEIGHBOUR
    spans = votes.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("span", F.sum("apart").over(line))
    spans = spans.groupBy("row", "template", "label", "of", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"),
        (F.min("first") - 1).cast("long").alias("first_word"),
        (F.max("last") - F.min("first") + GRAM).cast("long").alias("n_words"),
    )
    verified = spans.withColumn("share", F.col("held") / F.col("of")).where(F.col("share") >= MIN_SHARE)
    best = verified.groupBy("row", "template").agg(F.max_by(F.struct("label", "first_word", "n_words", "share"), F.struct("share", -F.col("first_word"))).alias("span"))
    by_row = best.groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    rows = cells.where("at = 0").select("row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    none = F.array().cast("array<struct<label:string,first_word:bigint,n_words:bigint,share:double>>")
    return rows.join(by_row, "row", "left").withColumn("spans", F.coalesce("spans", none)).drop("row")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_spans(table(spark, sf_dir, "documents"))
    labels = F.array_sort(F.array_union("base_labels", F.col("spans.label")))
    share = F.coalesce(F.array_max(F.col("spans.share")), F.lit(0.0))
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(share).alias("score"),
    )


def _sql_words(text: str) -> str:
    lowered = f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"
    return f"[x for x in string_split_regex({lowered}, '{SEPARATORS}') if x <> '']"


_NOTICES = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(TEMPLATES))
_HERE = {label: " and ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(phrase.split())) for phrase, label in PHRASES}
_PLACES = ", ".join(f"[i for i in range(0, len(w)) if {here}] as at_{label}" for label, here in _HERE.items())
_STARTS = " || ".join(f"at_{label}" for label in _HERE)
_RUN = f"array_to_string(w[i + 1:i + {GRAM}], ' ')"

ORACLE = f"""
with docs as (select row_number() over () as row_id, doc_id, {_sql_words("text")} as w from documents),
notices as (
  select template, label, len(w) - {GRAM - 1} as of_, i as place, {_RUN} as gram
  from (select template, label, w, unnest(range(0, len(w) - {GRAM - 1})) as i
        from (select template, label, {_sql_words("notice")} as w from (values {_NOTICES}) t(template, label, notice)))),
based as (
  select row_id, doc_id, len(w) as n_words, {_STARTS} as starts,
    list_sort([x for x in [{", ".join(f"case when len(at_{x}) > 0 then '{x}' end" for x in _HERE)}] if x is not null]) as base_labels
  from (select *, {_PLACES} from docs)),
hits as (
  select row_id, i as pos, template, label, of_, place
  from (select row_id, i, {_RUN} as gram from (select row_id, w, unnest(range(0, len(w) - {GRAM - 1})) as i from docs)) join notices using (gram)),
lines as (
  select *, sum(apart) over (partition by row_id, template order by diagonal) as span
  from (select row_id, template, diagonal,
          case when diagonal - lag(diagonal) over (partition by row_id, template order by diagonal) > {NEIGHBOUR} then 1 else 0 end as apart
        from (select distinct row_id, template, pos - place as diagonal from hits))),
spans as (
  select hits.row_id, label, count(distinct place) / of_ as share
  from hits join lines on hits.row_id = lines.row_id and hits.template = lines.template and hits.pos - hits.place = lines.diagonal
  group by hits.row_id, hits.template, label, of_, span
  having count(distinct place) / of_ >= {MIN_SHARE}),
found as (select row_id, list(label) as labels, max(share) as share from spans group by row_id)
select doc_id, n_words, len(starts) as n_base, list_min(starts) as first_word, list_max(starts) as last_word,
  array_to_string(base_labels, ',') as base_labels,
  array_to_string(list_sort(list_distinct(base_labels || coalesce(labels, []))), ',') as labels,
  case when len(starts) > 0 then 1.0 else coalesce(share, 0.0) end as score
from based left join found using (row_id)
"""

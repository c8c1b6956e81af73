"""License scans by diagonal voting, native.

All rolling word 3-grams of every text are hashed and joined with the 3-grams of the templates and their positions (a template
of two words votes with its one 2-gram). A match of document position p and template position t votes for the diagonal
p - t. Votes are summed by document, template and diagonal; a template stands word for word where its diagonal has all
its votes. Neighbouring diagonals (words put in or left out) are merged, and a span is verified if it has at least COVER of
the template's 3-grams within 1.5 times its length. Base phrases are templates for which only whole places count.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. The templates are constants of this module, some hundred
positions, and so are broadcast. Edge cases: null and empty texts have no words and no labels; repeated rows are scanned
each; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keytide.llm.shared import table

# The base phrases, and the notices of public licenses.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
TEMPLATES = {
    "mit": [
        "released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "apache-2.0": [
        "licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "bsd": [
        "released under the BSD License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "gpl-3.0": [
        "licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "cc-by-nc": ["licensed under CC BY-NC 4.0"],
    "cc-by-sa": ["licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}
K, NEIGHBOUR, COVER = 3, 3, 0.7

_BREAKS = "".join(chr(c) for c in [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), _BREAKS + _UPPER, " " * len(_BREAKS) + _UPPER.lower())
    return F.array_remove(F.split(plain, " "), "")


def _grams(df: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each word of df.words, with the words after it; one row with null words if there is none."""
    n = F.size("words")
    shifted = F.arrays_zip(F.col("words").alias("w1"), F.slice("words", 2, n).alias("w2"), F.slice("words", 3, n).alias("w3"))
    return df.select(*keep, F.posexplode_outer(shifted).alias("pos", "w")).select(*keep, F.coalesce("pos", F.lit(0)).alias("pos"), "w.w1", "w.w2", "w.w3")



def _h(k: int) -> Column:
    return F.when(F.col(f"w{k}").isNotNull(), F.xxhash64(F.lit(k), *(f"w{i}" for i in range(1, k + 1))))


def template_grams(spark: SparkSession) -> tuple[DataFrame, list[str]]:
    """(h, tpl, label, base, t, k, m) of every template's k-grams, and the first words of those of two words."""
    listed = [(label, text, True) for label, text in BASE.items()] + [(label, x, False) for label, texts in TEMPLATES.items() for x in texts]
    texts = F.array(*(F.struct(F.lit(i).alias("tpl"), F.lit(label).alias("label"), F.lit(text).alias("text"), F.lit(base).alias("base")) for i, (label, text, base) in enumerate(listed)))
    rows = spark.range(1, numPartitions=1).select(F.inline(texts))
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("m", F.size("words"))
    grams = _grams(rows, ["tpl", "label", "base", "m"]).withColumn("k", F.least(F.lit(K), "m"))
    grams = grams.withColumn("h", F.when(F.col("k") == 2, _h(2)).otherwise(_h(3))).where("h is not null and pos + k <= m")
    short = [text.lower().split()[0] for _, text, _ in listed if len(text.split()) == 2]
    return grams.select("h", "tpl", "label", "base", F.col("pos").alias("t"), "k", "m"), short


def votes(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, n_words, tpl, label, base, m, k, diag, votes, from_pos, to_pos), and a row without tpl for each document."""
    spark = docs.sparkSession
    grams, short = template_grams(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    rows = _grams(rows, ["rid", "doc_id", "n_words"])
    rows = rows.withColumns({"h3": _h(3), "h2": F.when(F.col("w1").isin(short), _h(2))})
    hit = F.struct("tpl", "label", "base", "t", "k", "m")
    by_h = lambda k: F.broadcast(grams.where(F.col("k") == k).groupBy("h").agg(F.collect_list(hit).alias(f"hits{k}")).withColumnRenamed("h", f"h{k}"))
    rows = rows.join(by_h(3), "h3", "left").join(by_h(2), "h2", "left")
    rows = rows.where("pos = 0 or hits3 is not null or hits2 is not null")
    none = F.array().cast("array<struct<tpl:int,label:string,base:boolean,t:int,k:int,m:int>>")
    hits = F.concat(F.coalesce("hits3", none), F.coalesce("hits2", none), F.when(F.col("pos") == 0, F.array(F.lit(None).cast("struct<tpl:int,label:string,base:boolean,t:int,k:int,m:int>"))).otherwise(none))
    rows = rows.select("rid", "doc_id", "n_words", "pos", F.explode(hits).alias("x")).select("rid", "doc_id", "n_words", "pos", "x.*")
    by = ["rid", "doc_id", "n_words", "tpl", "label", "base", "m", "k"]
    rows = rows.withColumn("diag", F.when(F.col("tpl").isNotNull(), F.col("pos") - F.col("t"))).repartition("rid")
    return rows.groupBy(*by, "diag").agg(F.count("*").alias("votes"), F.min("pos").alias("from_pos"), F.max(F.col("pos") + F.col("k")).alias("to_pos"))


def spans(voted: DataFrame) -> DataFrame:
    """Verified spans of templates, and places of base phrases: (rid, doc_id, n_words, label, base, from_pos, to_pos, score);
    one row without label for each document."""
    order = Window.partitionBy("rid", "tpl").orderBy("diag")
    whole = F.col("votes") == F.col("m") - F.col("k") + 1
    rows = voted.withColumn("fresh", F.coalesce(F.col("base") | (F.col("diag") - F.lag("diag").over(order) > NEIGHBOUR), F.lit(True)).cast("int"))
    rows = rows.withColumn("run", F.sum("fresh").over(order))
    by = ["rid", "doc_id", "n_words", "tpl", "label", "base", "m", "k", "run"]
    rows = rows.groupBy(*by).agg(F.sum("votes").alias("votes"), F.min("from_pos").alias("from_pos"), F.max("to_pos").alias("to_pos"), F.max(whole).alias("whole"))
    share = F.least(F.lit(1.0), F.col("votes") / (F.col("m") - F.col("k") + 1))
    fits = (share >= COVER) & (F.col("to_pos") - F.col("from_pos") <= 1.5 * F.col("m"))
    rows = rows.where(F.col("tpl").isNull() | F.when(F.col("base"), F.col("whole")).otherwise(fits | F.col("whole")))
    return rows.select("rid", "doc_id", "n_words", "label", "base", "from_pos", "to_pos", share.alias("score"))


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document: counts and places of base phrases, labels, score, and the verified spans."""
    rows = spans(votes(docs))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    base = F.col("base")
    return rows.groupBy("rid", "doc_id", "n_words").agg(
        F.count_if(F.coalesce(base, F.lit(False))).alias("n_base"),
        F.min(F.when(base, F.col("from_pos"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("from_pos"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"),
        F.coalesce(F.max(F.when(F.col("label").isNotNull(), F.col("score"))), F.lit(0.0)).alias("score"),
        F.collect_list(F.when(~base, F.struct("label", "from_pos", "to_pos"))).alias("spans"),
    ).drop("rid")


def op9_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")


def _oracle() -> str:
    """The same in DuckDB, with the words themselves in place of hashes."""
    words = lambda text: rf"regexp_extract_all(translate({text}, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    listed = [(label, text, "true") for label, text in BASE.items()] + [(label, x, "false") for label, texts in TEMPLATES.items() for x in texts]
    values = ", ".join(f"({i}, '{label}', {base}, '{text}')" for i, (label, text, base) in enumerate(listed))
    return f"""
WITH tpl AS (SELECT *, {words("txt")} AS w FROM (VALUES {values}) AS v(tpl, label, base, txt)),
tk AS (SELECT *, len(w) AS m, least({K}, len(w)) AS k FROM tpl),
ts AS (SELECT *, unnest(range(0, m - k + 1)) AS t FROM tk),
tg AS (SELECT tpl, label, base, m, k, t, array_to_string(w[t + 1 : t + k], ' ') AS g FROM ts),
d AS (SELECT row_number() OVER () AS rid, doc_id, {words("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT rid, w, unnest(range(0, len(w))) AS pos FROM d),
dg AS (SELECT rid, pos, k, array_to_string(w[pos + 1 : pos + k], ' ') AS g FROM p, (SELECT DISTINCT k FROM tk) WHERE pos + k <= len(w)),
voted AS (SELECT rid, tpl, label, base, m, k, pos - t AS diag, count(*) AS votes, min(pos) AS from_pos, max(pos + k) AS to_pos
          FROM dg JOIN tg USING (k, g) GROUP BY rid, tpl, label, base, m, k, pos - t),
fresh AS (SELECT *, CASE WHEN base OR coalesce(diag - lag(diag) OVER o > {NEIGHBOUR}, true) THEN 1 ELSE 0 END AS f FROM voted WINDOW o AS (PARTITION BY rid, tpl ORDER BY diag)),
runs AS (SELECT *, sum(f) OVER (PARTITION BY rid, tpl ORDER BY diag) AS run FROM fresh),
spans AS (SELECT rid, label, base, m, k, least(1.0, sum(votes) / CAST(m - k + 1 AS DOUBLE)) AS share, min(from_pos) AS a, max(to_pos) AS b, bool_or(votes = m - k + 1) AS whole
          FROM runs GROUP BY rid, tpl, label, base, m, k, run),
good AS (SELECT * FROM spans WHERE whole OR (NOT base AND share >= {COVER} AND b - a <= 1.5 * m))
SELECT d.doc_id, CAST(any_value(len(d.w)) AS BIGINT) AS n_words, count(*) FILTER (WHERE base) AS n_base,
       CAST(min(a) FILTER (WHERE base) AS BIGINT) AS first_word, CAST(max(a) FILTER (WHERE base) AS BIGINT) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE label IS NOT NULL), '') AS labels,
       coalesce(max(share), 0.0) AS score
FROM d LEFT JOIN good USING (rid) GROUP BY rid, d.doc_id
"""


ORACLE = _oracle()

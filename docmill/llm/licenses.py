"""Licence scan: Dice coefficient of normalised texts with licence templates over word bigrams.

Units are the lines of a text, and its blocks of several lines (runs of lines without a blank one).
A unit is lower-cased and its words are runs of letters and digits; bigrams count with repeats. With a
limit t, a template of m bigrams can only match a unit of m * t / (2 - t) to m * (2 - t) / t of them.
Units outside all templates' bounds are left before bigrams are formed; the rest meet only the templates
within their bounds, bigram by bigram, by an inverted list of the templates' bigrams (a fixed table of
under a thousand rows, so it is broadcast). Only DataFrame functions are used.

Notices inside a longer line, or wrapped over several, are found by windows of words at any place of a text.
The best window from a bigram of a template ends at one too, so only the places of a template's bigrams are
kept; of these, a start is left unless enough follow within the template's upper bound. A bigram that a
template has c times counts in a window if the window begins after its c-th last occurrence.

license_matches() lists all windows, also of SHORT notices. scan_licenses() has one row for a row of docs: its
best unit, or its best window where no unit matches. The SQL states the units alone.

Edge cases: a null or empty text has no units, so its license, unit and place are null and its dice is 0.
Among equal coefficients a line wins over a block, then the earlier unit, then the template's name. A
unit of one word has no bigram and matches nothing. Repeated rows are each returned; a null doc_id is
kept. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import table

#: Short notices by which texts name their licence: fixed values.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "proprietary": "Copyright. All rights reserved. No part of this work may be reproduced without written permission.",
}
#: Notices of a few words that name no licence of TEMPLATES whole; for windows only.
SHORT = {"proprietary-short": "All rights reserved."}
LIMIT = 0.75
NOT_WORD = r"[^\p{L}\p{N}]+"
BLOCKS = r"\n(?:[\x20\t\r]*\n)+"


def template_bigrams(templates: dict[str, str] = TEMPLATES) -> list[tuple[str, str, int, int]]:
    """(bigram, template, its number of bigrams, times that the bigram is in it)."""
    out = []
    for name, text in templates.items():
        words = re.findall(r"[^\W_]+", text.lower())
        grams = Counter(f"{a} {b}" for a, b in pairwise(words))
        out += [(g, name, len(words) - 1, c) for g, c in sorted(grams.items())]
    return out


def windows_of(rows: DataFrame, templates: dict[str, str], limit: float) -> DataFrame:
    """d, dh, license, dice, first (number of the first word, from 0) and words of each match in rows (doc_id, h, text).

    Of windows of one licence that overlap, the one of the largest dice stays, then the earliest.
    """
    inverted = F.broadcast(rows.sparkSession.createDataFrame(template_bigrams(templates), "gram string, license string, m int, times int"))
    share = limit / (2 - limit)
    least, most = F.ceil(F.col("m") * share - 1e-9).cast("int"), F.floor(F.col("m") / share + 1e-9).cast("int")
    words = rows.select("doc_id", "h", "r", F.filter(F.split(F.lower("text"), NOT_WORD), lambda w: w != "").alias("w")).withColumn("n", F.size("w") - 1).filter("n > 0")
    grams = F.zip_with(F.slice("w", F.lit(1), F.col("n")), F.slice("w", F.lit(2), F.col("n")), lambda a, b: F.concat_ws(" ", a, b))
    met = words.select("doc_id", "h", "r", F.posexplode(grams).alias("pos", "gram")).join(inverted, "gram")
    spots = met.groupBy("doc_id", "h", "r", "license", "m", "gram", "times").agg(F.sort_array(F.collect_list("pos")).alias("p"))
    # full: the place of the gram's occurrence after which one more counts
    marked = F.transform("p", lambda x, i: F.struct(x.alias("pos"), F.when(i >= F.col("times"), F.get("p", i - F.col("times"))).otherwise(F.lit(-1)).alias("full")))
    hits = spots.select("doc_id", "h", "r", "license", "m", marked.alias("hits")).groupBy("doc_id", "h", "r", "license", "m").agg(F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"))
    dense = F.filter(F.transform("hits", lambda x, i: F.struct((i + 1).alias("at"), x["pos"].alias("pos"), F.get("hits", i + least - 1)["pos"].alias("needed"))), lambda x: x["needed"] - x["pos"] < most)
    starts = hits.withColumn("starts", dense).filter(F.size("starts") > 0)

    def best(start):
        none = F.struct(F.lit(0).alias("both"), F.lit(0.0).alias("dice"), F.lit(0).alias("n"))

        def step(s, x):
            n, both = x["pos"] - start["pos"] + 1, s["both"] + (x["full"] < start["pos"]).cast("int")
            dice = 2 * both / (n + F.col("m"))
            more = (n >= least) & (n <= most) & (dice > s["dice"])
            return F.struct(both.alias("both"), F.when(more, dice).otherwise(s["dice"]).alias("dice"), F.when(more, n).otherwise(s["n"]).alias("n"))

        found = F.aggregate(F.slice("hits", start["at"], most), none, step)
        return F.struct((-found["dice"]).alias("minus"), start["pos"].alias("pos"), found["n"].alias("n"))

    fit = starts.select("doc_id", "h", "license", F.sort_array(F.filter(F.transform("starts", best), lambda x: -x["minus"] >= limit)).alias("fit"))
    apart = lambda x, y: (x["pos"] > y["pos"] + y["n"]) | (y["pos"] > x["pos"] + x["n"])
    kept = F.aggregate("fit", F.slice("fit", 1, 0), lambda s, x: F.when(F.forall(s, lambda y: apart(x, y)), F.concat(s, F.array(x))).otherwise(s))
    each = fit.select("doc_id", "h", "license", F.explode(kept).alias("x"))
    return each.select(F.col("doc_id").alias("d"), F.col("h").alias("dh"), "license", (-F.col("x.minus")).alias("dice"), F.col("x.pos").alias("first"), (F.col("x.n") + 1).alias("words")).distinct()


def rows_of(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # rows of equal doc_id and text have equal results, so a hash of the text tells the rows of a doc_id apart; their
    # bigrams are counted by row, though, so r numbers the rows (and is never compared between two scans)
    return docs.select("doc_id", F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("r"), text.alias("text"))


def license_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES | SHORT, limit: float = LIMIT) -> DataFrame:
    """doc_id, license, dice, first (number of the first word, from 0) and words of each match; rows of equal doc_id and text count once."""
    return windows_of(rows_of(docs), templates, limit).withColumnRenamed("d", "doc_id").drop("dh")


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, limit: float = LIMIT) -> DataFrame:
    """doc_id, license, dice, unit (line, block or window) and place (its number, from 0; of a window, its first word's) of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    table_ = template_bigrams(templates)
    inverted = F.broadcast(spark.createDataFrame(table_, "gram string, license string, m int, times int"))
    share = limit / (2 - limit)
    low, high = min(m for *_, m, _ in table_) * share, max(m for *_, m, _ in table_) / share

    rows = rows_of(docs)
    units = F.concat(
        F.transform(F.split("text", "\n"), lambda u, i: F.struct(F.lit("line").alias("unit"), i.alias("place"), u.alias("s"))),
        F.filter(F.transform(F.split("text", BLOCKS), lambda u, i: F.struct(F.lit("block").alias("unit"), i.alias("place"), u.alias("s"))), lambda u: F.instr(u["s"], "\n") > 0),
    )
    each = rows.select("doc_id", "h", "r", F.explode(units).alias("u")).select("doc_id", "h", "r", "u.unit", "u.place", F.filter(F.split(F.lower("u.s"), NOT_WORD), lambda w: w != "").alias("w"))
    fitting = each.withColumn("n", F.size("w") - 1).filter(F.col("n").between(max(1, low), high))
    # two words side by side; a filter on the template's bounds follows at once, before anything is shuffled
    grams = F.zip_with(F.slice("w", F.lit(1), F.col("n")), F.slice("w", F.lit(2), F.col("n")), lambda a, b: F.concat_ws(" ", a, b))
    met = fitting.select("doc_id", "h", "r", "unit", "place", "n", F.explode(grams).alias("gram")).join(inverted, "gram").filter((F.col("n") >= F.col("m") * share) & (F.col("n") * share <= F.col("m")))
    both = met.groupBy("doc_id", "h", "r", "unit", "place", "n", "license", "m", "gram", "times").agg(F.count("*").alias("c")).groupBy("doc_id", "h", "r", "unit", "place", "n", "license", "m").agg(F.sum(F.least("c", F.col("times").cast("long"))).alias("both"))
    scored = both.withColumn("dice", 2 * F.col("both") / (F.col("n") + F.col("m"))).filter(F.col("dice") >= limit)
    windows = windows_of(rows, templates, limit).select(F.col("d").alias("doc_id"), F.col("dh").alias("h"), F.lit("window").alias("unit"), F.col("first").alias("place"), "license", "dice")
    both = scored.select("doc_id", "h", "unit", "place", "license", "dice").unionByName(windows)
    best = both.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("dh")).agg(F.min(F.struct((F.col("unit") == "window").alias("window"), (-F.col("dice")).alias("minus"), (F.col("unit") == "block").alias("block"), "place", "license", "unit")).alias("b"))
    found = rows.select("doc_id", "h").join(best, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("dh")), "left")
    return found.select("doc_id", F.col("b.license").alias("license"), F.coalesce(-F.col("b.minus"), F.lit(0.0)).alias("dice"), F.col("b.unit").alias("unit"), F.col("b.place").cast("int").alias("place"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_license_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    values = ", ".join(f"('{g}', '{name}', {m}, {times})" for g, name, m, times in template_bigrams())
    share = LIMIT / (2 - LIMIT)
    return rf"""
WITH t(gram, license, m, times) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, string_split(text, chr(10)) AS a FROM d),
k AS (SELECT r, regexp_split_to_array(text, '\n(?:[\x20\t\r]*\n)+') AS a FROM d),
u AS (SELECT r, 'line' AS unit, unnest(range(len(a))) AS place, unnest(a) AS s FROM l
  UNION ALL SELECT * FROM (SELECT r, 'block' AS unit, unnest(range(len(a))) AS place, unnest(a) AS s FROM k) WHERE contains(s, chr(10))),
w AS (SELECT r, unit, place, list_filter(regexp_split_to_array(lower(s), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM u),
g AS (SELECT r, unit, place, len(w) - 1 AS n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM w WHERE len(w) BETWEEN 2 AND 400),
b AS (SELECT r, unit, place, n, license, m, least(count(*), any_value(times)) AS c FROM g JOIN t USING (gram) WHERE n >= m * {share!r} AND n * {share!r} <= m GROUP BY r, unit, place, n, license, m, gram),
s AS (SELECT r, unit, place, license, CAST(2 * CAST(sum(c) AS BIGINT) AS DOUBLE) / CAST(n + m AS DOUBLE) AS dice FROM b GROUP BY r, unit, place, n, license, m),
x AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY dice DESC, unit = 'block', place, license) AS k FROM s WHERE dice >= {LIMIT})
SELECT d.doc_id, x.license, coalesce(x.dice, 0.0) AS dice, x.unit, CAST(x.place AS INTEGER) AS place FROM d LEFT JOIN x ON d.r = x.r AND x.k = 1
"""


OP2_SQL = _oracle()

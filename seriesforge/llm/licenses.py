"""Licence scan with DataFrame functions only.

Header lines are the lines of a text that hold one of ``GATE``'s words.  A header
line and a licence template are sparse vectors of their words, weighted by count
times ``ln((1 + templates) / (1 + templates with the word)) + 1``; a file's own
licence is that of the template of largest cosine over all its header lines, from
``LEAST`` on.  A file whose name is ``LICENSE``, ``LICENCE``, ``COPYING`` or
``NOTICE`` (with any extension) speaks for its directory.  A file without a licence
of its own inherits from the nearest directory above it that has one, found by
joining its ancestor paths with the directories that licence files speak for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm._spark import Scratch

LEAST = 0.6
GATE = "licen[cs]|copyright|copyleft|permission|warrant|rights reserved|redistribut|public domain|released under|spdx"
FILE_NAME = r"(^|/)(LICENSE|LICENCE|COPYING|NOTICE)(\.[A-Za-z]+)?$"

# Licence notices by identifier.
TEMPLATES = [
    ("AGPL-3.0", "licensed under the GNU Affero General Public License version 3"),
    ("All-Rights-Reserved", "all rights reserved"),
    ("Apache-2.0", "licensed under the Apache License version 2.0"),
    ("Apache-2.0", "licensed under the Apache License Version 2.0 the License you may not use this file except in compliance with the License"),
    ("BSD-2-Clause", "released under the BSD 2 clause license"),
    ("BSD-3-Clause", "released under the BSD 3 clause license"),
    ("BSD-3-Clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSL-1.0", "distributed under the Boost Software License version 1.0"),
    ("CC-BY-4.0", "licensed under CC BY 4.0"),
    ("CC-BY-4.0", "this work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "licensed under CC BY NC 4.0"),
    ("CC-BY-NC-4.0", "this work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "licensed under CC BY SA 4.0"),
    ("CC0-1.0", "dedicated to the public domain under CC0 1.0 Universal"),
    ("EPL-2.0", "made available under the Eclipse Public License version 2.0"),
    ("GPL-2.0", "this work is licensed under the GNU General Public License version 2"),
    ("GPL-3.0", "this work is licensed under the GNU General Public License version 3"),
    ("ISC", "released under the ISC license"),
    ("LGPL-2.1", "licensed under the GNU Lesser General Public License version 2.1"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License version 3"),
    ("MIT", "released under the MIT License"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License version 2.0"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("Zlib", "released under the zlib license"),
    ("AGPL-3.0", "SPDX License Identifier AGPL 3.0"),
    ("Apache-2.0", "SPDX License Identifier Apache 2.0"),
    ("BSD-2-Clause", "SPDX License Identifier BSD 2 Clause"),
    ("BSD-3-Clause", "SPDX License Identifier BSD 3 Clause"),
    ("GPL-2.0", "SPDX License Identifier GPL 2.0"),
    ("GPL-3.0", "SPDX License Identifier GPL 3.0"),
    ("ISC", "SPDX License Identifier ISC"),
    ("MIT", "SPDX License Identifier MIT"),
    ("MPL-2.0", "SPDX License Identifier MPL 2.0"),
]


def _words(c):
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def _vectors(rows: DataFrame, key: list[str], text: str, idf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weights ``(key, word, w)`` and norms ``(key, norm)`` of texts; words that no template has weigh most."""
    terms = rows.select(*key, F.explode(_words(F.col(text))).alias("word")).groupBy(*key, "word").agg(F.count("*").alias("tf"))
    most = F.log(F.lit(1.0 + len(TEMPLATES))) + 1.0
    w = terms.join(F.broadcast(idf), "word", "left").select(*key, "word", (F.col("tf") * F.coalesce("idf", most)).alias("w"))
    return w, w.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def scan(files: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """``files(path, text, ...)`` with the text replaced by own_license, own_score, license and license_dir.

    own_* come from the file's lines; license is the own one or that of the
    nearest directory with a licence file (license_dir; null for an own licence).  Null and empty
    texts have no header lines; a null path has neither directory nor name and so
    inherits nothing; repeated rows are alike; of several licence files in a directory the
    best match speaks, ties going to the smaller identifier; columns of the result's names are replaced.
    """
    spark = files.sparkSession
    templates = templates or TEMPLATES
    added = ("own_license", "own_score", "license", "license_dir")
    files = files.drop(*added).withColumn("_row", F.xxhash64("path", "text"))
    t = spark.createDataFrame([(i, n, x) for i, (n, x) in enumerate(templates)], "t int, name string, notice string")
    word = t.select("t", F.explode(_words(F.col("notice"))).alias("word"))
    idf = word.groupBy("word").agg((F.log((1.0 + len(templates)) / (1.0 + F.count_distinct("t"))) + 1.0).alias("idf"))
    tw, tn = _vectors(t, ["t"], "notice", idf)
    known = tw.join(tn, "t").join(t.select("t", "name"), "t").select("word", "t", "name", (F.col("w") / F.col("norm")).alias("tw"))
    scratch = Scratch(spark, "licenses")
    # few lines are headers: once written, texts are not read for them again
    headers = files.select("_row", F.explode(F.array_distinct(F.filter(F.split("text", "\n"), lambda x: F.lower(x).rlike(GATE)))).alias("line")).distinct()
    headers = scratch.keep("headers", headers)
    hw, hn = _vectors(headers, ["_row", "line"], "line", idf)
    cosine = (
        hw.join(F.broadcast(known), "word").groupBy("_row", "line", "t", "name").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
        .join(hn, ["_row", "line"]).select("_row", "name", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= least)
    )
    own = cosine.groupBy("_row").agg(F.min(F.struct((-F.col("score")).alias("m"), "name")).alias("best")).select("_row", F.col("best.name").alias("own_license"), (-F.col("best.m")).alias("own_score"))
    files = scratch.keep("files", files.drop("text").join(own, "_row", "left"))
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    speaking = (
        files.where(F.col("own_license").isNotNull() & F.col("path").rlike(FILE_NAME))
        .groupBy(directory.alias("license_dir")).agg(F.min(F.struct((-F.col("own_score")).alias("m"), "own_license")).alias("best")).select("license_dir", F.col("best.own_license").alias("found"))
    )
    parts = F.split(directory, "/")
    # each path without a licence and the directories above it, from the root ''
    bare = files.where(F.col("own_license").isNull() & F.col("path").isNotNull()).select("path").distinct()
    above = bare.select("path", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("depth", "license_dir"))
    # every path lies below the root, whose licence is one row and joined apart
    root = F.broadcast(speaking.where("license_dir = ''").select(F.lit("").alias("_root"), F.col("found").alias("_top")))
    speaking = speaking.where("license_dir <> ''")
    nearest = (
        above.where("license_dir <> ''").join(speaking, "license_dir").groupBy("path").agg(F.max(F.struct("depth", "license_dir", "found")).alias("x"))
        .select("path", F.col("x.license_dir").alias("license_dir"), F.col("x.found").alias("found"))
    )
    out = files.join(nearest, "path", "left").withColumn("_root", F.when(F.col("path").isNotNull(), F.lit(""))).join(root, "_root", "left")
    out = out.withColumn("license_dir", F.coalesce("license_dir", F.when(F.col("_top").isNotNull(), F.lit("")))).withColumn("found", F.coalesce("found", "_top"))
    inherits = F.col("own_license").isNull()
    return out.select(
        *[c for c in files.columns if c not in ("_row", *added)], "own_license", "own_score",
        F.coalesce("own_license", "found").alias("license"), F.when(inherits, F.col("license_dir")).alias("license_dir"),
    )


def oracle_sql(files: str) -> str:
    """DuckDB SQL of ``scan`` over ``files``, a query of doc_id, path, text."""
    values = ", ".join(f"({i}, '{n}', '{x}')" for i, (n, x) in enumerate(TEMPLATES))
    n = len(TEMPLATES)
    return f"""
    WITH files AS ({files}),
    t(t, name, notice) AS (VALUES {values}),
    word AS (SELECT t, unnest(regexp_extract_all(lower(notice), '[a-z0-9]+')) AS word FROM t),
    idf AS (SELECT word, ln((1.0 + {n}) / (1.0 + count(DISTINCT t))) + 1.0 AS idf FROM word GROUP BY word),
    tw AS (SELECT t, word, count(*) * any_value(idf) AS w FROM word JOIN idf USING (word) GROUP BY t, word),
    tn AS (SELECT t, sqrt(sum(w * w)) AS norm FROM tw GROUP BY t),
    lines AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM files) WHERE regexp_matches(lower(line), '{GATE}')),
    terms AS (SELECT doc_id, line, word, count(*) AS tf FROM (SELECT doc_id, line, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS word FROM lines) GROUP BY ALL),
    hw AS (SELECT doc_id, line, word, tf * coalesce(idf, ln(1.0 + {n}) + 1.0) AS w FROM terms LEFT JOIN idf USING (word)),
    hn AS (SELECT doc_id, line, sqrt(sum(w * w)) AS norm FROM hw GROUP BY doc_id, line),
    dots AS (SELECT doc_id, line, t, sum(hw.w * tw.w) AS dot FROM hw JOIN tw USING (word) GROUP BY doc_id, line, t),
    cosine AS (SELECT doc_id, name, round(dot / hn.norm / tn.norm, 6) AS score FROM dots JOIN hn USING (doc_id, line) JOIN tn USING (t) JOIN t USING (t)),
    own AS (SELECT doc_id, name AS own_license, score AS own_score FROM cosine WHERE score >= {LEAST} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, name) = 1),
    f AS (SELECT files.doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, own_license, own_score FROM files LEFT JOIN own USING (doc_id)),
    speaking AS (SELECT dir AS license_dir, own_license AS found FROM f WHERE own_license IS NOT NULL AND regexp_matches(path, '{FILE_NAME}')
                 QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, own_license) = 1),
    near AS (SELECT doc_id, license_dir, found FROM f JOIN speaking ON license_dir = '' OR dir = license_dir OR starts_with(dir, license_dir || '/') WHERE own_license IS NULL
             QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(license_dir) DESC) = 1)
    SELECT f.doc_id, path, own_license, own_score, coalesce(own_license, found) AS license, license_dir FROM f LEFT JOIN near USING (doc_id)
    """

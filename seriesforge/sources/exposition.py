"""Text lines ``metric{label="value",...} time value`` as samples, by string functions only.

Fields are cut at the first two spaces; labels at every comma, key and value at
the first ``=``; values are quoted, without escapes.  Blank lines and lines that
start with ``#`` are skipped.  An explicit ``__name__`` overrides the metric, and
of repeated labels the last counts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.functions.labels import NAME_LABEL, label_key

#: A key with the white space around it, and a value in quotes.
_KEY, _VALUE = r"\s*[^=,\s][^=,]*", r'"[^,\n]*"'


def _last_of_each(entries: Column) -> Column:
    """Entries of an array of (key, value) without those that a later one of the same key overrides."""
    indexed = F.transform(entries, lambda e, i: F.struct(i.alias("i"), e["key"].alias("key"), e["value"].alias("value")))
    return F.transform(
        F.filter(indexed, lambda e: ~F.exists(indexed, lambda f: (f["key"] == e["key"]) & (f["i"] > e["i"]))), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))
    )


def parse_lines(lines: DataFrame, strict: bool = False) -> DataFrame:
    """``lines(line, ...)`` with labels, ts_ms, value and error (null where the line is good).

    strict makes the query fail at the first bad line; else bad lines have an
    error and no sample.
    """
    # java's trim takes all control characters and spaces
    line = F.regexp_replace("line", r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    df = lines.withColumn("_line", line).where((F.col("_line") != "") & ~F.col("_line").startswith("#"))
    text = F.col("_line")
    df = df.withColumn("_head", F.substring_index(text, " ", 1)).withColumn("_parts", F.split(text, " ", 3))
    head, parts = F.col("_head"), F.col("_parts")
    open_at = F.instr(head, "{")
    close = F.length(head) - F.instr(F.reverse(head), "}") + 1
    closed = (F.instr(head, "}") > 0) & (close > open_at)
    inner = F.when((open_at > 0) & closed, F.expr("substring(_head, instr(_head, '{') + 1, length(_head) - instr(reverse(_head), '}') - instr(_head, '{'))"))
    df = df.withColumn("_inner", F.coalesce(F.regexp_replace(inner, ",+$", ""), F.lit("")))
    metric = F.when(open_at > 0, F.substring_index(head, "{", 1)).otherwise(head)
    # each piece between commas is a key that is not blank, =, and a value in quotes
    good = F.col("_inner").rlike(rf"\A(?:{_KEY}={_VALUE}(?:,(?!\z)|\z))*\z") | (F.trim("_inner") == "")
    keys = F.regexp_extract_all("_inner", F.lit(rf"(?:\A|,)\s*({_KEY[3:]}?)\s*=\""), F.lit(1))
    values = F.regexp_extract_all("_inner", F.lit(rf"(?:\A|,){_KEY}=\"([^,\n]*)\"(?=,|\z)"), F.lit(1))
    df = df.withColumn("_keys", F.array_insert(keys, 1, F.lit(NAME_LABEL))).withColumn("_values", F.array_insert(values, 1, metric))
    ts = F.expr("try_cast(_parts[1] as bigint)")
    value = F.expr("try_cast(trim(_parts[2]) as double)")
    df = df.withColumn("ts_ms", F.when(F.size(parts) == 3, ts)).withColumn("value", F.when(F.size(parts) == 3, value))
    error = (
        F.when(F.size(parts) < 3, "missing field").when(metric == "", "empty metric").when((open_at > 0) & ~closed, "unclosed labels").when(~good, "bad label")
        .when(F.col("ts_ms").isNull(), "bad time").when(F.col("value").isNull(), "bad value")
    )
    df = df.withColumn("error", error)
    if strict:
        df = df.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.col("error"), F.lit(": "), text)).cast("string")))
    once = F.size(F.array_distinct("_keys")) == F.size("_keys")
    labels = F.when(once, F.map_from_arrays("_keys", "_values")).otherwise(F.map_from_entries(_last_of_each(F.arrays_zip(F.col("_keys").alias("key"), F.col("_values").alias("value")))))
    df = df.withColumn("labels", F.when(F.col("error").isNull(), labels))
    return df.drop("_line", "_head", "_parts", "_inner", "_keys", "_values")


def parse_body(spark: SparkSession, body: str, strict: bool = True) -> DataFrame:
    """Samples of one request body, numbered by line (seq); any bad line fails it all."""
    rows = [(i, x) for i, x in enumerate(re.split("\r\n|[\n\x0b\x0c\r\x85\u2028\u2029]", body))]
    return parse_lines(spark.createDataFrame(rows, "seq long, line string"), strict)


def read_text(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return parse_lines(reader.text(path).withColumnRenamed("value", "line")).withColumn("label_key", label_key(F.col("labels")))

"""A corpus pipeline: quality, recurring lines, near duplicates, benchmark leaks, tokens."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm import decontaminate, jaccard, lines, pieces, quality
from seriesforge.llm._spark import Scratch, table
from seriesforge.llm.registry import fit_quality

#: Documents below this quality score go.
LEAST_QUALITY = 0.3
#: A document of which more than this share of tokens recurs line by line is a copy: near duplicates are found later, on whole texts.
LEAVE_COPIES = 0.5


#: Columns of documents; others are carried along as one, so that no stage's own columns meet them.
BASE = ("doc_id", "text", "lang", "source", "n_chars")


def _carried(stage):
    """A stage that returns all columns of its documents, whatever their names."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        base, more = [c for c in docs.columns if c in BASE], [c for c in docs.columns if c not in BASE]
        if not more:
            return stage(spark, docs, sf_dir)
        packed = docs.select(*base, F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(more)]).alias("_carried"))
        place = {c: F.col(f"_carried.c{i}").alias(c) for i, c in enumerate(more)}
        return stage(spark, packed, sf_dir).select(*[place.get(c, F.col(f"`{c}`")) for c in docs.columns])

    return run_stage


@_carried
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null text is scored as an empty one; null ids and repeated rows are scored by their texts; an empty table gives none.
    """
    scored = quality.score(docs, fit_quality(spark, sf_dir, docs))
    return scored.where(F.col("score") >= LEAST_QUALITY).select(docs.columns)


def _with_length(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of a rewriting without those left blank by it, their n_chars counted anew, with the columns of docs."""
    changed = (F.col("n_dropped") > 0) | (F.col("n_cut") > 0)
    length = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.where(~F.coalesce(changed & (F.trim("text") == ""), F.lit(False))).withColumn("n_chars", length).select(docs.columns)


@_carried
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all documents but one, except from copies, which the next stage handles; a document of which only blanks are left goes too.

    Null texts and ids stay; repeated rows are alike; an empty table gives none.
    """
    return _with_length(lines.drop_recurring_lines(docs, leave=LEAVE_COPIES), docs)


@_carried
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one of smallest doc_id stays; passages that those left share go from all but one, and documents left blank go.

    Null and blank texts and null ids are linked with nothing and stay; repeated rows of an id stay or go together.
    """
    gone = jaccard.jaccard_classes(docs, w=5, percent=75).where("doc_id <> component_id").select("doc_id").distinct()
    return _with_length(lines.drop_repeated_passages(docs.join(gone, "doc_id", "left_anti").select(docs.columns)), docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go; null and empty texts leak none, and all columns and repeated rows stay as they are."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their sampled tokens (little-endian int32), and whether decoding gives the text back.

    A null text has null tokens and counts none; rows of one id and text have the same tokens; other columns end here.
    """
    both = pieces.round_trip(docs.select("doc_id", "lang", "source", "text"), "doc_id")
    n = F.coalesce(F.octet_length("tokens") / 4, F.lit(0)).cast("long")
    return both.select("doc_id", "lang", "source", n.alias("n_tokens"), "tokens", "lossless")


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", token_stage),
]

#: Compression, sampled segmentation and trained scores have no SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and reread by the next, and dropped once that is written."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(name, stage(spark, docs, sf_dir))
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs

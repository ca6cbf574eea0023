"""Queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm import decontaminate, html, langid, licenses, lines, neighbours, pieces, pii, quality
from seriesforge.llm._spark import table
from seriesforge.llm.jaccard import jaccard_classes


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentation of all documents: how many tokens, their digest, and whether decoding gives the text back."""
    both = pieces.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    n = F.coalesce(F.octet_length("tokens") / 4, F.lit(0)).cast("long")
    return both.select("doc_id", n.alias("n_tokens"), F.sha2("tokens", 256).alias("tokens_sha256"), "lossless")


def fold(key: str, n: int):
    """crc32 of a key as text, modulo n; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % n


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and digest of the base spans, all spans, and how many of them the model added."""
    found = pii.pii_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans", "n_added")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those whose fold modulo 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold("doc_id", 3) != 1).select(F.col("doc_id").alias("key"), "text", "lang"))
    rows = docs.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "text")
    return langid.identify(rows, model)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training texts of the quality classifier: labelled documents whose fold modulo 5 is not 0."""
    labels = table(spark, sf_dir, "labels").where((fold("doc_id", 5) != 0) & F.col("quality").isNotNull())
    return labels.select("doc_id", F.col("quality").alias("label"))


def fit_quality(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality.Model:
    return quality.fit(labelled(spark, sf_dir), docs.select("doc_id", "text"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents, learned from those whose fold modulo 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text")
    scored = quality.score(rows, fit_quality(spark, sf_dir, docs))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents leak, with the covered share of the item and the agreement of slots."""
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), F.round("agreement", 6).alias("agreement"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without recurring lines and repeated passages: how many lines they had, how many went, and the digest of what is left."""
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", "n_cut", F.sha2("text", 256).alias("text_sha256"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows found for each embedding whose id is divisible by 100, against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where("vec_id % 100 = 0"), k=10)


#: Documents as files: a directory for each hundred ids below source and language, of which the first is its licence
#: file; the first of each thousand ids is that of the directory above.
FILE_PATH = (
    "concat(coalesce(source, '-'), '/', coalesce(lang, '-'), '/', case when doc_id % 1000 = 0 then 'LICENSE' "
    "when doc_id % 100 = 0 then concat('d', cast(doc_id - doc_id % 100 as string), '/LICENSE') "
    "else concat('d', cast(doc_id - doc_id % 100 as string), '/', cast(doc_id as string), '.txt') end)"
)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, own and inherited from the nearest directory with a licence file."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.expr(FILE_PATH).alias("path"), "text")
    return licenses.scan(files)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: five-word shingles, similarity of 0.75 or more."""
    return jaccard_classes(table(spark, sf_dir, "documents"), w=5, percent=75)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_pieces": op2_pieces,
    "op3_decontaminate": op3_decontaminate,
    "op4_language": op4_language,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality": op6_quality,
    "op7_main_text": op7_main_text,
    "op8_neighbours": op8_neighbours,
    "op9_licenses": op9_licenses,
    "op10_jaccard_join": op10_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {
    "op9_licenses": licenses.oracle_sql(f"SELECT doc_id, {FILE_PATH} AS path, text FROM documents"),
}

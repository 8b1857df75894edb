"""The queries of this subpackage: one thin ``opN_<name>`` for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, html_text, jaccard_join, license_scan, line_dedup, mixing, pii, prefix_trie, quality_fm, spelling, sql, topk, warc_fixity

#: Rows of this remainder are never learned from.
HELD_OUT = "crc32(cast(id as string)) % 3 = 1"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_fm.fit(docs, _table(spark, sf_dir, "labels"), train=f"not ({HELD_OUT})")
    out = quality_fm.scored(docs, model, keep=["doc_id"])
    held_out = F.coalesce(F.expr(HELD_OUT.replace("(id ", "(doc_id ")), F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), n=4, percent=85, words="spaced")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "kept_text")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(_table(spark, sf_dir, "documents")))


def second_replica(pages: DataFrame) -> DataFrame:
    """A replica of ``pages`` in which about 1 of 256 records is rotten, lost or added each."""

    def drawn(kind: str):
        return F.substring(F.md5(F.concat(F.col("page_id").cast("string"), F.lit(f":{kind}"))), 1, 2) == "00"

    kept = pages.where(~drawn("lost"))
    rotten = kept.withColumn("html", F.when(drawn("rot"), F.concat(F.lit("~"), F.substring(F.coalesce("html", F.lit("")), 2, 1 << 30))).otherwise(F.col("html")))
    return rotten.unionByName(kept.where(drawn("more")).withColumn("url", F.concat("url", F.lit("?more"))))


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc_fixity.audit(pages, second_replica(pages))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(_table(spark, sf_dir, "pages"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_quality_classifier, op3_license_scan, op4_source_mixing, op5_ngram_jaccard_join, op6_line_dedup, op7_personal_data, op8_warc_fixity, op9_html_extraction, op10_exact_topk, op11_exact_dedup, op12_prefix_trie, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return sql.oracles()

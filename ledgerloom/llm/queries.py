"""The registered queries of the corpus operators: one for each operator, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import licenses, line_dedup, mixing, periodic_runs, quality, token_alignment, topics, toxicity, url_lists, vector_search, winnowing
from ledgerloom.llm.common import cut, table
from ledgerloom.llm.jaccard_join import near_duplicates
from ledgerloom.llm.sentencepiece_codec import encode_decode
from ledgerloom.llm.suffix_dedup import remove_repeats

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_rules(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.query(spark, sf_dir)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lists.query(spark, sf_dir)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    prepared = mixing.prepare(docs, topic=F.lit("")).withColumn("vector", topics.vector_of(F.col(mixing.ROW)["text"]))
    # What the topics, the cells and the draw need, without the texts, so that these are read once.
    narrow = cut(prepared.withColumn(mixing.ROW, F.col(mixing.ROW).dropFields("text")))
    narrow = mixing.with_topics(narrow)
    return mixing.copies(narrow, mixing.rake(narrow))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.query(spark, sf_dir)


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.query(spark, sf_dir)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.query(spark, sf_dir)


def queries() -> dict[str, Query]:
    found = (
        op1_quality_rules, op2_toxicity, op3_jaccard_join, op4_license_scans, op5_sentencepiece, op6_url_filters, op7_suffix_dedup,
        op8_mixing, op9_top_k, op10_line_dedup, op11_token_alignment, op12_winnowing, op13_periodic_runs,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scans": licenses.SQL, "op6_url_filters": url_lists.SQL, "op9_top_k": vector_search.SQL, "op10_line_dedup": line_dedup.SQL, "op12_winnowing": winnowing.SQL}

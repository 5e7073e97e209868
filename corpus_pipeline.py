"""The corpus pipeline: its stages in order, each over all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, whatever
these are named. run() writes each stage's result to the shared folder, so that its work is done once, and deletes it
and all intermediate tables when the next stage has read them.

1. Quality rules: documents that the base rules or the line field reject go.
2. Line dedup: later occurrences of repeated three-line windows go from the texts; n_chars follows.
3. N-gram Jaccard join: of each group of near copies the document with the smallest id stays (null ids come last; ties
   by a hash of the text); rows alike in id and text are one document, with an id or without.
4. Mixing: sources, languages and topics (nearest centroids) are raked to tempered shares, and documents are sampled to them; one whose
   ratio exceeds 1 may be repeated, so an id may come several times. All ratios are scaled so that no more rows come
   out than went in.
5. SentencePiece: the texts that are left are encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import mixing, quality, topics
from ledgerloom.llm.common import cut, drop, kept, scratch
from ledgerloom.llm.jaccard_join import one_of_each
from ledgerloom.llm.line_dedup import dedup_lines
from ledgerloom.llm.sentencepiece_codec import encode_decode


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(docs, counts=False)
    chars = {"n_chars": F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return cleaned.withColumns(chars)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared = mixing.prepare(docs, topic=F.lit("")).withColumn("vector", topics.vector_of(F.col(mixing.ROW)["text"]))
    prepared = mixing.with_topics(cut(prepared))  # texts are read once; topics, cells and scale read the narrow columns
    mixture = mixing.rake(prepared)
    return mixing.resample(prepared, mixture, scale=mixing.fitting_scale(prepared, mixture))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_decode(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

#: The line field, the shingle components and the library's ids cannot be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scratch():
            docs = kept(cut(stage(spark, docs, sf_dir)))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

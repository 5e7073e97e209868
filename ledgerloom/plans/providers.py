"""Providers: readers of images, logos and prompts that live outside Spark, called only for the rows that need them.

A provider is a function from a pandas frame (doc_id, text, context) to one with doc_id and answer, a JSON
object. Python is evaluated for every row that reaches it, whatever a CASE says, so rows are split by a
filter first. Without a provider the deterministic receipt stands.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import FIELDS
from ledgerloom.functions.fixed import REVIEW_CONFIDENCE
from ledgerloom.functions.text import let
from ledgerloom.plans.extraction import RECEIPT, anchors, clean_answer, deterministic_receipt, is_complete, merged_answer, post_process, prompt_context
from ledgerloom.sources.folders import brief_shuffles, shared_folder

Provider = Callable[[pd.DataFrame], pd.DataFrame]
CORRECTION = "Answer with one JSON object and nothing else."
ANSWER = "is_receipt string, date string, vendor string, " + ", ".join(f"{f} string" for f in FIELDS) + ", currency string, confidence string"


def answer_json(text: F.Column) -> F.Column:
    """The first JSON object in an answer, freed of code fences: up to the brace that closes the first one, however deep they nest; empty if none does."""
    bare = F.regexp_replace(text, r"```(?:json)?", "")

    def ends(s: F.Column) -> F.Column:
        pieces = F.regexp_extract_all(s, F.lit(r"([{}][^{}]*)"), F.lit(1))
        step = F.transform(pieces, lambda p: F.when(p.startswith("{"), 1).otherwise(-1))
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("done"))

        def walk(a: F.Column, x: F.Column) -> F.Column:
            depth = a["depth"] + x["step"]
            done = a["done"] | (depth <= 0)
            return F.when(a["done"], a).otherwise(F.struct(depth.alias("depth"), (a["size"] + F.when(done, 1).otherwise(F.length(x["piece"]))).alias("size"), done.alias("done")))

        walked = F.aggregate(F.arrays_zip(pieces.alias("piece"), step.alias("step")), start, walk)
        return F.when(walked["done"] & s.startswith("{"), F.substring(s, F.lit(1), walked["size"])).otherwise("")

    return F.coalesce(let(F.regexp_extract(bare, r"(?s)(\{.*)", 1), ends), F.lit(""))


def kept(df: DataFrame) -> DataFrame:
    """df in the shared checkpoint folder: no provider is asked twice for a row, and plans stay small."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    with brief_shuffles(df.sparkSession):
        return df.select("*").checkpoint()  # what a query leaves is settled where its frame is made


def within(provider: Provider, seconds: float = 300.0, tries: int = 1) -> Provider:
    """provider with a limit of time for each call and so many tries; when all fail, the answers are null, and the deterministic receipt stands."""

    def limited(frame: pd.DataFrame) -> pd.DataFrame:
        for _ in range(tries):
            pool = ThreadPoolExecutor(1)
            try:
                return pool.submit(provider, frame).result(seconds)
            except Exception as e:
                print(f"provider failed: {e!r}", file=sys.stderr)
            finally:
                pool.shutdown(wait=False, cancel_futures=True)
        return frame[["doc_id"]].assign(answer=None)

    return limited


def ask(rows: DataFrame, provider: Provider) -> DataFrame:
    """doc_id and answer for rows of doc_id, text and context."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield provider(frame)[["doc_id", "answer"]]

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "text", "context").mapInPandas(run, f"doc_id {kind}, answer string")


def _asked(rows: DataFrame, provider: Provider) -> DataFrame:
    """rows with raw, the provider's answer; it is asked again where the first answer holds no object."""
    read = F.from_json(F.nullif(answer_json(F.col("answer")), F.lit("")), ANSWER)
    first = kept(ask(rows, provider).select("doc_id", read.alias("raw")))
    unread = rows.join(first.where("raw IS NULL").select("doc_id"), "doc_id", "left_semi")
    again = ask(unread.withColumn("context", F.concat_ws("\n", F.lit(CORRECTION), "context")), provider).select("doc_id", read.alias("raw_again"))
    found = rows.join(first, "doc_id", "left").join(again, "doc_id", "left")
    return kept(found.withColumn("raw", F.coalesce("raw", "raw_again")).drop("raw_again"))


def _second_pass(rows: DataFrame, provider: Provider, as_of_year: int) -> DataFrame:
    """Doubtful rows that lack a vendor, date or total, with those fields asked for once more. The checks then run on the checked receipt, so bonuses count again."""
    r = F.col("receipt")
    missing = {"vendor": F.coalesce(r["vendor"], F.lit("")) == "", "date": F.coalesce(r["date"], F.lit("")) == "", "total": F.coalesce(r["total"], F.lit(0.0)) == 0}
    names = F.concat_ws(", ", *[F.when(c, f) for f, c in missing.items()])
    doubtful = F.col("is_receipt") & (r["confidence"] < REVIEW_CONFIDENCE) & (names != "")
    low = rows.where(doubtful).withColumn("context", F.concat(F.lit("Missing fields: "), names))
    answers = ask(low, provider).select("doc_id", F.from_json(F.nullif(answer_json(F.col("answer")), F.lit("")), ANSWER).alias("patch"))
    low = kept(low.join(answers, "doc_id", "left").drop("context"))
    said = {f: F.when(c & F.col("patch")[f].isNotNull(), F.col("patch")[f]).otherwise(r[f].cast("string")) for f, c in missing.items()}
    patched = F.struct(*[said.get(f, r[f]).alias(f) for f in RECEIPT])
    done = post_process(low.where("patch IS NOT NULL").withColumn("receipt", clean_answer(patched)).drop("patch"), as_of_year=as_of_year)
    return rows.where(~doubtful).unionByName(done).unionByName(low.where("patch IS NULL").drop("patch"))


def parse(docs: DataFrame, *, as_of_year: int, provider: Provider | None = None) -> DataFrame:
    """docs (doc_id, text) with anchors, is_receipt and the checked receipt. What a provider calls no receipt is not checked."""
    found = anchors(docs).withColumn("is_receipt", F.lit(True))
    if provider is None:
        rows = found.withColumn("receipt", deterministic_receipt(F.col("anchors")))
        return post_process(rows, as_of_year=as_of_year)
    found = kept(found)
    whole = found.where(is_complete(F.col("anchors"))).withColumn("receipt", deterministic_receipt(F.col("anchors")))
    rest = found.where(~is_complete(F.col("anchors"))).withColumn("context", prompt_context(F.col("anchors")))
    merged = F.when(F.col("raw").isNotNull(), merged_answer(clean_answer(F.col("raw")), F.col("anchors"))).otherwise(deterministic_receipt(F.col("anchors")))
    yes = F.when(F.col("raw").isNotNull(), ~F.coalesce(F.lower("raw.is_receipt"), F.lit("")).isin("", "false", "0")).otherwise(True)
    asked = _asked(rest, provider).withColumns({"receipt": merged, "is_receipt": yes}).drop("raw", "context")
    checked = _second_pass(kept(post_process(asked.where("is_receipt"), as_of_year=as_of_year)), provider, as_of_year)
    plain = F.struct(F.col("receipt.*"), F.array().cast("array<string>").alias("warnings"), F.lit(None).cast("boolean").alias("math_valid"))
    others = asked.where("NOT is_receipt").withColumn("receipt", plain)
    return post_process(whole, as_of_year=as_of_year).unionByName(checked).unionByName(others)

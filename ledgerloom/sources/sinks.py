"""Sinks: the CSV export, the report's tables, snapshots of changed tables, and write-back payloads."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import shown
from ledgerloom.functions.fixed import RECEIPT_TAG
from ledgerloom.functions.text import blank_to_null, pipeline_title, safe_title
from ledgerloom.operators import ledger
from ledgerloom.operators.documents import custom_fields, merged_tags


def export_csv(receipts: DataFrame, categories: DataFrame, year: int, path: str, *, one_file: bool = False) -> None:
    """One year's export: files that follow one another in the order of dates, each with a header; or one file, for few rows."""
    rows = ledger.csv_rows(receipts, categories, year)
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def report(receipts: DataFrame, categories: DataFrame, year: int) -> dict[str, DataFrame]:
    """The four tables of the annual report; a renderer draws them."""
    return {
        "summary": ledger.report_totals(receipts, year),
        "taxes": ledger.tax_shares(receipts, year),
        "categories": ledger.report_by_category(receipts, categories, year),
        "ledger": ledger.report_ledger(receipts, categories, year).orderBy("is_total", "date", "id"),
    }


def write_snapshot(df: DataFrame, root: str, version: int, *, partition_by: Iterable[str] = ()) -> str:
    """A changed table's next version in a folder of its own: what is being read is never overwritten."""
    path = f"{root}/v{version:08d}"
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return path


def write_back_rows(receipts: DataFrame, categories: DataFrame) -> DataFrame:
    """document_id, title, created (noon, so that no zone shifts the day) and fields as JSON for the document manager."""
    rows = ledger.with_category(receipts, categories)
    currency = F.coalesce("currency", F.lit("CAD"))
    fields = F.struct(
        F.concat(currency, F.format_string("%.2f", F.coalesce("total", F.lit(0.0)))).alias("Amount"),
        F.coalesce("vendor", F.lit("")).alias("Vendor"),
        F.coalesce("category_name", F.lit("")).alias("Category"),
        currency.alias("Currency"),
    )
    created = F.when(F.col("date") != "", F.concat("date", F.lit("T12:00:00Z")))
    return rows.select("document_id", safe_title(F.col("date"), F.col("vendor")).alias("title"), created.alias("created"), F.to_json(fields).alias("fields"))


def batch_write_back(receipts: DataFrame, categories: DataFrame) -> DataFrame:
    """What a batch sends for its receipts: document_id, the receipt tag to add, a title if date and vendor are known, and
    fields as JSON. Amounts are written as plain numbers here."""
    rows = ledger.with_category(receipts, categories)
    amount = F.coalesce("total", F.lit(0.0))
    fields = F.struct(
        F.coalesce("vendor", F.lit("")).alias("Vendor"),
        F.when(amount == 0, "0").otherwise(shown(amount)).alias("Amount"),
        F.coalesce("category_name", F.lit("")).alias("Category"),
        F.coalesce(blank_to_null(F.col("currency")), F.lit("CAD")).alias("Currency"),
    )
    return rows.select("document_id", F.lit(RECEIPT_TAG).alias("tag"), pipeline_title(F.col("date"), F.col("vendor")).alias("title"), F.to_json(fields).alias("fields"))


def merged_payload(updates: DataFrame, existing: DataFrame, definitions: DataFrame) -> DataFrame:
    """doc_id, tags and custom_fields (all that a document has afterwards) from updates (doc_id, tag_ids, fields as a map of
    names) and what the source holds (doc_id, tags, custom_fields); of updates for one document the greatest tag ids count."""
    pairs = updates.select("doc_id", F.explode("fields").alias("name", "value"))
    old = existing.select("doc_id", F.explode("custom_fields").alias("x")).select("doc_id", "x.field", "x.value")
    fields = custom_fields(pairs, definitions, old).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("field", "value"))).alias("custom_fields"))
    tags = updates.groupBy("doc_id").agg(F.max("tag_ids").alias("tag_ids")).join(existing.select("doc_id", F.transform("tags", lambda t: t["id"]).alias("tags")), "doc_id", "left")
    return tags.select("doc_id", merged_tags(F.col("tags"), F.col("tag_ids")).alias("tags")).join(fields, "doc_id", "left")


def write_back(rows: DataFrame, send: Callable[[Row], None], *, tries: int = 3, wait: float = 1.0) -> int:
    """Sends each row from the executors, up to ``tries`` times, and returns how many failed; a failure of one row stops no
    other. A lost task sends its rows again, and what it had counted as failed is counted again."""
    failed = rows.sparkSession.sparkContext.accumulator(0)

    def each(part: Iterable[Row]) -> None:
        for row in part:
            for attempt in range(tries):
                try:
                    send(row)
                    break
                except Exception as e:
                    if attempt + 1 == tries:
                        failed.add(1)
                        print(f"write-back of {row!r} failed: {e!r}", file=sys.stderr)
                    else:
                        time.sleep(wait)

    rows.foreachPartition(each)
    return failed.value

"""The review queue: why a receipt is doubtful, and the states of its flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.fixed import REVIEW_CONFIDENCE
from ledgerloom.functions.text import document_url
from ledgerloom.operators.ledger import with_category


def reasons() -> Column:
    """Reasons joined by |; null for none."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    found = F.concat_ws(
        "|",
        F.when(F.coalesce("confidence", F.lit(0.0)) < REVIEW_CONFIDENCE, "low_confidence"),
        F.when(F.coalesce("total", F.lit(0.0)) <= 0, "missing_total"),
        F.when(empty("date"), "missing_date"),
        F.when(empty("vendor"), "missing_vendor"),
    )
    return F.when(found != "", found)


def flag(receipts: DataFrame) -> DataFrame:
    """receipt_id and reason of the doubtful receipts."""
    return receipts.select(F.col("id").alias("receipt_id"), reasons().alias("reason")).where("reason IS NOT NULL")


def merge_flags(flags: DataFrame, found: DataFrame, now: Column | None = None) -> DataFrame:
    """flags (receipt_id, reason, status; reviewed_at and created_at if there) after a new evaluation: a new one is pending, a pending one takes the new reason, a resolved one stays, none is cleared."""
    new = found.groupBy("receipt_id").agg(F.max("reason").alias("_reason"))
    rows = flags.join(new, "receipt_id", "full_outer")
    fresh = F.col("status").isNull() | ((F.col("status") == "pending") & F.col("_reason").isNotNull())
    out = {"reason": F.when(fresh, F.col("_reason")).otherwise(F.col("reason")), "status": F.coalesce("status", F.lit("pending"))}
    if now is not None and "created_at" in flags.columns:
        out["created_at"] = F.when(F.col("status").isNull(), now).otherwise(F.col("created_at"))
    return rows.select(*[out.get(c, F.col(c)).alias(c) for c in flags.columns])


def flag_by_hand(flags: DataFrame, receipts: DataFrame, asked: DataFrame, now: Column | None = None) -> DataFrame:
    """flags with a pending one, reason manual, for each receipt of asked (receipt_id) that is there and has no flag yet."""
    known = receipts.select(F.col("id").alias("receipt_id"))
    new = asked.select("receipt_id").distinct().join(known, "receipt_id", "left_semi").join(flags.select("receipt_id"), "receipt_id", "left_anti")
    return merge_flags(flags, new.withColumn("reason", F.lit("manual")), now)


def resolve(flags: DataFrame, actions: DataFrame, now: Column | None = None) -> DataFrame:
    """flags with the status of actions (receipt_id, action: approved or rejected) and the time of the review; of several actions the greatest counts."""
    done = actions.where("action IN ('approved', 'rejected')").groupBy("receipt_id").agg(F.max("action").alias("_action"))
    out = {"status": F.coalesce("_action", "status")}
    if now is not None and "reviewed_at" in flags.columns:
        out["reviewed_at"] = F.when(F.col("_action").isNotNull(), now).otherwise(F.col("reviewed_at"))
    return flags.join(done, "receipt_id", "left").select(*[out.get(c, F.col(c)).alias(c) for c in flags.columns])


def queue(flags: DataFrame, receipts: DataFrame, documents: DataFrame, categories: DataFrame, status: str = "pending", base_url: str = "") -> DataFrame:
    """The flags of one status with what a reviewer sees, newest first."""
    shown = with_category(receipts.select(F.col("id").alias("receipt_id"), "document_id", "vendor", "date", "total", "confidence", "category_id"), categories)
    sources = documents.select(F.col("id").alias("document_id"), "source_id")
    rows = flags.where(F.col("status") == status).join(shown, "receipt_id").join(sources, "document_id", "left")
    columns = ["receipt_id", "reason", "status", "source_id", "vendor", "date", "total", "confidence", "category_id", "category_name"]
    newest = [F.desc(c) for c in ("created_at", "receipt_id") if c in rows.columns]
    return rows.select(*columns, document_url(base_url, F.col("source_id")).alias("source_url"), *[c for c in ("created_at",) if c in rows.columns]).orderBy(*newest)


def pending_count(flags: DataFrame) -> DataFrame:
    return flags.where("status = 'pending'").agg(F.count("*").alias("pending"))


def reason_rows(flags: DataFrame) -> DataFrame:
    """One row for each flag and reason."""
    parts = F.filter(F.split("reason", r"\|"), lambda r: r != "")
    return flags.select("receipt_id", F.explode(parts).alias("reason"))

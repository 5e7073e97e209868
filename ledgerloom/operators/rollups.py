"""Sums of the ledger that are kept up to date by differences, and the summaries and report tables read from them.

A receipt counts in the group of its month, category and vendor key. A batch's difference is the new rows' sums less the old rows',
grouped before it is merged, so its size follows the batch. Money is DECIMAL, so additions and subtractions in any order give the
sums of a full computation; groups that no receipt is left in go. What is read from the groups equals what operators.ledger
computes from all receipts, from a table that grows with months, categories and vendors only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.fixed import TAXES
from ledgerloom.functions.text import blank_to_null
from ledgerloom.operators import ledger

KEY = ("month", "category_id", "normalized_vendor")
AMOUNTS = ("pre_tax", *TAXES, "total")
SCHEMA = "month string, category_id int, normalized_vendor string, receipts long, " + ", ".join(f"{a} decimal(28,2)" for a in AMOUNTS)


def groups(receipts: DataFrame) -> DataFrame:
    """The sums of receipts by the first seven characters of the date, category and vendor key."""
    keyed = receipts.select(F.left("date", F.lit(7)).alias("month"), F.col("category_id").cast("int"), "normalized_vendor", *[ledger.cents(a).alias(a) for a in AMOUNTS])
    return keyed.groupBy(*KEY).agg(F.count("*").alias("receipts"), *[F.sum(a).cast("decimal(28,2)").alias(a) for a in AMOUNTS])


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """What replacing the rows before by the rows after changes, by group; groups that stay as they are are left out."""
    less = groups(before).select(*KEY, *[(-F.col(c)).alias(c) for c in ("receipts", *AMOUNTS)])
    both = groups(after).unionByName(less).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("receipts", *AMOUNTS)])
    return both.where(" OR ".join(f"{c} != 0" for c in ("receipts", *AMOUNTS))).select(*KEY, "receipts", *[F.col(a).cast("decimal(28,2)").alias(a) for a in AMOUNTS])


def added(old: Column, new: Column) -> dict[str, Column]:
    """The columns of a group after a difference; for sources.buckets."""
    from ledgerloom.sources.buckets import GONE

    out = {c: F.coalesce(old[c], F.lit(0)) + F.coalesce(new[c], F.lit(0)) for c in ("receipts", *AMOUNTS)}
    return out | {GONE: out["receipts"] == 0}


def of_year(sums: DataFrame, year: int | None) -> DataFrame:
    return sums.where(F.col("month").startswith(f"{year}-")) if year else sums


def _sum(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("double")


def _count() -> Column:
    return F.coalesce(F.sum("receipts"), F.lit(0)).cast("long")


def summary(sums: DataFrame, year: int | None = None) -> DataFrame:
    vendors = F.count_distinct(blank_to_null(F.col("normalized_vendor")))
    return of_year(sums, year).agg(_count().alias("total_receipts"), *[_sum(c).alias(f"total_{'amount' if c == 'total' else c}") for c in ("total", *TAXES)], vendors.alias("vendor_count"))


def by_category(sums: DataFrame, categories: DataFrame, year: int | None = None) -> DataFrame:
    name = F.coalesce("category_name", F.lit("Uncategorized")).alias("name")
    return ledger.with_category(of_year(sums, year), categories).groupBy(name).agg(_sum("total").alias("total")).orderBy("name")


def by_month(sums: DataFrame, year: int | None = None) -> DataFrame:
    return of_year(sums, year).where(F.length("month") >= 7).groupBy("month").agg(_sum("total").alias("total")).orderBy("month")


def report_totals(sums: DataFrame, year: int | None = None) -> DataFrame:
    tax = sum((F.sum(t) for t in TAXES[1:]), F.sum(TAXES[0]))
    return of_year(sums, year).agg(
        _count().alias("receipts"), _sum("pre_tax").alias("pre_tax"), *[_sum(t).alias(t) for t in TAXES], F.coalesce(tax, F.lit(0)).cast("double").alias("total_tax"), _sum("total").alias("total"),
        F.count_distinct(blank_to_null(F.col("normalized_vendor"))).alias("vendors"),
    )


def report_by_category(sums: DataFrame, categories: DataFrame, year: int | None = None) -> DataFrame:
    """As in operators.ledger: count, pre-tax, tax and total by category, greatest total first, and the row of all."""
    rows = ledger.with_category(of_year(sums, year), categories).withColumn("category", F.coalesce("category_name", F.lit("Uncategorized")))
    tax = sum((F.sum(t) for t in TAXES[1:]), F.sum(TAXES[0]))
    totals = rows.rollup("category").agg(
        _count().alias("count"), _sum("pre_tax").alias("pre_tax"), F.coalesce(tax, F.lit(0)).cast("double").alias("tax"), _sum("total").alias("total"), F.grouping("category").cast("int").alias("is_total")
    )
    return totals.withColumn("category", F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col("category"))).orderBy("is_total", F.desc("total"), "category")


def tax_shares(sums: DataFrame, year: int | None = None) -> DataFrame:
    return ledger.shares(of_year(sums, year).agg(*[F.coalesce(F.sum(t), F.lit(0)).cast("decimal(28,2)").alias(t) for t in TAXES]))

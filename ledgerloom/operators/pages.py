"""Pages of receipts by cursor: a page begins after the last row of the one before, and reads the months that it needs.

Receipts are stored by date (``write_by_date``), so files and row groups cover short stretches of time. How many receipts a month has is known from the sums
that are kept with the ledger (operators.rollups); from these the month is found in which a page must end, and both bounds on the date reach
the Parquet scan. A page deep in the history costs what the first one costs: no offset is counted off and nothing older is read or sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators import rollups
from ledgerloom.operators.ledger import of_year

MOST = 1000


@dataclass(frozen=True)
class Cursor:
    """The place of a row in the order of pages: newest date first, rows without a date last, ties by id."""

    date: str | None
    id: int


def write_by_date(receipts: DataFrame, path: str, files: int = 32) -> None:
    """Receipts in files that follow one another in the order of pages."""
    receipts.repartitionByRange(files, F.desc_nulls_last("date"), "id").sortWithinPartitions(F.desc_nulls_last("date"), "id").write.parquet(path)


def _follows(after: Cursor) -> Column:
    later = F.col("date").isNull() & (F.col("id") > after.id)
    if after.date is None:
        return later
    return (F.col("date") < after.date) | ((F.col("date") == after.date) & (F.col("id") > after.id)) | F.col("date").isNull()


def _oldest(sums: DataFrame, after: Cursor | None, limit: int) -> str | None:
    """The greatest month prefix from which on limit rows follow after; None if the dated rows do not suffice. One small row comes to the driver."""
    months = sums.where("month IS NOT NULL").groupBy("month").agg(F.sum("receipts").alias("n"))
    if after is not None and after.date is not None:
        # Rows of the cursor's own month may lie before it: they are not counted on.
        months = months.where(F.col("month") <= after.date[:7]).withColumn("n", F.when(F.col("month") < after.date[:7], F.col("n")).otherwise(0))
    # A row for each month there is: few, whatever the ledger's size.
    running = months.withColumn("sum", F.sum("n").over(Window.orderBy(F.desc("month"))))
    return running.where(F.col("sum") >= limit).agg(F.max("month")).first()[0]


def page(receipts: DataFrame, sums: DataFrame | None = None, *, after: Cursor | None = None, year: int | None = None, category_id: int | None = None, vendor: str | None = None, limit: int = 500) -> DataFrame:
    """The limit (1000 at most) receipts that follow after, filtered as in ledger.find. sums: of all these receipts; without them, or with a vendor, which they do not
    hold as it is written, everything older is looked through for the page."""
    limit = min(limit, MOST)
    found = of_year(receipts, year)
    if category_id is not None:
        found = found.where(F.col("category_id") == category_id)
    if vendor:
        found = found.where(F.col("vendor").ilike(f"%{vendor}%"))
    if after is not None:
        found = found.where(_follows(after))
    if after is not None and after.date is not None:
        found = found.where((F.col("date") <= after.date) | F.col("date").isNull())
    if sums is not None and not vendor and (after is None or after.date is not None):
        counted = rollups.of_year(sums, year)
        oldest = _oldest(counted if category_id is None else counted.where(F.col("category_id") == category_id), after, limit)
        if oldest is not None:
            found = found.where(F.col("date") >= oldest)
    return found.orderBy(F.desc_nulls_last("date"), "id").limit(limit)


def last_of(rows: DataFrame) -> Cursor | None:
    """The cursor after a page, which is MOST rows at most; None after an empty one."""
    last = rows.select("date", "id").collect()
    return Cursor(last[-1].date, last[-1].id) if last else None

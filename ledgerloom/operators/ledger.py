"""Reading the ledger: filters, summaries, report tables, export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.fixed import TAXES
from ledgerloom.functions.text import blank_to_null, document_url, normalize_vendor

CENTS = "decimal(18,2)"


def cents(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0)).cast(CENTS)


def sum_of(name: str) -> Column:
    """An exact sum of money; 0 for no rows."""
    return F.coalesce(F.sum(cents(name)), F.lit(0)).cast("double")


def of_year(receipts: DataFrame, year: int | None) -> DataFrame:
    """Receipts whose date text begins with the year; all for None or 0. Reaches the Parquet scan as a prefix."""
    return receipts.where(F.col("date").startswith(f"{year}-")) if year else receipts


def with_category(receipts: DataFrame, categories: DataFrame) -> DataFrame:
    """receipts with category_name, null where there is none."""
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return receipts.join(names, "category_id", "left")


def find(receipts: DataFrame, *, year: int | None = None, category_id: int | None = None, vendor: str | None = None, limit: int = 500, offset: int = 0) -> DataFrame:
    """A page of receipts, newest first; % and _ in vendor match anything. Ties by id."""
    found = of_year(receipts, year)
    if category_id is not None:
        found = found.where(F.col("category_id") == category_id)
    if vendor:
        found = found.where(F.col("vendor").ilike(f"%{vendor}%"))
    return found.orderBy(F.desc("date"), "id").offset(offset).limit(min(limit, 1000))


def receipt_rows(receipts: DataFrame, documents: DataFrame, categories: DataFrame, base_url: str = "") -> DataFrame:
    """Receipts as shown: with the source document's id and address and the category's name."""
    sources = documents.select(F.col("id").alias("document_id"), "source_id")
    rows = with_category(receipts.join(sources, "document_id", "left"), categories)
    return rows.withColumns({"source_url": document_url(base_url, F.col("source_id")), "currency": F.coalesce("currency", F.lit("CAD"))})


def summary(receipts: DataFrame, year: int | None = None) -> DataFrame:
    sums = [sum_of(c).alias(f"total_{'amount' if c == 'total' else c}") for c in ("total", *TAXES)]
    vendors = F.count_distinct(blank_to_null(F.col("normalized_vendor")))
    return of_year(receipts, year).agg(F.count("*").alias("total_receipts"), *sums, vendors.alias("vendor_count"))


def by_category(receipts: DataFrame, categories: DataFrame, year: int | None = None) -> DataFrame:
    name = F.coalesce("category_name", F.lit("Uncategorized")).alias("name")
    return with_category(of_year(receipts, year), categories).groupBy(name).agg(sum_of("total").alias("total")).orderBy("name")


def by_month(receipts: DataFrame, year: int | None = None) -> DataFrame:
    dated = of_year(receipts, year).where(F.length("date") >= 7)
    return dated.groupBy(F.left("date", F.lit(7)).alias("month")).agg(sum_of("total").alias("total")).orderBy("month")


def summary_document(receipts: DataFrame, categories: DataFrame, year: int | None = None) -> DataFrame:
    """One row: the summary with by_category and by_month as arrays, and all of it as JSON."""
    parts = summary(receipts, year)
    for frame, key in ((by_category(receipts, categories, year), "by_category"), (by_month(receipts, year), "by_month")):
        rows = frame.agg(F.array_sort(F.collect_list(F.struct(*frame.columns))).alias(key))
        parts = parts.unionByName(rows, allowMissingColumns=True)
    one = parts.agg(*[F.first(c, ignorenulls=True).alias(c) for c in parts.columns])
    return one.withColumn("json", F.to_json(F.struct(*one.columns)))


def report_totals(receipts: DataFrame, year: int | None = None) -> DataFrame:
    tax = sum((cents(t) for t in TAXES), F.lit(0).cast(CENTS))
    return of_year(receipts, year).agg(
        F.count("*").alias("receipts"),
        sum_of("pre_tax").alias("pre_tax"),
        *[sum_of(t).alias(t) for t in TAXES],
        F.coalesce(F.sum(tax), F.lit(0)).cast("double").alias("total_tax"),
        sum_of("total").alias("total"),
        F.count_distinct(blank_to_null(F.col("normalized_vendor"))).alias("vendors"),
    )


def report_by_category(receipts: DataFrame, categories: DataFrame, year: int | None = None) -> DataFrame:
    """Count, pre-tax, tax and total by category, greatest total first, and the row of all (is_total)."""
    tax = sum((cents(t) for t in TAXES), F.lit(0).cast(CENTS))
    rows = with_category(of_year(receipts, year), categories).withColumn("category", F.coalesce("category_name", F.lit("Uncategorized")))
    totals = rows.rollup("category").agg(
        F.count("*").alias("count"), sum_of("pre_tax").alias("pre_tax"), F.coalesce(F.sum(tax), F.lit(0)).cast("double").alias("tax"), sum_of("total").alias("total"), F.grouping("category").cast("int").alias("is_total")
    )
    return totals.withColumn("category", F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col("category"))).orderBy("is_total", F.desc("total"), "category")


def tax_shares(receipts: DataFrame, year: int | None = None) -> DataFrame:
    """Amount of each tax and its share of all tax in per cent with one decimal."""
    return shares(of_year(receipts, year).agg(*[F.coalesce(F.sum(cents(t)), F.lit(0)).cast(CENTS).alias(t) for t in TAXES]))


def shares(sums: DataFrame) -> DataFrame:
    """The rows of tax_shares from one row of sums."""
    all_tax = sum((F.col(t) for t in TAXES[1:]), F.col(TAXES[0]))
    rows = F.stack(F.lit(5), *[x for t in TAXES for x in (F.lit(t.upper()), F.col(t).cast("double"))], F.lit("TOTAL"), F.col("all_tax").cast("double")).alias("tax", "amount")
    share = F.when(F.col("all_tax") == 0, F.when(F.col("tax") == "TOTAL", 100.0).otherwise(0.0)).otherwise(F.round(F.col("amount") * 100 / F.col("all_tax").cast("double"), 1))
    return sums.withColumn("all_tax", all_tax).select("all_tax", rows).select("tax", "amount", share.alias("share"))


def paid_taxes(receipts: DataFrame) -> DataFrame:
    """One row for each receipt and tax above 0."""
    rows = F.stack(F.lit(4), *[x for t in TAXES for x in (F.lit(t), F.col(t))]).alias("tax", "amount")
    return receipts.select("id", rows).where("amount > 0")


def csv_rows(receipts: DataFrame, categories: DataFrame, year: int) -> DataFrame:
    """The ten columns of the export as text, oldest first."""
    rows = with_category(of_year(receipts, year), categories).orderBy("date", "id")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    money = {"Pre-Tax": "pre_tax", "GST": "gst", "QST": "qst", "PST": "pst", "HST": "hst", "Total": "total"}
    return rows.select(
        text("date").alias("Date"),
        text("vendor").alias("Vendor"),
        text("category_name").alias("Category"),
        *[cents(c).cast("string").alias(n) for n, c in money.items()],
        F.coalesce(blank_to_null(F.col("currency")), F.lit("CAD")).alias("Currency"),
    )


def report_ledger(receipts: DataFrame, categories: DataFrame, year: int | None = None) -> DataFrame:
    """The report's ledger rows with shortened names, and a row of totals (is_total)."""
    amounts = ["pre_tax", *TAXES, "total"]
    rows = with_category(of_year(receipts, year), categories)
    shown = rows.select(
        F.col("id"),
        F.coalesce(blank_to_null(F.col("date")), F.lit("—")).alias("date"),
        F.left(F.coalesce(blank_to_null(F.col("vendor")), F.lit("Unknown")), F.lit(32)).alias("vendor"),
        F.left(F.coalesce("category_name", F.lit("")), F.lit(18)).alias("category"),
        *[cents(a).cast("double").alias(a) for a in amounts],
        F.lit(0).alias("is_total"),
    )
    total = rows.agg(*[sum_of(a).alias(a) for a in amounts]).select(F.lit(None).cast("long").alias("id"), F.lit("TOTAL").alias("date"), F.lit("").alias("vendor"), F.lit("").alias("category"), *amounts, F.lit(1).alias("is_total"))
    return shown.unionByName(total)


def vendors(receipts: DataFrame) -> DataFrame:
    return receipts.where("vendor != ''").select("vendor").distinct().orderBy("vendor")


def vendor_hints(receipts: DataFrame, limit: int = 50) -> DataFrame:
    return vendors(receipts).limit(limit)


def suggest_vendors(receipts: DataFrame, typed: str, limit: int = 6) -> DataFrame:
    """Vendors that contain what was typed, in any case."""
    return vendors(receipts).where(F.contains(F.lower("vendor"), F.lit(typed.lower()))).orderBy("vendor").limit(limit)


def filtered_totals(receipts: DataFrame, typed: str) -> DataFrame:
    """Count and sums of the receipts whose vendor contains what was typed."""
    found = receipts.where(F.contains(F.lower(F.coalesce("vendor", F.lit(""))), F.lit(typed.lower())))
    return found.agg(F.count("*").alias("receipts"), *[sum_of(a).alias(a) for a in ("pre_tax", *TAXES, "total")])


def lookup(receipts: DataFrame, receipt_id: int) -> DataFrame:
    return receipts.where(F.col("id") == receipt_id)


def rescan_status(ids: DataFrame, receipts: DataFrame) -> DataFrame:
    """receipt_id, status (found, not_found) and document_id of the asked ids."""
    known = receipts.select(F.col("id").alias("receipt_id"), "document_id")
    return ids.join(known, "receipt_id", "left").select("receipt_id", F.when(F.col("document_id").isNull(), "not_found").otherwise("found").alias("status"), "document_id")


def patch(receipts: DataFrame, changes: DataFrame, categories: DataFrame, now: Column | None = None) -> DataFrame:
    """receipts with changes (id and any columns; null leaves a value), and now as their updated_at.

    category_id <= 0 clears it; an unknown category rejects its row's change. A new vendor gets a new key. Of several
    changes for one id the greatest row counts; changes of unknown ids change nothing."""
    fields = [c for c in ("vendor", "date", "total", "pre_tax", *TAXES, "currency") if c in changes.columns]
    known = categories.select(F.col("id").alias("_category"), F.lit(True).alias("_known"))
    asked = changes.withColumn("_category", F.col("category_id") if "category_id" in changes.columns else F.lit(None).cast("int"))
    asked = asked.join(known, "_category", "left").where("_category IS NULL OR _category <= 0 OR _known")
    asked = asked.groupBy("id").agg(F.max(F.struct("_category", *fields)).alias("_x")).select("id", F.col("_x._category").alias("_category"), *[F.col("_x")[c].alias(f"_{c}") for c in fields], F.lit(True).alias("_hit"))
    out = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in fields}
    if "vendor" in fields:
        out["normalized_vendor"] = F.when(F.col("_vendor").isNotNull(), normalize_vendor(F.col("_vendor"))).otherwise(F.col("normalized_vendor"))
    if now is not None and "updated_at" in receipts.columns:
        out["updated_at"] = F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))
    out["category_id"] = F.when(F.col("_category") <= 0, None).otherwise(F.coalesce("_category", "category_id"))
    return receipts.join(asked, "id", "left").select(*[out.get(c, F.col(c)).alias(c) for c in receipts.columns])

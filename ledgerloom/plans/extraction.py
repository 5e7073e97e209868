"""From text to receipt: anchors, the deterministic build, the merge with a provider's answer, and post-processing.

All of it is one narrow projection over a document's text: nothing is exploded and nothing shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import FIELDS, adjust_confidence, amount_lines, drop_impossible_taxes, labelled_amounts, ranked_lines, sanitize_taxes, to_amount, validate_math
from ledgerloom.functions.dates import late_date, parse_late, transaction_date
from ledgerloom.functions.fixed import TAXES
from ledgerloom.functions.text import clean_lines, clean_vendor, strip
from ledgerloom.functions.vendors import by_late_domain, find_vendor

RECEIPT = ["date", "vendor", *FIELDS, "currency", "confidence"]


def anchors(docs: DataFrame, text: str = "text", *, logo: str | None = None) -> DataFrame:
    """docs with the struct anchors: what the deterministic parser finds, null where it finds nothing."""
    rows = docs.withColumn("_lines", clean_lines(F.coalesce(F.col(text), F.lit(""))))
    # One column after the other, so that no step is worked out twice.
    rows = rows.withColumn("_found", amount_lines(F.col("_lines")))
    rows = rows.withColumn("_ranked", ranked_lines(F.col("_found")))
    rows = rows.withColumn("_amounts", labelled_amounts(F.col("_ranked")))
    amounts = drop_impossible_taxes(F.col("_amounts"))
    vendor = find_vendor(F.coalesce(F.col(text), F.lit("")), F.col("_lines"))
    if logo:
        said = F.when(~F.col(logo).isin("", "unknown", "not applicable", "not identified"), F.col(logo))
        vendor = F.coalesce(F.when(vendor != "", vendor), said, vendor)
    rows = rows.withColumns({"_amounts": amounts, "_date": transaction_date(F.col("_lines")), "_vendor": vendor})
    struct = F.struct(*[F.col("_amounts")[f].alias(f) for f in FIELDS], F.col("_date").alias("date"), F.col("_vendor").alias("vendor"))
    return rows.withColumn("anchors", struct).drop("_lines", "_found", "_ranked", "_amounts", "_date", "_vendor")


def is_complete(a: Column) -> Column:
    """Whether vendor, date and total are found, so that no provider is asked."""
    return F.coalesce((a["vendor"] != "") & (a["date"] != "") & (a["total"] != 0), F.lit(False))


def deterministic_receipt(a: Column) -> Column:
    """A receipt of anchors alone: more sure with a tax, least sure when incomplete."""
    amounts = [F.coalesce(a[f], F.lit(0.0)).alias(f) for f in FIELDS]
    taxed = F.greatest(*[F.coalesce(a[t], F.lit(0.0)) for t in TAXES]) != 0
    confidence = F.when(~is_complete(a), 0.4).when(taxed, 0.85).otherwise(0.75)
    return F.struct(a["date"].alias("date"), a["vendor"].alias("vendor"), *amounts, F.lit("CAD").alias("currency"), confidence.alias("confidence"))


def clean_answer(raw: Column) -> Column:
    """A provider's answer with amounts of two decimals from 0 up, trimmed names and confidence from 0 to 1."""
    blank = lambda c: F.when(F.coalesce(raw[c].cast("string"), F.lit("")) != "", strip(raw[c].cast("string")))
    amounts = [F.greatest(F.lit(0.0), F.round(to_amount(raw[f]), 2)).alias(f) for f in FIELDS]
    sure = F.when(raw["confidence"].isNull(), 0.0).otherwise(F.coalesce(F.round(raw["confidence"].try_cast("double"), 2), F.lit(0.5)))
    return F.struct(
        blank("date").alias("date"), blank("vendor").alias("vendor"), *amounts,
        F.left(F.upper(F.coalesce(raw["currency"], F.lit("CAD"))), F.lit(3)).alias("currency"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), sure)).alias("confidence"),
    )


def merged_answer(answer: Column, a: Column) -> Column:
    """A provider's receipt completed by anchors; the anchors' total wins where they differ by more than 1."""
    out = {f: F.when((F.coalesce(answer[f], F.lit(0.0)) == 0) & a[f].isNotNull(), a[f]).otherwise(answer[f]) for f in FIELDS if f != "total"}
    said = F.coalesce(answer["total"], F.lit(0.0))
    out["total"] = F.when((a["total"] != 0) & ((said == 0) | (F.abs(a["total"] - said) > 1.0)), a["total"]).otherwise(answer["total"])
    for f in ("vendor", "date"):
        out[f] = F.when(F.coalesce(answer[f], F.lit("")) == "", F.coalesce(a[f], answer[f])).otherwise(answer[f])
    return F.struct(*[out.get(f, answer[f]).alias(f) for f in RECEIPT])


def post_process(rows: DataFrame, receipt: str = "receipt", text: str | None = "text", *, as_of_year: int) -> DataFrame:
    """rows with the struct receipt checked and corrected, and with warnings and math_valid in it."""
    r = F.col(receipt)
    taxed, tax_warnings = sanitize_taxes({f: r[f] for f in FIELDS})
    read = parse_late(r["date"], as_of_year)
    found = late_date(F.col(text), as_of_year) if text else F.lit(None).cast("string")
    rows = rows.withColumns({"_read": read, "_found": F.when(read.isNull(), found), "_vendor": clean_vendor(r["vendor"])})
    if text:
        rows = rows.withColumn("_vendor", F.when(F.coalesce("_vendor", F.lit("")) == "", F.coalesce(by_late_domain(F.col(text)), F.col("_vendor"))).otherwise(F.col("_vendor")))
    date_warnings = F.array_compact(F.array(
        F.when((r["date"] != "") & F.col("_read").isNull(), F.concat(F.lit("DATE_PARSE_FAILED:"), r["date"])),
        F.when(F.col("_found").isNotNull(), F.concat(F.lit("DATE_FROM_OCR:"), F.col("_found"))),
        F.when(F.coalesce("_read", "_found").isNull(), F.lit("DATE_MISSING")),
    ))
    rows = rows.withColumns({f"_{f}": c for f, c in taxed.items()} | {"_warnings": F.concat(tax_warnings, date_warnings)})
    values, math_warnings = validate_math({f: F.col(f"_{f}") for f in FIELDS})
    rows = rows.withColumns({f"_final_{f}": c for f, c in values.items()} | {"_warnings": F.concat("_warnings", math_warnings), "_date": F.coalesce("_read", "_found")})
    final = {f: F.col(f"_final_{f}") for f in FIELDS}
    confidence = adjust_confidence(r["confidence"], F.col("_warnings"), final, F.col("_vendor"), F.col("_date"))
    valid = ~F.exists("_warnings", lambda w: w.startswith("MATH_MISMATCH"))
    out = F.struct(
        F.col("_date").alias("date"), F.col("_vendor").alias("vendor"), *[final[f].alias(f) for f in FIELDS], r["currency"].alias("currency"),
        confidence.alias("confidence"), F.col("_warnings").alias("warnings"), valid.alias("math_valid"),
    )
    helpers = ["_read", "_found", "_vendor", "_warnings", "_date", *[f"{p}{f}" for f in FIELDS for p in ("_", "_final_")]]
    return rows.withColumn(receipt, out).drop(*helpers)


def prompt_context(a: Column) -> Column:
    """The anchors as lines for a provider's prompt; empty for none."""
    labels = {"vendor": "Vendor", "date": "Date", "total": "Total", "pre_tax": "Pre-tax", "gst": "GST/TPS", "qst": "QST/TVQ", "pst": "PST", "hst": "HST"}
    return F.concat_ws("\n", *[F.when(a[f].isNotNull(), F.concat(F.lit(f"{label}: "), a[f].cast("string"))) for f, label in labels.items()])

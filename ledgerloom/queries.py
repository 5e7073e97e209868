"""The registered queries of the ledger, and the SQL that they are compared with.

Each query reads whole tables. Those with inputs that the tables lack derive them by a rule that both
sides state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, text, vendors
from ledgerloom.operators import catalog, documents, review
from ledgerloom.operators import ledger as L
from ledgerloom.plans import extraction, providers
from ledgerloom.sources import readers, sinks
from ledgerloom.sources.folders import fresh_folder, write
from ledgerloom.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
YEAR = 2018
AS_OF = 2034
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Common tables for the SQL side.
BASE = (
    "ledger0 AS ("
    + readers.LEDGER_SQL.format(lineitem="lineitem", orders="orders", customer="customer", part="part")
    + """),
categories AS (SELECT CAST(row_number() OVER (ORDER BY name) AS INT) AS id, name FROM (SELECT DISTINCT c_mktsegment AS name FROM customer WHERE c_mktsegment IS NOT NULL)),
ledger AS (SELECT l.*, c.id AS category_id, date AS updated_at,
  trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(vendor)), '\\b(inc|ltd|corp|co|llc)\\b', '', 'g'), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS normalized_vendor
  FROM ledger0 l LEFT JOIN categories c ON l.category = c.name),
of_year AS (SELECT * FROM ledger WHERE date LIKE '2018-%')
"""
)
CENTS = "CAST(CAST({0} AS DECIMAL(18,2)) AS DOUBLE)"


def total(column: str, where: str = "") -> str:
    return f"CAST(coalesce(sum(CAST({column} AS DECIMAL(18,2))), 0) AS DOUBLE)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if sql.lstrip().startswith("WITH") else f"WITH {BASE} {sql}"
        return f

    return add


@query(f"""SELECT count(*) AS total_receipts, {total('total')} AS total_amount, {total('gst')} AS total_gst, {total('qst')} AS total_qst,
{total('pst')} AS total_pst, {total('hst')} AS total_hst, count(DISTINCT nullif(normalized_vendor, '')) AS vendor_count FROM of_year""")
def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.summary(readers.receipts(spark, sf_dir), YEAR)


@query(f"SELECT coalesce(category, 'Uncategorized') AS name, {total('total')} AS total FROM of_year GROUP BY 1")
def summary_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.by_category(readers.receipts(spark, sf_dir), readers.categories(spark, sf_dir), YEAR)


@query(f"SELECT left(date, 7) AS month, {total('total')} AS total FROM of_year GROUP BY 1")
def summary_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.by_month(readers.receipts(spark, sf_dir), YEAR)


@query(f""", c AS (SELECT coalesce(category, 'Uncategorized') AS name, {total('total')} AS total FROM of_year GROUP BY 1),
m AS (SELECT left(date, 7) AS month, {total('total')} AS total FROM of_year GROUP BY 1)
SELECT count(*) AS total_receipts, {total('total')} AS total_amount,
(SELECT string_agg(concat(name, '=', CAST(CAST(total AS DECIMAL(18,2)) AS VARCHAR)), ';' ORDER BY name) FROM c) AS by_category,
(SELECT string_agg(concat(month, '=', CAST(CAST(total AS DECIMAL(18,2)) AS VARCHAR)), ';' ORDER BY month) FROM m) AS by_month FROM of_year""")
def summary_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.summary_document(readers.receipts(spark, sf_dir), readers.categories(spark, sf_dir), YEAR)
    read = F.from_json("json", "total_receipts long, total_amount double, by_category array<struct<name:string,total:double>>, by_month array<struct<month:string,total:double>>")
    rows = lambda a, key: F.array_join(F.transform(F.col(a), lambda x: F.concat(x[key], F.lit("="), x["total"].cast("decimal(18,2)").cast("string"))), ";")
    found = found.select(read.alias("j")).select("j.*")
    return found.select("total_receipts", "total_amount", rows("by_category", "name").alias("by_category"), rows("by_month", "month").alias("by_month"))


@query(f"""SELECT CASE WHEN grouping(c) = 1 THEN 'TOTAL' ELSE c END AS category, count(*) AS count, {total('pre_tax')} AS pre_tax,
CAST(coalesce(sum(CAST(gst AS DECIMAL(18,2)) + CAST(qst AS DECIMAL(18,2)) + CAST(pst AS DECIMAL(18,2)) + CAST(hst AS DECIMAL(18,2))), 0) AS DOUBLE) AS tax,
{total('total')} AS total, CAST(grouping(c) AS INT) AS is_total FROM (SELECT *, coalesce(category, 'Uncategorized') AS c FROM of_year) GROUP BY ROLLUP (c)""")
def report_by_category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.report_by_category(readers.receipts(spark, sf_dir), readers.categories(spark, sf_dir), YEAR)


_SHARE = "round(CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE) * 100 / (SELECT t FROM tax), 1)"


@query(
    ", tax AS (SELECT CAST(sum(CAST(gst AS DECIMAL(18,2)) + CAST(qst AS DECIMAL(18,2)) + CAST(pst AS DECIMAL(18,2)) + CAST(hst AS DECIMAL(18,2))) AS DOUBLE) AS t FROM of_year) "
    + " UNION ALL ".join(f"SELECT '{t.upper()}' AS tax, {total(t)} AS amount, {_SHARE.format(t)} AS share FROM of_year" for t in ("gst", "qst", "pst", "hst"))
    + " UNION ALL SELECT 'TOTAL', t, 100.0 FROM tax"
)
def report_tax_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.tax_shares(readers.receipts(spark, sf_dir), YEAR)


@query(f"""SELECT count(*) AS receipts, {total('pre_tax')} AS pre_tax, {total('gst')} AS gst, {total('qst')} AS qst, {total('pst')} AS pst, {total('hst')} AS hst,
CAST(sum(CAST(gst AS DECIMAL(18,2)) + CAST(qst AS DECIMAL(18,2)) + CAST(pst AS DECIMAL(18,2)) + CAST(hst AS DECIMAL(18,2))) AS DOUBLE) AS total_tax,
{total('total')} AS total, count(DISTINCT nullif(normalized_vendor, '')) AS vendors FROM of_year""")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.report_totals(readers.receipts(spark, sf_dir), YEAR)


@query("SELECT id, date, vendor, total, category_id FROM of_year WHERE category_id = 2 AND vendor ILIKE '%red%' ORDER BY date DESC, id LIMIT 500 OFFSET 5")
def receipts_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.find(readers.receipts(spark, sf_dir), year=YEAR, category_id=2, vendor="red", offset=5)
    return found.select("id", "date", "vendor", "total", "category_id")


@query("""SELECT id, vendor, date, total, category AS category_name, currency, CASE WHEN document_id % 7 = 0 THEN 0 ELSE document_id + 1000 END AS source_id,
CASE WHEN document_id % 7 != 0 THEN 'https://docs.example/documents/' || CAST(document_id + 1000 AS VARCHAR) END AS source_url FROM ledger""")
def receipt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.receipts(spark, sf_dir)
    shown = L.receipt_rows(rows, readers.sources_of(rows), readers.categories(spark, sf_dir), "https://docs.example/")
    return shown.select("id", "vendor", "date", "total", "category_name", "currency", "source_id", "source_url")


@query("SELECT DISTINCT vendor FROM ledger WHERE vendor != ''")
def vendor_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.vendors(readers.receipts(spark, sf_dir))


@query("SELECT DISTINCT vendor FROM ledger WHERE vendor != '' ORDER BY vendor LIMIT 50")
def vendor_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.vendor_hints(readers.receipts(spark, sf_dir))


@query("SELECT DISTINCT vendor FROM ledger WHERE contains(lower(vendor), 'blue') ORDER BY vendor LIMIT 6")
def vendor_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.suggest_vendors(readers.receipts(spark, sf_dir), "Blue")


@query(f"""SELECT count(*) AS receipts, {total('pre_tax')} AS pre_tax, {total('gst')} AS gst, {total('qst')} AS qst, {total('pst')} AS pst, {total('hst')} AS hst,
{total('total')} AS total FROM ledger WHERE contains(lower(vendor), 'bolt')""")
def filtered_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.filtered_totals(readers.receipts(spark, sf_dir), "Bolt")


@query("SELECT c.id, c.name, count(l.id) AS receipts FROM categories c LEFT JOIN ledger l ON l.category_id = c.id GROUP BY c.id, c.name")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.category_counts(readers.categories(spark, sf_dir), readers.receipts(spark, sf_dir))


@query("""SELECT date AS "Date", vendor AS "Vendor", coalesce(category, '') AS "Category", CAST(CAST(pre_tax AS DECIMAL(18,2)) AS VARCHAR) AS "Pre-Tax",
CAST(CAST(gst AS DECIMAL(18,2)) AS VARCHAR) AS "GST", CAST(CAST(qst AS DECIMAL(18,2)) AS VARCHAR) AS "QST", CAST(CAST(pst AS DECIMAL(18,2)) AS VARCHAR) AS "PST",
CAST(CAST(hst AS DECIMAL(18,2)) AS VARCHAR) AS "HST", CAST(CAST(total AS DECIMAL(18,2)) AS VARCHAR) AS "Total", currency AS "Currency" FROM of_year""")
def csv_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.csv_rows(readers.receipts(spark, sf_dir), readers.categories(spark, sf_dir), YEAR)


@query(f"""SELECT id, date, left(vendor, 32) AS vendor, left(coalesce(category, ''), 18) AS category, pre_tax, gst, qst, pst, hst, total, 0 AS is_total FROM of_year
UNION ALL SELECT NULL, 'TOTAL', '', '', {total('pre_tax')}, {total('gst')}, {total('qst')}, {total('pst')}, {total('hst')}, {total('total')}, 1 FROM of_year""")
def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.report_ledger(readers.receipts(spark, sf_dir), readers.categories(spark, sf_dir), YEAR)


@query(" UNION ALL ".join(f"SELECT id, '{t}' AS tax, {t} AS amount FROM ledger WHERE {t} > 0" for t in ("gst", "qst", "pst", "hst")))
def paid_taxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.paid_taxes(readers.receipts(spark, sf_dir))


@query("SELECT id, normalized_vendor FROM ledger")
def vendor_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.ledger(spark, sf_dir).select("id", "normalized_vendor")


@query(""", counts AS (SELECT normalized_vendor AS vendor, count(*) AS count, string_split(normalized_vendor, ' ') AS w FROM ledger GROUP BY 1),
keyed AS (SELECT vendor, count, CASE WHEN len(w) >= 2 THEN w[1] || ' ' || w[2] ELSE vendor END AS key FROM counts)
SELECT key, vendor, count, count(*) OVER (PARTITION BY key) AS variants, CAST(sum(count) OVER (PARTITION BY key) AS BIGINT) AS receipts FROM keyed QUALIFY variants >= 2""")
def merge_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.merge_suggestions(readers.receipts(spark, sf_dir))


ALIASES = [(1, "Red Bolt SMALL inc", "Red Bolts"), (2, "blue nut LARGE Ltd.", "Blue Nuts"), (3, "RED  BOLT, small", "Late Name"), (4, "green gear ECONOMY", "Green Gears Inc.")]
_ALIAS_SQL = """, aliases AS (SELECT * FROM (VALUES ('red bolt small', 'Red Bolts', 'red bolts'), ('blue nut large', 'Blue Nuts', 'blue nuts'),
('green gear economy', 'Green Gears Inc.', 'green gears')) t(raw, canonical, normalized))"""


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "id int, raw_name string, canonical_name string")


@query(_ALIAS_SQL + " SELECT id, vendor, coalesce(canonical, vendor) AS resolved FROM ledger LEFT JOIN aliases ON normalized_vendor = raw")
def alias_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.resolve_vendors(readers.ledger(spark, sf_dir).select("id", "vendor"), aliases(spark))


@query(_ALIAS_SQL + " SELECT id, coalesce(canonical, vendor) AS vendor, coalesce(normalized, normalized_vendor) AS normalized_vendor FROM ledger LEFT JOIN aliases ON normalized_vendor = raw")
def alias_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.backfill_aliases(readers.ledger(spark, sf_dir), aliases(spark)).select("id", "vendor", "normalized_vendor")


@query(""", last AS (SELECT normalized_vendor, arg_max(category_id, struct_pack(u := updated_at, i := id)) AS inferred FROM ledger WHERE category_id IS NOT NULL GROUP BY 1)
SELECT id, coalesce(category_id, inferred) AS category_id FROM ledger LEFT JOIN last USING (normalized_vendor)""")
def category_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.receipts(spark, sf_dir)
    return catalog.infer_category(rows, rows).select("id", "category_id")


#: How the parser reads an amount: it takes six digits before the point, so of a longer one the last six.
_READ = "CASE WHEN {0} >= 1000000 THEN CAST(CAST({0} AS DECIMAL(18,2)) % 1000000 AS DOUBLE) ELSE {0} END"
_READ_TAX = "CASE WHEN {0} > 0 AND {0} < " + _READ.format("total") + " THEN {0} END"
_TAXES = ("gst", "qst", "pst", "hst")


@query("SELECT id, vendor, date, " + ", ".join([f"{_READ.format(c)} AS {c}" for c in ("pre_tax", "total")] + [f"{_READ_TAX.format(t)} AS {t}" for t in _TAXES]) + " FROM ledger")
def receipt_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = extraction.anchors(readers.ledger(spark, sf_dir).select("id", F.col("receipt_text").alias("text")))
    return a.select("id", "anchors.*").select("id", "vendor", "date", "pre_tax", "total", "gst", "qst", "pst", "hst")


_PARSED = """, parsed AS (SELECT id, vendor, date, total, confidence,
CASE WHEN id % 4 = 0 THEN round(pre_tax + 0.10, 2) WHEN id % 4 = 1 THEN round(pre_tax + 1.0, 2) WHEN id % 4 = 2 THEN round(pre_tax + 2.5, 2) WHEN id % 8 = 3 THEN 0.0 ELSE pre_tax END AS pre_tax,
CASE WHEN id % 19 = 0 THEN round(total * 0.6, 2) WHEN id % 23 = 0 THEN total ELSE gst END AS gst, qst, pst, hst FROM ledger)"""


@query(_PARSED + """,
taxed AS (SELECT *, CASE WHEN gst > 0 AND gst >= total THEN 'Z' WHEN gst > 0 AND gst > 0.5 * total THEN 'C' END AS wg FROM parsed),
t2 AS (SELECT * REPLACE (CASE WHEN wg IS NULL THEN gst ELSE 0.0 END AS gst) FROM taxed),
t3 AS (SELECT *, round(gst + qst + pst + hst, 2) AS tax FROM t2),
t4 AS (SELECT *, abs(round(pre_tax + tax, 2) - total) AS gap FROM t3),
t5 AS (SELECT *, pre_tax > 0 AND gap > 0.15 AND gap <= 2.0 AS adjust, pre_tax > 0 AND gap > 2.0 AS mismatch, pre_tax = 0 AND tax > 0 AND total - tax > 0 AS infer FROM t4)
SELECT id, CASE WHEN adjust OR infer THEN round(total - tax, 2) ELSE pre_tax END AS pre_tax, gst, total, NOT mismatch AS math_valid,
CAST((CASE WHEN wg IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN adjust OR mismatch OR infer THEN 1 ELSE 0 END) AS INT) AS n_warnings,
round(least(1.0, greatest(0.0, confidence - (CASE WHEN wg IS NOT NULL THEN 0.1 ELSE 0 END) - (CASE WHEN mismatch THEN 0.2 ELSE 0 END)
  + 0.15 + CASE WHEN greatest(gst, qst, hst) > 0 THEN 0.05 ELSE 0 END)), 3) AS confidence FROM t5""")
def post_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pre = "CASE WHEN id % 4 = 0 THEN round(pre_tax + 0.10, 2) WHEN id % 4 = 1 THEN round(pre_tax + 1.0, 2) WHEN id % 4 = 2 THEN round(pre_tax + 2.5, 2) WHEN id % 8 = 3 THEN 0.0D ELSE pre_tax END"
    gst = "CASE WHEN id % 19 = 0 THEN round(total * 0.6, 2) WHEN id % 23 = 0 THEN total ELSE gst END"
    rows = readers.ledger(spark, sf_dir).withColumns({"pre_tax": F.expr(pre), "gst": F.expr(gst)})
    done = extraction.post_process(rows.select("id", F.struct(*extraction.RECEIPT).alias("receipt")), text=None, as_of_year=AS_OF)
    return done.select("id", "receipt.pre_tax", "receipt.gst", "receipt.total", "receipt.math_valid", F.size("receipt.warnings").alias("n_warnings"), "receipt.confidence")


_REVIEW = """, input AS (SELECT id, document_id, category_id, category, confidence, CASE WHEN id % 11 = 0 THEN NULL ELSE date END AS date, CASE WHEN id % 13 = 0 THEN 0 ELSE total END AS total,
CASE WHEN id % 17 = 0 THEN NULL ELSE vendor END AS vendor FROM ledger),
flags AS (SELECT * FROM (SELECT *, concat_ws('|', CASE WHEN confidence < 0.65 THEN 'low_confidence' END, CASE WHEN total <= 0 THEN 'missing_total' END,
  CASE WHEN date IS NULL THEN 'missing_date' END, CASE WHEN vendor IS NULL THEN 'missing_vendor' END) AS reason FROM input) WHERE reason != '')"""


def _review_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.receipts(spark, sf_dir)
    out = {"date": "CASE WHEN id % 11 != 0 THEN date END", "total": "CASE WHEN id % 13 = 0 THEN 0D ELSE total END", "vendor": "CASE WHEN id % 17 != 0 THEN vendor END"}
    return rows.withColumns({c: F.expr(e) for c, e in out.items()})


@query(_REVIEW + " SELECT id AS receipt_id, reason FROM flags")
def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.flag(_review_input(spark, sf_dir))


@query(_REVIEW + """ SELECT id AS receipt_id, reason, 'pending' AS status, CASE WHEN document_id % 7 = 0 THEN 0 ELSE document_id + 1000 END AS source_id, vendor, date, total, confidence,
category_id, category AS category_name, CASE WHEN document_id % 7 != 0 THEN 'https://docs.example/documents/' || CAST(document_id + 1000 AS VARCHAR) END AS source_url FROM flags WHERE id % 3 != 0""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _review_input(spark, sf_dir)
    flags = review.flag(rows).withColumn("status", F.when(F.col("receipt_id") % 3 == 0, "approved").otherwise("pending"))
    return review.queue(flags, rows, readers.sources_of(rows), readers.categories(spark, sf_dir), base_url="https://docs.example")


@query(_REVIEW + " SELECT count(*) AS pending FROM flags WHERE id % 3 != 0")
def review_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = review.flag(_review_input(spark, sf_dir)).withColumn("status", F.when(F.col("receipt_id") % 3 == 0, "approved").otherwise("pending"))
    return review.pending_count(flags)


@query(_REVIEW + """, old AS (SELECT id, 'old' AS reason, CASE WHEN id % 2 = 0 THEN 'pending' ELSE 'approved' END AS status FROM ledger WHERE id % 5 = 0)
SELECT coalesce(o.id, f.id) AS receipt_id, CASE WHEN o.status IS NULL OR (o.status = 'pending' AND f.reason IS NOT NULL) THEN f.reason ELSE o.reason END AS reason,
coalesce(o.status, 'pending') AS status FROM old o FULL JOIN flags f ON o.id = f.id""")
def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = readers.receipts(spark, sf_dir).where("id % 5 = 0").select(F.col("id").alias("receipt_id"), F.lit("old").alias("reason"), F.expr("CASE WHEN id % 2 = 0 THEN 'pending' ELSE 'approved' END").alias("status"))
    return review.merge_flags(old, review.flag(_review_input(spark, sf_dir)))


@query(_REVIEW + " SELECT id AS receipt_id, unnest(string_split(reason, '|')) AS reason FROM flags")
def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.reason_rows(review.flag(_review_input(spark, sf_dir)))


@query("""SELECT count(*) AS processed, count(*) FILTER (id % 10 = 0) AS errors, count(*) FILTER (id % 10 = 1) AS skipped, count(*) FILTER (id % 10 > 3) AS receipts,
count(*) FILTER (id % 10 > 3 AND id % 4 > 0) AS flagged FROM ledger""")
def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.ledger(spark, sf_dir).select(
        F.expr("CASE WHEN id % 10 = 0 THEN 'error' WHEN id % 10 = 1 THEN 'skipped' ELSE 'done' END").alias("status"), F.expr("id % 10 > 3").alias("is_receipt"), F.expr("id % 4").alias("n_warnings")
    )
    return documents.batch_stats(rows)


_BANK = " + ".join(f"CAST(contains(lower(text), '{k}') AS INT)" for k in documents.BANK_KEYWORDS)


@query(rf"""WITH e AS (SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN 'payment due date, minimum payment, annual fee; ' || repeat(coalesce(text, ''), CAST(ceil(200001.0 / greatest(1, length(text))) AS INT)) WHEN doc_id % 6 = 2 THEN left(text, 30)
  WHEN doc_id % 6 = 3 THEN left(text, 100) || repeat('(cid:7)', 20) WHEN doc_id % 6 = 4 THEN left(text, 100) || repeat(chr(7), 30) ELSE text END AS text FROM documents),
d AS (SELECT doc_id, text, length(text) AS n, trim(text, E' \t\n\r') AS s FROM e)
SELECT doc_id, CAST(n AS INT) AS n_chars, length(s) >= 40 AS usable,
length(s) >= 20 AND (doc_id % 6 != 3 OR 160.0 / length(s) <= 0.15) AND (doc_id % 6 != 4 OR (length(s) - 30.0) / length(s) >= 0.85) AS good_text, n > 15000 AS is_large, ({_BANK}) >= 3 AND n > 200000 AS is_statement,
CAST(CASE WHEN n > 15000 THEN 10000 + 36 ELSE n END AS INT) AS parse_chars FROM d""")
def document_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as they are, and in turn statements of more than 200,000 characters, short ones, ones with font codes, and ones with control characters."""
    made = """CASE WHEN doc_id % 6 = 1 THEN concat('payment due date, minimum payment, annual fee; ', repeat(coalesce(text, ''), CAST(ceil(200001D / greatest(1, length(text))) AS INT))) WHEN doc_id % 6 = 2 THEN left(text, 30)
        WHEN doc_id % 6 = 3 THEN concat(left(text, 100), repeat('(cid:7)', 20)) WHEN doc_id % 6 = 4 THEN concat(left(text, 100), repeat(chr(7), 30)) ELSE text END"""
    return documents.gates(readers.table(spark, sf_dir, "documents").select("doc_id", F.expr(made).alias("text")))


@query("WITH d AS (SELECT * FROM documents) SELECT doc_id, CASE WHEN text != '' THEN sha256(text) END AS content_hash FROM d")
def document_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query(r"""WITH d AS (SELECT doc_id, trim(CASE WHEN doc_id % 10 = 0 THEN text || ' (new)' ELSE text END, E' \t\n\r') AS t, trim(text, E' \t\n\r') AS o, doc_id % 4 = 0 AS tagged, doc_id % 3 = 0 AS has FROM documents),
e AS (SELECT *, t != o AND t != '' AS changed, length(t) >= 40 AS has_text, NOT tagged AND has AND doc_id % 5 != 4 AS forced FROM d)
SELECT doc_id, changed OR doc_id % 5 = 4 AS content_changed, has_text, forced, has_text AND NOT forced AS use_stored, forced OR NOT has_text AS needs_ocr,
t != '' AND (changed OR forced OR doc_id % 5 = 4) AS needs_parse FROM e""")
def changed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state that knows four of five documents; one of ten has changed, three of four lost their tag."""
    docs = readers.table(spark, sf_dir, "documents")
    now = docs.select("doc_id", F.expr("CASE WHEN doc_id % 10 = 0 THEN text || ' (new)' ELSE text END").alias("text"), F.expr("doc_id % 4 = 0").alias("tagged"))
    before = text.strip(F.col("text"))
    state = docs.where("doc_id % 5 != 4").select(
        "doc_id", text.content_hash(before).alias("content_hash"), before.alias("ocr_text"), text.content_hash(before).alias("parse_hash"), F.lit(None).cast("string").alias("text_model"), F.expr("doc_id % 3 = 0").alias("has_receipt")
    )
    return documents.changes(now, state).select("doc_id", "content_changed", "has_text", "forced", "use_stored", "needs_ocr", "needs_parse")


@query("""WITH boxes AS (SELECT l_orderkey AS doc_id, CAST(l_partkey % 400 AS DOUBLE) AS y, p_name AS text FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id ORDER BY y, text) < 15 THEN 0 ELSE 1 END AS start FROM boxes),
r AS (SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY y, text ROWS UNBOUNDED PRECEDING) AS row FROM s)
SELECT doc_id, CAST(row AS BIGINT) AS row, string_agg(text, ' ' ORDER BY y, text) AS text FROM r GROUP BY doc_id, row""")
def ocr_row_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = readers.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("text"))
    boxes = readers.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_partkey").join(part, "l_partkey")
    return documents.text_rows(boxes.select("doc_id", (F.col("l_partkey") % 400).cast("double").alias("y"), F.col("text").alias("ord"), "text"))


@query("""SELECT document_id, date || '-' || left(vendor, 60) || '-Receipt' AS title, date || 'T12:00:00Z' AS created,
'{"Amount":"CAD' || CAST(CAST(total AS DECIMAL(18,2)) AS VARCHAR) || '","Vendor":"' || vendor || '","Category":"' || coalesce(category, '') || '","Currency":"CAD"}' AS fields FROM ledger""")
def write_back_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.write_back_rows(readers.receipts(spark, sf_dir), readers.categories(spark, sf_dir))


@query("""SELECT id, CASE WHEN id % 4 = 0 THEN 'New & Co. ' || CAST(id AS VARCHAR) ELSE vendor END AS vendor, CASE WHEN id % 4 = 0 THEN 'new ' || CAST(id AS VARCHAR) ELSE normalized_vendor END AS normalized_vendor,
CASE WHEN id % 20 = 0 THEN NULL WHEN id % 12 = 0 AND id % 20 != 0 THEN 1 ELSE category_id END AS category_id, CASE WHEN id % 4 = 0 THEN 1.5 ELSE total END AS total, CASE WHEN id % 4 = 0 THEN '2034-06-01' ELSE date END AS updated_at FROM ledger WHERE id % 28 != 0
UNION ALL SELECT id, vendor, normalized_vendor, category_id, total, date FROM ledger WHERE id % 28 = 0""")
def receipt_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes to one receipt of four: one of five clears the category, one of three sets it, one of seven names an unknown one."""
    rows = readers.receipts(spark, sf_dir)
    category = "CASE WHEN id % 28 = 0 THEN 99 WHEN id % 20 = 0 THEN 0 WHEN id % 12 = 0 THEN 1 END"
    asked = rows.where("id % 4 = 0").select("id", F.expr("concat('New & Co. ', id)").alias("vendor"), F.lit(1.5).alias("total"), F.expr(category).alias("category_id"))
    return L.patch(rows, asked, readers.categories(spark, sf_dir), F.lit("2034-06-01")).select("id", "vendor", "normalized_vendor", "category_id", "total", "updated_at")


@query("SELECT id, CASE WHEN category_id NOT IN (1, 3) THEN category_id END AS category_id FROM ledger")
def category_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = readers.categories(spark, sf_dir)
    return catalog.delete_categories(names, readers.receipts(spark, sf_dir), names.where("id IN (1, 3)").select("id"))[1].select("id", "category_id")


@query("""SELECT r.id AS receipt_id, CASE WHEN l.document_id IS NULL THEN 'not_found' ELSE 'found' END AS status, l.document_id
FROM (SELECT o_orderkey * 2 AS id FROM orders) r LEFT JOIN ledger l USING (id)""")
def rescan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = readers.table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 2).alias("receipt_id"))
    return L.rescan_status(ids, readers.receipts(spark, sf_dir))


@query("""WITH r AS (SELECT * FROM region) SELECT CAST(NULL AS VARCHAR) AS vision_model, max(r_name) AS text_model, true AS use_stored_text_first, count(*) = 5 AS skip_vision_if_text_exists, min(r_name) = 'x' AS force_rescan FROM r""")
def typed_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings derived from the regions, put over older ones: one missing, one wrong, one that is not a flag."""
    regions = readers.table(spark, sf_dir, "region")
    new = regions.agg(F.max("r_name").alias("text_model"), F.when(F.count("*") == 5, "true").otherwise("no").alias("skip_vision_if_text_exists"), F.min("r_name").alias("force_rescan"))
    new = new.select(F.stack(F.lit(3), *[x for c in new.columns for x in (F.lit(c), F.col(c))]).alias("key", "value"))
    old = spark.createDataFrame([("text_model", "old"), ("skip_vision_if_text_exists", "false")], "key string, value string")
    return catalog.settings(catalog.upsert(old, new, "key"))


@query("""WITH n AS (SELECT c_custkey AS id, CAST(c_acctbal AS DECIMAL(12,2)) AS v FROM customer)
SELECT id, CASE WHEN v < 0 THEN 0.0 ELSE CAST(v AS DOUBLE) END AS amount, CAST(v AS DOUBLE) AS repaired FROM n""")
def amount_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances written with a currency sign, spaces and letters that look like digits."""
    value = F.col("c_acctbal").cast("decimal(12,2)").cast("string")
    ocr = F.concat(F.lit("$ "), F.translate(value, "015862", "OlSBGZ"))
    return readers.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), amounts.to_amount(value).alias("amount"), amounts.fix_ocr_number(ocr).alias("repaired"))


@query(f"""SELECT id, said, CASE WHEN abs(seen - said) > 1 THEN seen ELSE said END AS total, {_READ_TAX.format('gst')} AS gst, vendor
FROM (SELECT *, CASE WHEN id % 3 = 0 THEN round(total + 5, 2) ELSE total END AS said, {_READ.format('total')} AS seen FROM ledger)""")
def merged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider's answers with wrong totals and without taxes or vendors, completed from the text."""
    rows = extraction.anchors(readers.ledger(spark, sf_dir), "receipt_text")
    said = F.expr("CASE WHEN id % 3 = 0 THEN round(total + 5, 2) ELSE total END")
    none = F.lit(None).cast("double")
    answer = F.struct(F.lit("").alias("date"), F.lit(None).cast("string").alias("vendor"), said.alias("total"), none.alias("pre_tax"), *[none.alias(t) for t in _TAXES], F.lit("CAD").alias("currency"), F.lit(0.5).alias("confidence"))
    rows = rows.withColumn("answer", answer)
    merged = rows.withColumn("m", extraction.merged_answer(F.col("answer"), F.col("anchors")))
    return merged.select("id", "answer.total", "m").select("id", F.col("total").alias("said"), "m.total", "m.gst", "m.vendor")


@query("""SELECT id, CASE id % 4 WHEN 0 THEN 'Amazon' WHEN 1 THEN 'Bell' WHEN 2 THEN 'Virgin Plus' END AS by_domain,
CASE id % 4 WHEN 0 THEN 'Amazon' WHEN 1 THEN 'Bell' WHEN 2 THEN 'Virgin Plus' WHEN 3 THEN 'Koodo' END AS by_late_domain,
CASE id % 3 WHEN 0 THEN 'Metro' WHEN 1 THEN 'Hydro-Quebec' END AS by_name, CASE id % 5 WHEN 0 THEN 'eBay' WHEN 1 THEN 'Amazon' WHEN 2 THEN 'PayPal' WHEN 3 THEN 'Etsy' END AS by_marketplace,
CASE WHEN id % 4 = 0 THEN 'Costco' WHEN id % 4 = 1 THEN 'unknown' WHEN id % 4 = 2 THEN 'My Own Shop ' || CAST(id AS VARCHAR) ELSE 'Hydro-Québec' END AS by_logo FROM ledger""")
def dictionary_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold one, two or no keys of each dictionary. The first key of the table wins, for the late domains the longest one."""
    rows = readers.ledger(spark, sf_dir)
    pick = lambda n, *texts: F.get(F.array(*map(F.lit, texts)), F.pmod("id", F.lit(n)).cast("int"))
    site = F.concat(pick(4, "see https://WWW.Amazon.ca/x or koodo", "bill@bell.ca, koodo", "virginplus.ca, not bell.ca", "ask koodo"), F.lit(" no. "), F.col("id").cast("string"))
    lines = F.array(F.lit("welcome"), pick(3, "GAZ METRO", "HYDRO-QUÉBEC", "nothing"), F.col("id").cast("string"))
    order = F.concat(pick(5, "Order from eBay", "Sold by some AMAZON unit", "PAYPAL  receipt", "Étsy order", "by hand"), F.lit(" "), F.col("id").cast("string"))
    said = F.when(F.col("id") % 4 == 2, F.concat(F.lit("MY OWN SHOP "), F.col("id").cast("string"))).otherwise(pick(4, '"COSTCO wholesale"', "unknown", "", "Hydro"))
    return rows.select("id", vendors.by_domain(site).alias("by_domain"), vendors.by_late_domain(site).alias("by_late_domain"), vendors.by_known_name(lines).alias("by_name"), vendors.by_marketplace(order).alias("by_marketplace"), vendors.logo_vendor(said).alias("by_logo"))


@query(f"""SELECT id AS doc_id, 'done' AS last_status, true AS has_receipt, CASE WHEN id % 10 = 0 THEN date END AS date, CASE WHEN id % 10 = 0 THEN vendor END AS vendor,
CASE WHEN id % 10 = 0 THEN {_READ.format('total')} END AS total, CASE WHEN id % 10 = 0 THEN true END AS parsed_again FROM ledger""")
def incremental_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the same receipts' texts, one in ten changed in between: what the second run parses, and the states."""
    texts = readers.ledger(spark, sf_dir).select(F.col("id").alias("doc_id"), F.col("receipt_text").alias("text"), F.lit(True).alias("tagged"))
    state, _ = incremental.process(texts, spark.createDataFrame([], readers.STATE), as_of_year=AS_OF)
    later = texts.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("\nthank you"))).otherwise(F.col("text")))
    state, again = incremental.process(later, state, as_of_year=AS_OF)
    parsed = again.select("doc_id", "date", "vendor", "total", F.lit(True).alias("parsed_again"))
    return state.select("doc_id", "last_status", "has_receipt").join(parsed, "doc_id", "left")


NOW = "2034-06-01"
_SPOILT = "Corner Shop\nthank you for your visit, and come again soon"
#: A batch over all receipts' texts: one in ten has a word more, one in twenty has lost its amounts and date, one in nine is new.
_INGEST = f""", batch AS (SELECT *, id % 10 = 0 OR id % 9 = 0 AS touched, id % 9 = 0 AS fresh, id % 20 = 0 AS spoilt FROM ledger),
merged AS (SELECT id, document_id, touched, CASE WHEN spoilt THEN 'Corner Shop' ELSE vendor END AS vendor, CASE WHEN spoilt THEN 'corner shop' ELSE normalized_vendor END AS normalized_vendor,
  CASE WHEN NOT spoilt THEN date END AS date, CASE WHEN spoilt THEN 0 WHEN touched THEN {_READ.format('total')} ELSE total END AS total, CASE WHEN NOT fresh THEN category_id END AS category_id,
  CASE WHEN touched THEN '{NOW}' ELSE date END AS updated_at, CASE WHEN fresh THEN '{NOW}' ELSE date END AS created_at, spoilt, total AS written FROM batch),
last AS (SELECT normalized_vendor, arg_max(category_id, struct_pack(u := updated_at, i := id)) AS inferred FROM merged WHERE category_id IS NOT NULL GROUP BY 1),
after AS (SELECT m.* EXCLUDE category_id, CASE WHEN touched THEN coalesce(category_id, inferred) ELSE category_id END AS category_id FROM merged m LEFT JOIN last USING (normalized_vendor))"""


def written_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with its texts as a table of its own: documents, states and receipts come from it, and each would join the given tables again."""
    path = fresh_folder(spark, "receipts")
    write(readers.receipts(spark, sf_dir), path)
    return spark.read.parquet(path)


def _ingested(spark: SparkSession, sf_dir: str) -> incremental.Ingested:
    rows = written_receipts(spark, sf_dir)
    said = F.when(F.col("id") % 20 == 0, F.lit(_SPOILT)).when(F.col("id") % 10 == 0, F.concat("receipt_text", F.lit("\nthank you"))).otherwise(F.col("receipt_text"))
    docs = rows.select(F.col("id").alias("doc_id"), said.alias("text"), F.lit(True).alias("tagged"))
    old = rows.where("id % 9 != 0").withColumn("created_at", F.col("date"))
    before = text.content_hash(F.col("receipt_text"))
    none = F.lit(None).cast("string")
    state = old.select(
        F.col("id").alias("doc_id"), before.alias("content_hash"), F.col("receipt_text").alias("ocr_text"), before.alias("parse_hash"), none.alias("text_model"),
        F.lit("done").alias("last_status"), none.alias("error_message"), F.lit(True).alias("has_receipt"),
    )
    flags = old.where("id % 50 = 0").select(F.lit(None).cast("long").alias("id"), F.col("id").alias("receipt_id"), F.lit("old").alias("reason"), F.lit("approved").alias("status"), none.alias("reviewed_at"), F.col("date").alias("created_at"))
    return incremental.ingest(docs, state, old.drop("receipt_text"), flags, readers.categories(spark, sf_dir), as_of_year=AS_OF, now=F.lit(NOW))


@query(_INGEST + " SELECT id, document_id, vendor, normalized_vendor, date, total, category_id, updated_at, created_at FROM after")
def ingest_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).receipts.select("id", "document_id", "vendor", "normalized_vendor", "date", "total", "category_id", "updated_at", "created_at")


@query(_INGEST + f""" SELECT id AS receipt_id, CASE WHEN id % 50 = 0 AND id % 9 != 0 THEN 'old' ELSE 'low_confidence|missing_total|missing_date' END AS reason,
CASE WHEN id % 50 = 0 AND id % 9 != 0 THEN 'approved' ELSE 'pending' END AS status, CASE WHEN id % 50 = 0 AND id % 9 != 0 THEN (SELECT date FROM ledger l WHERE l.id = after.id) ELSE '{NOW}' END AS created_at
FROM after WHERE spoilt OR (id % 50 = 0 AND id % 9 != 0)""")
def ingest_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).flags.select("receipt_id", "reason", "status", "created_at")


@query(_INGEST + """ SELECT document_id, 'receipt-processed' AS tag, date || '-' || left(vendor, 50) || '-Receipt' AS title,
'{"Vendor":"' || vendor || '","Amount":"' || CASE WHEN total = 0 THEN '0' ELSE regexp_replace(CAST(CAST(total AS DECIMAL(18,2)) AS VARCHAR), '0$', '') END || '","Category":"' || coalesce(c.name, '') || '","Currency":"CAD"}' AS fields
FROM after LEFT JOIN categories c ON after.category_id = c.id WHERE touched""")
def ingest_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).write_back


@query(_INGEST + " SELECT count(*) AS processed, 0 AS errors, 0 AS skipped, count(*) AS receipts, count(*) FILTER (spoilt OR (touched AND written >= 1000000)) AS flagged FROM after")
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).stats


@query("""SELECT id AS doc_id, CASE WHEN id % 2 = 0 THEN 'processing' WHEN id % 3 = 0 THEN 'error' ELSE 'done' END AS last_status FROM ledger WHERE id % 2 = 0 OR id % 5 != 0""")
def document_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of half the documents, one in five of them new."""
    rows = readers.ledger(spark, sf_dir).select(F.col("id").alias("doc_id"))
    state = rows.where("doc_id % 5 != 0").withColumn("last_status", F.expr("CASE WHEN doc_id % 3 = 0 THEN 'error' ELSE 'done' END"))
    return documents.enqueue(state, rows.where("doc_id % 2 = 0"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND n >= 40 THEN 'pdf_direct' WHEN doc_id % 5 <= 2 AND length(s) >= 40 THEN 'engine' WHEN doc_id % 5 <= 3 THEN 'vision_small' WHEN n >= 40 THEN 'stored_fallback' ELSE 'failed' END AS method,
CASE WHEN doc_id % 5 = 0 AND n >= 40 THEN n WHEN doc_id % 5 <= 2 AND length(s) >= 40 THEN n + CASE WHEN doc_id % 5 = 1 THEN 35 ELSE 0 END WHEN doc_id % 5 <= 3 THEN 4 WHEN n >= 40 THEN n ELSE 0 END AS n_chars
FROM (SELECT doc_id, coalesce(length(text), 0) AS n, trim(coalesce(text, ''), E' \\t\\n\\r') AS s FROM documents)""".replace("SELECT doc_id, CASE", "WITH d AS (SELECT 1) SELECT doc_id, CASE", 1))
def chosen_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers of images would give: embedded text for one in five, an engine's for three, with a second look for one, a vision reader's for four."""
    body, k = F.col("text"), F.col("doc_id") % 5
    chosen = documents.chosen_text(F.when(k == 0, body), F.when(k <= 2, body), F.when(k <= 3, F.lit("seen")), F.lit("small"), body, bottom=F.lit("Total 5.00"), has_total=k != 1)
    return readers.table(spark, sf_dir, "documents").select("doc_id", chosen.alias("x")).select("doc_id", "x.method", F.length("x.text").cast("long").alias("n_chars"))


@query("SELECT id, CASE id % 4 WHEN 0 THEN 'Real Shop ' || CAST(id AS VARCHAR) WHEN 1 THEN 'My Store' WHEN 2 THEN vendor ELSE 'Target' END AS vendor FROM ledger")
def first_line_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines after a buyer's label are passed over unread, even where they are labels themselves."""
    t = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    lines = F.when(F.col("id") % 4 == 0, t("Bill to:", "ACME LTD", F.concat(F.lit("Real Shop "), F.col("id").cast("string")))).when(F.col("id") % 4 == 1, t("Ship to: someone", "514-555-1234", "12 Main street", "ab", "MY STORE"))
    lines = lines.when(F.col("id") % 4 == 2, t("RECEIPT", "Invoice 7", F.col("vendor"))).otherwise(t("Sold to:", "Bill to:", "Target"))
    return readers.ledger(spark, sf_dir).select("id", vendors.by_first_line(lines).alias("vendor"))


@query("""SELECT id, CASE WHEN id % 2 = 0 THEN '2002-03-04' ELSE date END AS found, CASE WHEN id % 3 = 0 THEN (CASE WHEN id % 2 = 0 THEN '2002-03-04' ELSE date END) ELSE date END AS date,
CASE WHEN id % 5 = 0 THEN 'Bell' ELSE vendor END AS vendor, CAST(CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS n_warnings FROM ledger""")
def late_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts that lack a date or vendor, repaired from the text: labels on a line or the one before decide on dates, a domain names the vendor."""
    lines = [F.lit("Print date 2001-02-03"), F.lit("x"), F.concat(F.lit("Bill date: "), F.col("date")), F.when(F.col("id") % 2 == 1, "y"), F.lit("Seen 2002-03-04 10:15"), F.lit("koodo is part of bell.ca"), F.lit("end")]
    rows = readers.ledger(spark, sf_dir).withColumn("text", F.concat_ws("\n", *lines))
    found = extraction.late_date(F.col("text"), AS_OF)
    rows = rows.withColumns({"found": found, "date": F.expr("CASE WHEN id % 3 != 0 THEN date END"), "vendor": F.expr("CASE WHEN id % 5 = 0 THEN 'N/A' ELSE vendor END")})
    done = extraction.post_process(rows.select("id", "text", "found", F.struct(*extraction.RECEIPT).alias("receipt")), as_of_year=AS_OF)
    return done.select("id", "found", "receipt.date", "receipt.vendor", F.size("receipt.warnings").alias("n_warnings"))


@query("""SELECT id, CASE id % 6 WHEN 4 THEN 'Cafe De La Gare ' || CAST(id AS VARCHAR) WHEN 5 THEN vendor END AS vendor, vendor AS folded,
CAST(id AS VARCHAR) || '.50 and 1,234 and 1.23,45 and 7.05' AS decimals, '{"a": {"b": {"c": ' || CAST(id AS VARCHAR) || '}}}' AS answer,
CASE WHEN id % 2 = 0 THEN date || '-' || left(vendor, 50) || '-Receipt' END AS title FROM ledger""")
def text_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors for display without placeholders, capitals and accents; folded letters; French decimals; the object in an answer; titles."""
    number = F.col("id").cast("string")
    names = F.get(F.array(F.lit(" Receipt "), F.lit("12345"), F.lit("n/a"), F.lit("TAX INVOICE"), F.concat(F.lit(" CAFÉ  DE LA GARE "), number), F.col("vendor")), (F.col("id") % 6).cast("int"))
    accented = F.translate("vendor", "aeiouAEIOU", "àéîöüÀÉÎÖÜ")
    answer = F.concat(F.lit('So:\n```json\n{"a": {"b": {"c": '), number, F.lit("}}} and } more {\n```"))
    return readers.ledger(spark, sf_dir).select(
        "id", text.clean_vendor(names).alias("vendor"), text.strip_accents(accented).alias("folded"), amounts.french_decimals(F.concat(number, F.lit(",50 and 1,234 and 1,23,45 and 7,05"))).alias("decimals"),
        providers.answer_json(answer).alias("answer"), text.pipeline_title(F.when(F.col("id") % 2 == 0, F.col("date")).otherwise(""), F.concat(F.lit('<"'), F.col("vendor"))).alias("title"),
    )


@query(f""", r AS (SELECT *, id % 6 = 0 AS bare, {_READ.format('total')} AS seen, {_READ.format('pre_tax')} AS pre, {', '.join(f'{_READ_TAX.format(t)} AS r_{t}' for t in _TAXES)} FROM ledger)
SELECT id, vendor, CASE WHEN bare THEN 0 ELSE seen END AS total, 'CAD' AS currency, CASE WHEN bare THEN 0.4 WHEN coalesce(r_gst, r_qst, r_pst, r_hst) > 0 THEN 0.85 ELSE 0.75 END AS confidence,
concat_ws(chr(10), 'Vendor: ' || vendor, 'Date: ' || date, CASE WHEN NOT bare THEN 'Total: ' || CAST(seen AS VARCHAR) END, CASE WHEN NOT bare THEN 'Pre-tax: ' || CAST(pre AS VARCHAR) END,
  CASE WHEN NOT bare THEN 'GST/TPS: ' || CAST(r_gst AS VARCHAR) END, CASE WHEN NOT bare THEN 'QST/TVQ: ' || CAST(r_qst AS VARCHAR) END, CASE WHEN NOT bare THEN 'PST: ' || CAST(r_pst AS VARCHAR) END, CASE WHEN NOT bare THEN 'HST: ' || CAST(r_hst AS VARCHAR) END) AS context FROM r""")
def deterministic_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of anchors alone, one in six without amounts, and what a provider's prompt would say of them."""
    said = F.when(F.col("id") % 6 == 0, F.concat_ws("\n", "vendor", F.concat(F.lit("Date: "), F.col("date")))).otherwise(F.col("receipt_text"))
    rows = extraction.anchors(readers.ledger(spark, sf_dir).select("id", said.alias("text")))
    made = rows.select("id", extraction.deterministic_receipt(F.col("anchors")).alias("r"), extraction.prompt_context(F.col("anchors")).alias("context"))
    return made.select("id", "r.vendor", "r.total", "r.currency", "r.confidence", "context")


@query("""SELECT id, CASE WHEN id % 3 = 0 THEN 0.0 WHEN id % 3 = 1 THEN total ELSE 0.0 END AS total, CASE WHEN id % 2 = 0 THEN vendor END AS vendor, CASE WHEN id % 4 = 0 THEN 'USD' ELSE 'CAD' END AS currency,
CASE id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.46 WHEN 3 THEN 0.5 ELSE 0.0 END AS confidence FROM ledger""")
def clean_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with negative and unreadable amounts, blanks, long currencies and confidences out of range."""
    pick = lambda n, *x: F.get(F.array(*[F.lit(v) if isinstance(v, str | None) else v for v in x]), (F.col("id") % n).cast("int"))
    said = {f: F.lit("0") for f in ("pre_tax", *_TAXES)}
    said |= {"total": pick(3, "-5.00", F.col("total").cast("string"), "no number"), "vendor": F.when(F.col("id") % 2 == 0, F.concat(F.lit("  "), F.col("vendor"), F.lit(" "))).otherwise(""), "date": F.lit("")}
    said |= {"currency": pick(4, "usdollar", "cad", None, "CAD"), "confidence": pick(5, "7", "-1", "0.456", "high", None)}
    raw = F.struct(*[said[c].cast("string").alias(c) for c in extraction.RECEIPT])
    return readers.ledger(spark, sf_dir).select("id", extraction.clean_answer(raw).alias("r")).select("id", "r.total", "r.vendor", "r.currency", "r.confidence")


@query("""WITH d AS (SELECT doc_id, text FROM documents) SELECT doc_id, doc_id % 3 = 0 OR coalesce(starts_with(text, '%PDF'), false) AS is_pdf, doc_id % 4 = 1 AS is_tagged,
CASE doc_id % 4 WHEN 0 THEN 'b' WHEN 1 THEN 'unknown' WHEN 2 THEN 'unknown' ELSE 'a' END AS label, sha256(text) AS unchanged FROM d WHERE text != '' UNION ALL
SELECT doc_id, doc_id % 3 = 0, doc_id % 4 = 1, CASE doc_id % 4 WHEN 0 THEN 'b' WHEN 1 THEN 'unknown' WHEN 2 THEN 'unknown' ELSE 'a' END, NULL FROM d WHERE text IS NULL OR text = ''""")
def document_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of files, the receipt tag among others or plain ids, and a logo's likeliest label."""
    k = F.col("doc_id") % 4
    file = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("%PDF-1.4 "), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit(""))).cast("binary")
    tag = lambda i, name: F.struct(F.lit(i).alias("id"), F.lit(name).cast("string").alias("name"))
    tags = F.when(k == 1, F.array(tag(1, "other"), tag(2, "receipt-processed"))).when(k == 2, F.array(tag(2, None))).when(k == 3, F.array(tag(1, "other")))
    row = lambda *x: F.array(*map(F.lit, x))
    scores = F.when(k == 0, row(0.1, 0.7, 0.2)).when(k == 1, row(0.1, 0.1, 0.8)).when(k == 2, row(0.14, 0.1, 0.1)).otherwise(row(0.4, 0.4, 0.2))
    docs = readers.table(spark, sf_dir, "documents").withColumn("file", file)
    return docs.select("doc_id", documents.is_pdf("file").alias("is_pdf"), documents.is_tagged(tags).alias("is_tagged"), documents.best_label(scores, ["a", "b", "unknown"]).alias("label"), text.content_hash(F.col("text")).alias("unchanged"))


@query("""SELECT document_id AS doc_id, CASE WHEN id % 3 = 0 THEN '4,7,9' ELSE '9' END AS tags,
concat_ws(';', '1=CAD' || CAST(CAST(total AS DECIMAL(18,2)) AS VARCHAR), CASE WHEN id % 3 = 0 THEN '2=3.5' ELSE '2=3.5' END, '3=' || vendor, CASE WHEN id % 3 = 0 THEN '5=kept' END) AS fields FROM ledger""")
def write_back_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tags and custom fields a document has after a write-back: one in three had some; names without a field are left out."""
    rows = readers.ledger(spark, sf_dir)
    fields = F.create_map(*[x for n, v in (("Amount", F.concat(F.lit(" CAD"), F.col("total").cast("decimal(18,2)").cast("string"))), ("Count", F.lit("-3.5x")), ("Vendor", F.col("vendor")), ("Nothing", F.lit("x"))) for x in (F.lit(n), v)])
    updates = rows.select(F.col("document_id").alias("doc_id"), F.array(F.lit(9)).alias("tag_ids"), fields.alias("fields"))
    tag = lambda i: F.struct(F.lit(i).alias("id"), F.lit(None).cast("string").alias("name"))
    pair = lambda f, v: F.struct(F.lit(f).alias("field"), F.lit(v).alias("value"))
    held = rows.where("id % 3 = 0").select(F.col("document_id").alias("doc_id"), F.array(tag(7), tag(4), tag(9)).alias("tags"), F.array(pair(3, "old"), pair(5, "kept")).alias("custom_fields"))
    known = spark.createDataFrame([("Amount", 1, "monetary"), ("Count", 2, "float"), ("Vendor", 3, "text")], "name string, field int, data_type string")
    merged = sinks.merged_payload(updates, held, known)
    shown = F.transform("custom_fields", lambda x: F.concat(x["field"].cast("string"), F.lit("="), x["value"]))
    return merged.select("doc_id", F.array_join(F.col("tags").cast("array<string>"), ",").alias("tags"), F.array_join(shown, ";").alias("fields"))


@query("""SELECT id, CASE WHEN id = 2 THEN 'Renamed' ELSE name END AS name FROM categories UNION ALL SELECT CAST(last + row_number() OVER (ORDER BY name) AS INT), name
FROM (SELECT DISTINCT r_name AS name FROM region), (SELECT max(id) AS last FROM categories)""")
def category_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category for each region, written with spaces, one twice, some blank and one that is there already; and a new name for one."""
    names = readers.categories(spark, sf_dir)
    asked = readers.table(spark, sf_dir, "region").select(F.concat(F.lit(" "), F.col("r_name"), F.lit("\t")).alias("name"))
    asked = asked.union(asked).union(names.select("name")).union(spark.createDataFrame([("  ",), (None,)], "name string"))
    changed = catalog.rename_category(names, spark.createDataFrame([(2, " Renamed "), (3, " "), (99, "x")], "id int, name string"))
    return catalog.create_categories(names, asked).join(changed.select("id", F.col("name").alias("new")), "id", "left").select("id", F.coalesce("new", "name").alias("name"))


@query(""", a AS (SELECT n_nationkey + 1 AS id, n_name AS raw_name, CASE WHEN n_nationkey % 3 = 0 THEN 'New ' || n_name ELSE 'Old ' || n_name END AS canonical_name FROM nation),
b AS (SELECT 25 + row_number() OVER (ORDER BY lower(r_name)) AS id, r_name AS raw_name, r_name || ' Group' AS canonical_name FROM region)
SELECT id, raw_name, lower(raw_name) AS normalized_raw, canonical_name, lower(canonical_name) AS normalized_canonical FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE id % 4 != 1""")
def alias_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of nations; one in three gets a new name, regions are added, one in four is deleted; keys are worked out anew afterwards."""
    nations = readers.table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("int").alias("id"), F.col("n_name").alias("raw_name"))
    old = nations.select("id", "raw_name", text.normalize_vendor(F.col("raw_name")).alias("normalized_raw"), F.concat(F.lit("Old "), F.col("raw_name")).alias("canonical_name"))
    old = old.withColumns({"normalized_canonical": text.normalize_vendor(F.col("canonical_name")), "created_at": F.lit(None).cast("timestamp_ntz")})
    new = nations.where("(id - 1) % 3 = 0").select(F.upper("raw_name").alias("raw_name"), F.concat(F.lit("New "), F.col("raw_name")).alias("canonical_name"))
    new = new.union(readers.table(spark, sf_dir, "region").select("r_name", F.concat("r_name", F.lit(" Group"))))
    after = catalog.delete_aliases(catalog.upsert_aliases(old, new), nations.where("id % 4 = 1").union(spark.createDataFrame([(29, "")], "id int, raw_name string")).select("id"))
    keys = catalog.alias_keys(after)
    return after.select("id", "raw_name", "canonical_name", "normalized_raw").join(keys.select("normalized_raw", "normalized_canonical"), "normalized_raw")


@query(_REVIEW + f""", marked AS (SELECT id, reason FROM flags UNION ALL SELECT id, 'manual' FROM input WHERE id % 6 = 0 AND id NOT IN (SELECT id FROM flags))
SELECT id AS receipt_id, reason, CASE WHEN id % 3 = 0 THEN 'approved' WHEN id % 5 = 0 THEN 'rejected' ELSE 'pending' END AS status, CASE WHEN id % 3 = 0 OR id % 5 = 0 THEN '{NOW}' END AS reviewed_at FROM marked""")
def review_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags, some set by hand, then approved or rejected; other actions and receipts that are not there change nothing."""
    rows = _review_input(spark, sf_dir)
    none = F.lit(None).cast("string")
    flags = review.flag(rows).select("receipt_id", "reason", F.lit("pending").alias("status"), none.alias("reviewed_at"), none.alias("created_at"))
    asked = rows.where("id % 6 = 0").select(F.col("id").alias("receipt_id"))
    flags = review.flag_by_hand(flags, rows, asked.union(spark.createDataFrame([(-1,)], "receipt_id long")), F.lit(NOW))
    said = F.expr("CASE WHEN id % 3 = 0 THEN 'approved' WHEN id % 5 = 0 THEN 'rejected' ELSE 'postponed' END")
    return review.resolve(flags, rows.select(F.col("id").alias("receipt_id"), said.alias("action")), F.lit(NOW)).drop("created_at")

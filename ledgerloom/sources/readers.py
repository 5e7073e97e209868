"""Readers: tables by path, documents with normalised tags, and the ledger that the fixture tables give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import normalize_vendor

RECEIPTS = (
    "id long, document_id long, vendor string, normalized_vendor string, date string, pre_tax double, gst double, qst double, pst double, "
    "hst double, total double, currency string, category_id int, confidence double, created_at timestamp_ntz, updated_at timestamp_ntz"
)
CATEGORIES = "id int, name string, created_at timestamp_ntz"
ALIASES = "id int, raw_name string, normalized_raw string, canonical_name string, normalized_canonical string, created_at timestamp_ntz"
FLAGS = "id long, receipt_id long, reason string, status string, reviewed_at timestamp_ntz, created_at timestamp_ntz"
CONFIG = "id int, key string, value string, updated_at timestamp_ntz"
STATE = "doc_id long, content_hash string, ocr_text string, parse_hash string, text_model string, last_status string, error_message string, has_receipt boolean"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def upgraded(receipts: DataFrame) -> DataFrame:
    """receipts of an older layout with the columns added since, at their defaults."""
    added = {"qst": F.lit(0.0), "currency": F.lit("CAD")}
    return receipts.withColumns({c: v for c, v in added.items() if c not in receipts.columns})


def binary_documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, length and content of files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents as a document manager hands them out: tags as objects or as plain ids, custom fields as pairs."""
    schema = "id long, content string, tags string, custom_fields array<struct<field:int, value:string>>"
    raw = spark.read.schema(schema).json(path)
    named = F.from_json("tags", "array<struct<id:int,name:string>>")
    plain = F.transform(F.from_json("tags", "array<int>"), lambda i: F.struct(i.alias("id"), F.lit(None).cast("string").alias("name")))
    return raw.withColumn("tags", F.when(F.col("tags").rlike(r"^\s*\[\s*[0-9]"), plain).otherwise(named))


#: One receipt for each order with line items; sums stay decimal to the end. In braces: the tables.
LEDGER_SQL = """
WITH li AS (
  SELECT l_orderkey, min(l_partkey) AS pk,
    sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))) AS pre,
    sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))) * CAST(l_tax AS DECIMAL(4,2))) AS tax
  FROM {lineitem} GROUP BY l_orderkey),
b AS (
  SELECT o_orderkey AS id, concat(p_name, ' ', p_type, ' Inc.') AS vendor,
    CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL '240' MONTH AS DATE) AS STRING) AS date,
    CAST(round(pre, 2) AS DECIMAL(18,2)) AS pre_d, CAST(round(tax, 2) AS DECIMAL(18,2)) AS tax_d,
    c_nationkey % 4 AS jur, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE c_mktsegment END AS category
  FROM {orders} JOIN li ON o_orderkey = l_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {part} ON pk = p_partkey)
SELECT id, id AS document_id, vendor, date, CAST(pre_d AS DOUBLE) AS pre_tax,
  CAST(CASE WHEN jur = 0 THEN tax_d ELSE 0 END AS DOUBLE) AS gst, CAST(CASE WHEN jur = 1 THEN tax_d ELSE 0 END AS DOUBLE) AS qst,
  CAST(CASE WHEN jur = 2 THEN tax_d ELSE 0 END AS DOUBLE) AS pst, CAST(CASE WHEN jur = 3 THEN tax_d ELSE 0 END AS DOUBLE) AS hst,
  CAST(pre_d + tax_d AS DOUBLE) AS total, category, 'CAD' AS currency, (id % 50) / CAST(50 AS DOUBLE) AS confidence,
  concat(vendor, chr(10), 'Date: ', date, chr(10), 'Subtotal ', CAST(pre_d AS STRING), chr(10),
    CASE jur WHEN 0 THEN 'GST ' WHEN 1 THEN 'QST ' WHEN 2 THEN 'PST ' ELSE 'HST ' END, CAST(tax_d AS STRING), chr(10),
    'TOTAL ', CAST(pre_d + tax_d AS STRING)) AS receipt_text
FROM b
"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts with the text they were read from, and with category names instead of ids."""
    rows = spark.sql(LEDGER_SQL, **{t: table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "part")})
    return rows.withColumns({"normalized_vendor": normalize_vendor(F.col("vendor")), "updated_at": F.col("date")})


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and name of the ledger's categories, numbered by name. The names are the few market segments."""
    from pyspark.sql import Window

    names = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).where("name IS NOT NULL").distinct()
    return names.select(F.row_number().over(Window.orderBy("name")).alias("id"), "name")


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with category ids."""
    named = categories(spark, sf_dir).select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return ledger(spark, sf_dir).join(named, "category", "left").drop("category")


def sources_of(receipts: DataFrame) -> DataFrame:
    """The source documents of receipts: id and source_id (0 for one in seven, which then has no address)."""
    return receipts.select(F.col("document_id").alias("id"), F.when(F.col("document_id") % 7 == 0, 0).otherwise(F.col("document_id") + 1000).alias("source_id"))

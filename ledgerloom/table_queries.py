"""Registered queries of sources, the bucketed store, pages, search, delivery and streams, and the SQL that they are compared with.

Each derives what it reads from whole tables, writes it as Spark would find it (pages, files, a store) to the shared folder, and reads it back.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import ledger as L
from ledgerloom.operators import pages, rollups, search
from ledgerloom.plans import providers
from ledgerloom.queries import _INGEST, _READ, _SPOILT, AS_OF, NOW, YEAR, query, total, written_receipts
from ledgerloom.sources import delivery, paged, readers, sinks
from ledgerloom.sources.buckets import Store
from ledgerloom.sources.folders import fresh_folder
from ledgerloom.streaming import incremental, store

#: The ledger's times are texts here, as its dates are.
RECEIPTS = readers.RECEIPTS.replace("timestamp_ntz", "string")
FLAGS = readers.FLAGS.replace("timestamp_ntz", "string")


def _buckets(spark: SparkSession, sf_dir: str) -> int:
    """Buckets for a receipt of each order."""
    return store.buckets_for(readers.table(spark, sf_dir, "orders").count())


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda i, name: F.struct(F.lit(i).alias("id"), F.lit(name).cast("string").alias("name"))
    tags = F.when(F.col("doc_id") % 2 == 0, F.array(tag(1, "receipt"))).otherwise(F.array(tag(1, None), tag(2, None)))
    none = F.lit(None).cast("array<struct<field:int,value:string>>")
    docs = readers.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), tags.alias("tags"), none.alias("custom_fields"))
    path = fresh_folder(spark, "pages")
    paged.record(docs, path, 100)
    return paged.documents(spark, path=path, page_size=100, pages_per_partition=4)


@query("WITH d AS (SELECT * FROM documents) SELECT doc_id, sha256(text) AS content_hash, CAST(1 + doc_id % 2 AS INT) AS n_tags FROM d")
def paged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, from pages."""
    return _recorded(spark, sf_dir).select(F.col("id").alias("doc_id"), F.sha2("content", 256).alias("content_hash"), F.size("tags").alias("n_tags"))


@query("WITH d AS (SELECT * FROM documents WHERE doc_id IN (3, 14, 159, 653, 9999999)) SELECT doc_id, sha256(text) AS content_hash FROM d")
def paged_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few documents, each from its own page."""
    found = paged.lookup(_recorded(spark, sf_dir), 3, 14, 159, 653, 9999999)
    return found.select(F.col("id").alias("doc_id"), F.sha2("content", 256).alias("content_hash"))


@query("""WITH d AS (SELECT doc_id % 50 AS part, doc_id, CAST(doc_id AS VARCHAR) || ':' || coalesce(sha256(text), '') AS line FROM documents),
f AS (SELECT part, string_agg(line, chr(10) ORDER BY doc_id) || chr(10) AS content FROM d GROUP BY part)
SELECT CAST(part AS INT) AS part, CAST(length(content) AS BIGINT) AS n_bytes, sha256(content) AS content_hash FROM f""")
def binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of documents' hashes, read as bytes."""
    path, part = fresh_folder(spark, "files"), (F.col("doc_id") % 50).alias("part")
    lines = readers.table(spark, sf_dir, "documents").select(part, "doc_id", F.concat("doc_id", F.lit(":"), F.coalesce(F.sha2("text", 256), F.lit(""))).alias("value"))
    lines.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(path)
    found = readers.binary_documents(spark, f"{path}/*", "*.txt")
    return found.select(F.regexp_extract("path", "part=([0-9]+)", 1).cast("int").alias("part"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("content_hash"))


@query("SELECT id, CAST(0 AS DOUBLE) AS qst, 'CAD' AS currency, gst FROM ledger")
def upgraded_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of the first layout, which had neither QST nor currency."""
    path = fresh_folder(spark, "old")
    readers.ledger(spark, sf_dir).select("id", "gst").write.parquet(path)
    return readers.upgraded(spark.read.parquet(path)).select("id", "qst", "currency", "gst")


#: Receipts of the ledger, of which one in four is patched and one in eleven deleted afterwards.
_EDITED = f""", patched AS (SELECT id, document_id, date, pre_tax, gst, qst, pst, hst, CASE WHEN hit AND id % 4 = 0 THEN 'New & Co. ' || CAST(id % 100 AS VARCHAR) ELSE vendor END AS vendor,
  CASE WHEN hit THEN 'new ' || CAST(id % 100 AS VARCHAR) ELSE normalized_vendor END AS normalized_vendor,
  CASE WHEN hit AND id % 20 = 0 THEN NULL WHEN hit AND id % 12 = 0 THEN 1 ELSE category_id END AS category_id, CASE WHEN hit THEN 1.5 ELSE total END AS total,
  CASE WHEN hit THEN '{NOW}' ELSE date END AS updated_at FROM (SELECT *, id % 4 = 0 AND id % 28 != 0 AS hit FROM ledger)),
after AS (SELECT p.*, c.name AS category FROM patched p LEFT JOIN categories c ON p.category_id = c.id WHERE p.id % 11 != 0)"""


def _edited(spark: SparkSession, sf_dir: str) -> Store:
    rows = readers.receipts(spark, sf_dir)
    found = store.open_store(spark, fresh_folder(spark, "store"), buckets=_buckets(spark, sf_dir), receipts=RECEIPTS, flags=FLAGS)
    store.load(found, rows.withColumn("created_at", F.col("date")).select(*[F.col(f.name).cast(f.dataType) for f in found.schema("receipts")]))
    category = "CASE WHEN id % 28 = 0 THEN 99 WHEN id % 20 = 0 THEN 0 WHEN id % 12 = 0 THEN 1 END"
    asked = found.read("receipts").where("id % 4 = 0").select("id", "document_id", F.expr("concat('New & Co. ', id % 100)").alias("vendor"), F.lit(1.5).alias("total"), F.expr(category).alias("category_id"))
    store.patch(found, asked, readers.categories(spark, sf_dir), F.lit(NOW))
    store.delete(found, found.read("receipts").where("id % 11 = 0").select("document_id"))
    return found


@query(_EDITED + " SELECT id, vendor, normalized_vendor, category_id, total, updated_at FROM after")
def stored_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches and deletions in a bucketed store."""
    return _edited(spark, sf_dir).read("receipts").select("id", "vendor", "normalized_vendor", "category_id", "total", "updated_at")


@query(_EDITED + f""", of_edited AS (SELECT *, coalesce(category, 'Uncategorized') AS c FROM after WHERE date LIKE '{YEAR}-%')
SELECT CASE WHEN grouping(c) = 1 THEN 'TOTAL' ELSE c END AS category, count(*) AS count, {total('pre_tax')} AS pre_tax,
CAST(coalesce(sum(CAST(gst AS DECIMAL(18,2)) + CAST(qst AS DECIMAL(18,2)) + CAST(pst AS DECIMAL(18,2)) + CAST(hst AS DECIMAL(18,2))), 0) AS DOUBLE) AS tax,
{total('total')} AS total, CAST(grouping(c) AS INT) AS is_total FROM of_edited GROUP BY ROLLUP (c)""")
def stored_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report by category from sums that were corrected by the differences of each edit."""
    return rollups.report_by_category(_edited(spark, sf_dir).read("sums"), readers.categories(spark, sf_dir), YEAR)


@query(_EDITED + " SELECT normalized_vendor, arg_max(category_id, struct_pack(u := updated_at, i := id)) AS category_id FROM after WHERE category_id IS NOT NULL AND normalized_vendor != '' GROUP BY 1")
def stored_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest category of each vendor after edits, some of which took it away."""
    return _edited(spark, sf_dir).read("latest").select("normalized_vendor", "category_id")


@query(_INGEST + " SELECT id, document_id, vendor, normalized_vendor, date, total, category_id, updated_at, created_at FROM after")
def stored_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch step on a store: only touched buckets are written."""
    rows = written_receipts(spark, sf_dir)
    said = F.when(F.col("id") % 20 == 0, F.lit(_SPOILT)).when(F.col("id") % 10 == 0, F.concat("receipt_text", F.lit("\nthank you"))).otherwise(F.col("receipt_text"))
    docs = rows.select(F.col("id").alias("doc_id"), said.alias("text"), F.lit(True).alias("tagged"))
    found = store.open_store(spark, fresh_folder(spark, "store"), buckets=_buckets(spark, sf_dir), receipts=RECEIPTS, flags=FLAGS)
    old, before, none = rows.where("id % 9 != 0").withColumn("created_at", F.col("date")), text.content_hash(F.col("receipt_text")), F.lit(None).cast("string")
    state = old.select(
        F.col("id").alias("doc_id"), before.alias("content_hash"), F.col("receipt_text").alias("ocr_text"), before.alias("parse_hash"), none.alias("text_model"), F.lit("done").alias("last_status"), none.alias("error_message"), F.lit(True).alias("has_receipt")
    )
    store.load(found, old.select(*[F.col(f.name).cast(f.dataType) for f in found.schema("receipts")]), state)
    store.ingest(found, docs, readers.categories(spark, sf_dir), as_of_year=AS_OF, now=F.lit(NOW))
    return found.read("receipts").select("id", "document_id", "vendor", "normalized_vendor", "date", "total", "category_id", "updated_at", "created_at")


@query("SELECT id, date, vendor, total FROM ledger WHERE category_id = 3 AND (date < '2017-06-15' OR (date = '2017-06-15' AND id > 100)) ORDER BY date DESC, id LIMIT 200")
def receipts_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page deep in the history, from its cursor."""
    path = fresh_folder(spark, "by-date")
    rows = readers.receipts(spark, sf_dir)
    pages.write_by_date(rows.select("id", "date", "vendor", "total", "category_id", "normalized_vendor", *rollups.AMOUNTS[:-1]), path, 8)
    stored = spark.read.parquet(path)
    return pages.page(stored, rollups.groups(stored), after=pages.Cursor("2017-06-15", 100), category_id=3, limit=200).select("id", "date", "vendor", "total")


@query("SELECT id, vendor, date, total FROM ledger WHERE id = 7")
def receipt_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One receipt by its id."""
    return L.lookup(readers.receipts(spark, sf_dir), 7).select("id", "vendor", "date", "total")


@query("SELECT id, vendor FROM ledger WHERE vendor ILIKE '%bl_e%t st%'")
def trigram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts by a part of the vendor's name with wildcards, by postings."""
    path = fresh_folder(spark, "postings")
    rows = readers.ledger(spark, sf_dir).select("id", "vendor")
    search.write_postings(rows, path, 4)
    return search.find(rows, spark.read.parquet(path), search.names_of(rows), "bl_e%t st").select("id", "vendor")


def _refuses_some(row: Row, key: str) -> None:
    if row["document_id"] % 10 == 7:
        raise OSError("refused")


@query("SELECT document_id, CASE WHEN document_id % 10 = 7 THEN 'failed' ELSE 'sent' END AS status, CAST(CASE WHEN document_id % 10 = 7 THEN 2 ELSE 1 END AS INT) AS tries FROM of_year")
def delivered_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of a year's payloads, sent twice: what was sent is not sent again."""
    rows = sinks.write_back_rows(L.of_year(readers.receipts(spark, sf_dir), YEAR), readers.categories(spark, sf_dir))
    folder = fresh_folder(spark, "delivery")
    for _ in range(2):
        delivery.deliver(rows, _refuses_some, folder, tries=2, wait=0)
    return delivery.outcomes(rows, folder).select("document_id", "status", "tries")


@query("WITH first AS (SELECT o_orderkey AS doc_id FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey ORDER BY 1 LIMIT 100) SELECT doc_id, 'done' AS last_status FROM first")
def limited_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that stops after the first hundred documents."""
    docs = readers.ledger(spark, sf_dir).select(F.col("id").alias("doc_id"), F.col("receipt_text").alias("text"), F.lit(True).alias("tagged"))
    return incremental.process(docs, spark.createDataFrame([], readers.STATE), as_of_year=AS_OF, limit=100)[0].select("doc_id", "last_status")


@query(f"SELECT document_id, vendor, date, {_READ.format('total')} AS total FROM ledger")
def streamed_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that arrive as files, taken up by a stream and put into a store, batch by batch."""
    source, found = fresh_folder(spark, "arrivals"), store.open_store(spark, fresh_folder(spark, "store"), buckets=_buckets(spark, sf_dir), receipts=RECEIPTS, flags=FLAGS)
    docs = readers.ledger(spark, sf_dir).select(F.col("id").alias("doc_id"), F.col("receipt_text").alias("text"), F.lit(True).alias("tagged"))
    docs.write.parquet(source)
    categories = readers.categories(spark, sf_dir)
    handle = lambda batch, number: store.ingest(found, batch, categories, as_of_year=AS_OF, now=F.lit(NOW), batch_id=number) and None
    name = source.rsplit("/", 1)[-1]
    incremental.start(spark, source, "doc_id long, text string, tagged boolean", fresh_folder(spark, "stream"), handle, name=name).awaitTermination()
    return found.read("receipts").select("document_id", "vendor", "date", "total")


def _answers(frame: pd.DataFrame) -> pd.DataFrame:
    """What a language model might say: no receipt for one text in two, else the total, after a first answer without any object for one in three."""

    def answer(r: pd.Series) -> str:
        if r.doc_id % 18 == 0 and "JSON" not in r.context:
            return "I see a receipt."
        return "Sure:\n" + json.dumps({"is_receipt": r.doc_id % 12 == 0, "total": "12.50", "confidence": 0.9})

    return pd.DataFrame({"doc_id": frame.doc_id, "answer": [answer(r) for r in frame.itertuples()]})


@query(f"SELECT id AS doc_id, id % 12 != 6 AS is_receipt, CASE WHEN id % 12 = 0 THEN 12.5 WHEN id % 6 != 0 THEN {_READ.format('total')} END AS total, CASE WHEN id % 12 != 6 THEN vendor END AS vendor FROM ledger")
def provider_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of which one in six lacks its amounts, so that a provider is asked, some of them twice."""
    said = F.when(F.col("id") % 6 == 0, F.concat_ws("\n", "vendor", F.concat(F.lit("Date: "), F.col("date")))).otherwise(F.col("receipt_text"))
    done = providers.parse(readers.ledger(spark, sf_dir).select(F.col("id").alias("doc_id"), said.alias("text")), as_of_year=AS_OF, provider=_answers)
    of_receipt = lambda c: F.when(F.col("is_receipt"), F.col(f"receipt.{c}")).alias(c)
    return done.select("doc_id", "is_receipt", of_receipt("total"), of_receipt("vendor"))

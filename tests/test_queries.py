"""Every registered ledger query against its SQL, on the smallest tables; incremental processing in batch and as a stream."""

import datetime
import decimal
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom import queries, table_queries  # noqa: F401  the latter adds its own
from ledgerloom.operators import catalog, documents, ledger
from ledgerloom.sources import readers, sinks
from ledgerloom.streaming import incremental

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_like_sql(spark, duck, name):
    found = queries.FOUND[name](spark, SF)
    wanted = duck.sql(queries.SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in found.collect())
    theirs = sorted(repr([plain(dict(zip(wanted.columns, r, strict=True))[c]) for c in columns]) for r in wanted.fetchall())
    assert ours == theirs


def test_second_run_parses_only_what_changed(spark):
    rows = queries.incremental_upsert(spark, SF).collect()
    assert rows and all((r.parsed_again is True) == (r.doc_id % 10 == 0) for r in rows)
    assert {r.last_status for r in rows} == {"done"}


DOC = "Corner Shop\nDate: 2024-01-05\nTotal {}.00\nthank you for your visit today"


def test_states(spark):
    docs = spark.createDataFrame([(1, DOC.format(1), True), (2, "short", True), (3, None, False), (1, DOC.format(1), True)], "doc_id long, text string, tagged boolean")
    state, parsed = incremental.process(docs, spark.createDataFrame([], readers.STATE), as_of_year=2030)
    found = {r.doc_id: r for r in state.collect()}
    assert {k: r.last_status for k, r in found.items()} == {1: "done", 2: "error", 3: "skipped"}
    assert [r.doc_id for r in parsed.collect()] == [1] and found[2].parse_hash is None
    untagged = spark.createDataFrame([(1, DOC.format(1), False)], "doc_id long, text string, tagged boolean")
    assert incremental.process(untagged, state, as_of_year=2030)[1].count() == 1
    tagged = spark.createDataFrame([(1, DOC.format(1), True)], "doc_id long, text string, tagged boolean")
    assert incremental.process(tagged, state, as_of_year=2030)[1].count() == 0
    held, _ = incremental.process(docs, spark.createDataFrame([], readers.STATE), as_of_year=2030, parity=True)
    assert {r.doc_id: r.parse_hash is not None for r in held.collect()} == {1: True, 2: True, 3: False}


def test_receipt_upsert_keeps_the_category(spark):
    old = spark.createDataFrame([(1, "a", 1.0, 5), (2, "b", 2.0, None)], "doc_id long, vendor string, total double, category_id int")
    new = spark.createDataFrame([(1, "c", 3.0), (3, None, 4.0)], "doc_id long, vendor string, total double")
    assert sorted(map(tuple, incremental.upsert_receipts(old, new).collect()), key=lambda r: r[0]) == [(1, "c", 3.0, 5), (2, "b", 2.0, None), (3, None, 4.0, None)]


def test_stream_handles_new_files_once(spark, tmp_path):
    schema = "doc_id long, text string, tagged boolean"
    seen = []

    def handle(batch, _):
        seen.extend(r.doc_id for r in batch.collect())

    for k in (1, 2):
        spark.createDataFrame([(k, DOC.format(k), True)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        incremental.start(spark, str(tmp_path / "in"), schema, str(tmp_path / "check"), handle).awaitTermination(60)
    assert seen == [1, 2] and incremental.status(spark) == {"running": False, "last": None}


def test_csv_and_snapshots(spark, tmp_path):
    receipts, categories = readers.receipts(spark, SF), readers.categories(spark, SF)
    sinks.export_csv(receipts, categories, 2018, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns[:3] == ["Date", "Vendor", "Category"] and back.count() == queries.csv_projection(spark, SF).count()
    path = sinks.write_snapshot(categories, str(tmp_path / "t"), 1)
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(Exception, match="exists"):
        sinks.write_snapshot(categories, str(tmp_path / "t"), 1)


def test_older_layouts_and_json_documents(spark, tmp_path):
    old = spark.createDataFrame([(1, "a")], "id long, vendor string")
    assert tuple(readers.upgraded(old).first()) == (1, "a", 0.0, "CAD")
    lines = ['{"id": 1, "content": "x", "tags": [{"id": 5, "name": "receipt-processed"}], "custom_fields": [{"field": 2, "value": "v"}]}', '{"id": 2, "content": "y", "tags": [7, 8]}', '{"id": 3, "tags": []}']
    (tmp_path / "docs.json").write_text("\n".join(lines))
    found = {r.id: r.tags for r in readers.json_documents(spark, str(tmp_path / "docs.json")).collect()}
    assert [(t.id, t.name) for t in found[1]] == [(5, "receipt-processed")] and [(t.id, t.name) for t in found[2]] == [(7, None), (8, None)] and found[3] == []
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    pdf = readers.binary_documents(spark, str(tmp_path)).select(documents.is_pdf("content")).first()
    assert pdf[0] is True


def test_report_has_four_tables(spark):
    found = sinks.report(readers.receipts(spark, SF), readers.categories(spark, SF), 2018)
    assert list(found) == ["summary", "taxes", "categories", "ledger"]
    assert found["summary"].first().receipts == found["ledger"].count() - 1


def test_write_back_survives_failures(spark):
    def send(row):
        if row.document_id % 2:
            raise OSError("away")

    rows = sinks.write_back_rows(readers.receipts(spark, SF), readers.categories(spark, SF)).limit(20)
    odd = rows.where("document_id % 2 = 1").count()
    assert sinks.write_back(rows, send, tries=2, wait=0.0) == odd


def test_settings_limit_and_models(spark):
    docs = spark.createDataFrame([(k, DOC.format(k), True) for k in range(1, 5)], "doc_id long, text string, tagged boolean")
    none = spark.createDataFrame([], readers.STATE)
    state, parsed = incremental.process(docs, none, as_of_year=2030, limit=2, settings={"text_model": "small"})
    assert {r.doc_id: r.text_model for r in state.collect()} == {1: "small", 2: "small"} and parsed.count() == 2
    assert incremental.process(docs.limit(4), state, as_of_year=2030, settings={"text_model": "small"})[1].count() == 2
    assert incremental.process(docs, state, as_of_year=2030, settings={"text_model": "large"})[1].count() == 4
    assert incremental.process(docs, state, as_of_year=2030, settings={"force_rescan": True})[1].count() == 4
    words = "payment due date, minimum payment, annual fee " + "x" * 200_000
    large = spark.createDataFrame([(1, words, True), (2, "Shop\nTotal 5.00\n" + "y" * 20_000, True)], "doc_id long, text string, tagged boolean")
    state, parsed = incremental.process(large, none, as_of_year=2030, settings={"use_stored_text_first": False})
    found = {r.doc_id: r for r in state.collect()}
    assert found[1].error_message.startswith("statement_detected:200") and not found[1].has_receipt and len(found[2].ocr_text) == 10_036
    assert [(r.doc_id, r.total) for r in parsed.collect()] == [(2, 5.0)]


def test_ingest_twice_changes_nothing(spark):
    docs = spark.createDataFrame([(1, DOC.format(1), True), (2, "short", True)], "doc_id long, text string, tagged boolean")
    empty = lambda schema: spark.createDataFrame([], schema)
    categories = spark.createDataFrame([(1, "Food", None)], readers.CATEGORIES)
    now = lambda t: F.lit(t).cast("timestamp_ntz")
    first = incremental.ingest(docs, empty(readers.STATE), empty(readers.RECEIPTS), empty(readers.FLAGS), categories, as_of_year=2030, now=now("2030-01-01"))
    assert tuple(first.stats.first()) == (2, 1, 0, 1, 0)
    row = first.receipts.first()
    assert (row.id, row.document_id, row.vendor, row.total, str(row.created_at), row.category_id) == (1, 1, "Corner Shop", 1.0, "2030-01-01 00:00:00", None)
    assert first.write_back.count() == 1
    known = first.receipts.withColumn("category_id", F.lit(1))
    again = incremental.ingest(docs, first.state, known, first.flags, categories, as_of_year=2030, now=now("2031-01-01"))
    assert again.write_back.count() == 0 and again.receipts.first().updated_at == row.updated_at
    forced = incremental.ingest(docs, first.state, known, first.flags, categories, as_of_year=2030, now=now("2031-01-01"), force=True)
    row = forced.receipts.first()
    assert (str(row.updated_at), str(row.created_at), row.category_id) == ("2031-01-01 00:00:00", "2030-01-01 00:00:00", 1)
    assert "Food" in forced.write_back.first().fields


def test_repeated_changes_change_once(spark):
    current = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    twice = spark.createDataFrame([("a", "8"), ("a", "9"), ("c", None), ("c", "5")], "key string, value string")
    assert sorted(map(tuple, catalog.upsert(current, twice, "key").collect())) == [("a", "9"), ("b", "2"), ("c", "5")]
    receipts = spark.createDataFrame([(1, "x", 1)], "id long, vendor string, category_id int").withColumn("normalized_vendor", F.lit("x"))
    asked = spark.createDataFrame([(1, "y"), (1, "z")], "id long, vendor string")
    assert [tuple(r) for r in ledger.patch(receipts, asked, spark.createDataFrame([(1, "c")], "id int, name string")).collect()] == [(1, "z", 1, "z")]
    assert [r.vendor for r in ledger.lookup(receipts, 1).collect()] == ["x"] and ledger.lookup(receipts, 2).isEmpty()


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""The ledger's store: sums and latest categories stay what a full computation gives, and a batch equals the batch step without a store."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom import table_queries
from ledgerloom.operators import ledger, rollups
from ledgerloom.sources import buckets, readers
from ledgerloom.streaming import incremental
from ledgerloom.streaming import store as S

RECEIPTS = readers.RECEIPTS.replace("timestamp_ntz", "string")
FLAGS = readers.FLAGS.replace("timestamp_ntz", "string")
CATEGORIES = [(1, "Food"), (2, "Fuel"), (3, "Rent")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def receipt(draw, i):
    vendor = draw.choice(["Red Shop", "Blue Shop", "Old Mill Inc.", ""])
    date = draw.choice([None, "2018", f"201{draw.randint(7, 9)}-0{draw.randint(1, 9)}-11"])
    money = [round(draw.random() * 100, 2) for _ in range(6)]
    return (i, i, vendor, vendor.lower().replace(" inc.", ""), date, *money, "CAD", draw.choice([None, 1, 2, 3]), draw.random(), "2020-01-01", f"2020-01-0{draw.randint(1, 9)}")


def holds(spark, store):
    """Whether the derived tables are what the receipts give."""
    now = store.read("receipts")
    assert rows(store.read("sums")) == rows(rollups.groups(now).select(*[f.name for f in store.schema("sums")]))
    found = S._contenders(now).select("normalized_vendor", "category_id", "updated_at", "id")
    assert rows(store.read("latest")) == rows(found)


def test_edits_keep_sums_and_latest_categories(spark, tmp_path):
    draw = random.Random(8)
    store = S.open_store(spark, f"file://{tmp_path}/s", buckets=3, receipts=RECEIPTS, flags=FLAGS)
    names = spark.createDataFrame(CATEGORIES, "id int, name string")
    S.load(store, spark.createDataFrame([receipt(draw, i) for i in range(40)], RECEIPTS))
    holds(spark, store)
    for step in range(2):
        held = spark.createDataFrame(store.read("receipts").collect(), RECEIPTS)
        ids = draw.sample(range(40), 9)
        asked = [(i, draw.choice([None, "Red Shop", "New & Co"]), draw.choice([None, 0, 1, 2, 99]), draw.choice([None, 5.25]), draw.choice([None, "2018-12-31"])) for i in ids]
        changes = spark.createDataFrame(asked, "id long, vendor string, category_id int, total double, date string")
        S.patch(store, changes if step else changes.withColumn("document_id", F.col("id")), names, F.lit(f"2020-02-0{step + 1}"))
        assert rows(store.read("receipts")) == rows(ledger.patch(held, changes, names, F.lit(f"2020-02-0{step + 1}")))
        holds(spark, store)
    gone = [x[0] for x in rows(store.read("latest").select("id"))] + [3, 4, 5, 999]
    S.delete(store, spark.createDataFrame([(i,) for i in gone], "document_id long"))
    assert not set(gone) & {r.id for r in store.read("receipts").collect()}
    holds(spark, store)
    S.clear_categories(store, spark.createDataFrame([(1,), (2,)], "id int"))
    holds(spark, store)
    assert {r.category_id for r in store.read("receipts").collect()} <= {None, 3}

    now, sums = store.read("receipts"), store.read("sums")
    for year in (None, 2018):
        assert rows(rollups.summary(sums, year)) == rows(ledger.summary(now, year))
        assert rows(rollups.by_category(sums, names, year)) == rows(ledger.by_category(now, names, year))
        assert rows(rollups.by_month(sums, year)) == rows(ledger.by_month(now, year))
        assert rows(rollups.report_totals(sums, year)) == rows(ledger.report_totals(now, year))
        assert rows(rollups.report_by_category(sums, names, year)) == rows(ledger.report_by_category(now, names, year))
        assert rows(rollups.tax_shares(sums, year)) == rows(ledger.tax_shares(now, year))


def text(vendor, date, total):
    return f"{vendor}\nDate: {date}\nSubtotal {total - 1:.2f}\nGST 1.00\nTOTAL {total:.2f}"


def test_a_batch_equals_the_batch_step_and_counts_once(spark, tmp_path):
    store = S.open_store(spark, f"file://{tmp_path}/s", buckets=4, receipts=RECEIPTS, flags=FLAGS)
    names = spark.createDataFrame(CATEGORIES, "id int, name string")
    draw = random.Random(5)
    old = spark.createDataFrame([receipt(draw, i) for i in range(20)], RECEIPTS)
    flags = spark.createDataFrame([(None, 1, "old", "approved", None, "x"), (None, 2, "old", "pending", None, "x")], FLAGS)
    docs = [(i, text(v, "2018-03-04", 20.5 + i), True) for i, v in enumerate(["Red Shop", "Blue Shop", "Old Mill", "Green Shop", "Red Shop"])] + [(30, text("Red Shop", "2019-01-02", 9), False), (31, "short", True), (32, None, True), (33, "No amounts here\nthank you for your visit, and come again", True)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, tagged boolean")
    S.load(store, old, None, flags)
    done = S.ingest(store, docs, names, as_of_year=2034, now=F.lit("2020-03-01"), batch_id=0)
    wanted = incremental.ingest(docs, spark.createDataFrame([], readers.STATE), old, flags, names, as_of_year=2034, now=F.lit("2020-03-01"))
    columns = [f.name for f in store.schema("receipts")]
    assert rows(store.read("receipts")) == rows(wanted.receipts.select(columns))
    assert rows(store.read("state")) == rows(wanted.state.select([f.name for f in store.schema("state")]))
    assert rows(store.read("flags")) == rows(wanted.flags.select([f.name for f in store.schema("flags")]))
    assert rows(done.write_back) == rows(wanted.write_back)
    assert done.stats == wanted.stats.first().asDict()
    holds(spark, store)
    assert S.ingest(store, docs, names, as_of_year=2034, now=F.lit("2020-03-02"), batch_id=0) is None and store.version() == done.version
    again = S.ingest(store, docs, names, as_of_year=2034, now=F.lit("2020-03-02"), batch_id=1)
    assert again.stats["processed"] == 9 and again.write_back.count() == 1  # the untagged one is read again
    holds(spark, store)


@pytest.mark.parametrize(("orders", "wanted"), [(0, 8), (800_000, 8), (800_001, 9), (54_000_000, 540)])
def test_buckets_follow_the_rows(orders, wanted):
    assert S.buckets_for(orders) == wanted


def test_queries_open_stores_with_buckets_for_their_tables(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_ROWS", 100)
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    opened = table_queries._edited(spark, "/root/testdata/sf0.001")
    assert opened.buckets == -(-orders // 100) > 8
    assert len(opened.manifest(opened.version())["tables"]["receipts"]) > 8


def staged(store):
    """The folders that batches have staged and not deleted."""
    return [f"{d}/{n}" for d in store.files.names("data") for n in store.files.names(f"data/{d}") if n.endswith("-staged")]


@pytest.mark.parametrize("least", [64, 3])
def test_a_batch_leaves_only_what_it_has_changed(spark, tmp_path, monkeypatch, least):
    monkeypatch.setattr(buckets, "PART_BUCKETS", least)  # in one part, and in several
    store = S.open_store(spark, f"file://{tmp_path}/s", buckets=16, receipts=RECEIPTS, flags=FLAGS)
    names = spark.createDataFrame(CATEGORIES, "id int, name string")
    schema = "doc_id long, text string, tagged boolean"
    docs = [(i, text("Red Shop", "2018-03-04", 20.5 + i), True) for i in range(60)] + [(70, None, True), (71, "short", True)]
    S.load(store, spark.createDataFrame([receipt(random.Random(1), i) for i in range(5)], RECEIPTS))
    assert staged(store) == []
    first = S.ingest(store, spark.createDataFrame(docs, schema), names, as_of_year=2034, now=F.lit("2020-03-01"))
    assert len(staged(store)) == 1 and first.write_back.count() == 60  # what is written back is still there
    before = store.manifest(first.version)["tables"]["state"]
    docs[7] = (7, text("Blue Shop", "2018-03-05", 9.5), True)
    again = S.ingest(store, spark.createDataFrame(docs, schema), names, as_of_year=2034, now=F.lit("2020-03-02"))
    assert again.stats == {"processed": 62, "errors": 1, "skipped": 1, "receipts": 60, "flagged": 0}
    after = store.manifest(again.version)["tables"]["state"]
    assert before.keys() == after.keys() and len(before) > 2
    changed = {b for b in before if before[b] != after[b]}
    held = spark.createDataFrame([(7,), (71,)], "doc_id long").select(store.bucket("state")).collect()  # a short text is looked at again each time
    assert {str(held[0][0])} <= changed <= {str(r[0]) for r in held}
    assert len(staged(store)) == 2
    S.patch(store, spark.createDataFrame([(3, 3, "New & Co")], "id long, document_id long, vendor string"), names, F.lit("2020-04-01"))
    assert len(staged(store)) == 2
    holds(spark, store)
    assert S.ingest(store, spark.createDataFrame([], schema), names, as_of_year=2034, now=F.lit("2020-03-03")).stats == dict.fromkeys(("processed", "errors", "skipped", "receipts", "flagged"), 0)

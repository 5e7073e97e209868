"""Pages by cursor, trigram search and the progress of streams."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ledger, pages, rollups, search
from ledgerloom.sources import readers
from ledgerloom.streaming import progress

RECEIPTS = readers.RECEIPTS.replace("timestamp_ntz", "string")


def receipt(draw, i):
    date = draw.choice([None, "20", f"20{draw.randint(10, 19)}-{draw.randint(1, 12):02d}-{draw.randint(1, 28):02d}"]) if draw.random() < 0.2 else f"20{draw.randint(10, 19)}-{draw.randint(1, 12):02d}-11"
    vendor = draw.choice(["Red Shop", "Blue_50% Shop", "Café Zürich", "MILL\\WORKS", "ab", None, ""])
    return (i, i, vendor, None, date, *[1.0] * 6, "CAD", draw.choice([None, 1, 2]), 0.5, "x", "x")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    draw = random.Random(1)
    rows = spark.createDataFrame([receipt(draw, i) for i in range(400)], RECEIPTS)
    path = str(tmp_path_factory.mktemp("r") / "by_date")
    pages.write_by_date(rows, path, 6)
    return spark.read.schema(RECEIPTS).parquet(path)


@pytest.mark.parametrize("how", [{}, {"category_id": 2}, {"year": 2014}, {"vendor": "shop"}, {"year": 2030}])
@pytest.mark.parametrize("counted", [True, False])
def test_pages_follow_one_another(spark, stored, how, counted):
    sums = rollups.groups(stored) if counted else None
    wanted = [(r.date, r.id) for r in ledger.find(stored, **how, limit=1000).collect()]
    found, cursor = [], None
    while True:
        page = pages.page(stored, sums, after=cursor, limit=130, **how)
        found += [(r.date, r.id) for r in page.collect()]
        if (cursor := pages.last_of(page)) is None:
            break
    assert found == wanted


def test_a_deep_page_reads_the_months_it_needs(stored):
    page = pages.page(stored, rollups.groups(stored), after=pages.Cursor("2012-06-11", 3), limit=10)
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"date#\d+ >= 2012-0[1-6]", plan) and re.search(r"date#\d+ <= 2012-06-11", plan)
    assert pages.last_of(pages.page(stored, after=pages.Cursor(None, 10**9))) is None


PATTERNS = ["shop", "SHOP", "red s", "_ed sh", "e%shop", "50\\% s", "50% s", "blue\\_50", "zürich", "ZÜR", "mill\\\\w", "ab", "", "%", "nothing at all", "é z"]


def test_trigram_search_finds_what_ilike_finds(spark, stored):
    post, names = search.postings(stored), search.names_of(stored)
    for pattern in PATTERNS:
        wanted = {r.id for r in stored.where(F.col("vendor").ilike(f"%{pattern}%")).collect()}
        assert {r.id for r in search.find(stored, post, names, pattern).collect()} == wanted, pattern
    assert search.trigrams("50\\% s_Hop%AB") == ["% s", "0% ", "50%", "hop"]


def test_a_search_reads_its_own_trigrams(spark, stored, tmp_path):
    search.write_postings(stored, str(tmp_path / "p"), 4)
    post = spark.read.parquet(str(tmp_path / "p"))
    found = search.matching(post, search.names_of(stored), "zür")
    assert {r.vendor for r in found.collect()} == {"Café Zürich"}
    found = search.matching(post, search.names_of(stored), "works")
    assert {r.vendor for r in found.collect()} == {"MILL\\WORKS"}
    assert "In(trigram, [ork,rks,wor])" in found._jdf.queryExecution().executedPlan().toString()


def test_progress_of_a_stream(spark, tmp_path):
    seen = progress.watch(spark)
    assert seen.of("counted")["started"] is None
    spark.range(30).write.parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    counted = docs.observe("batch", F.count("*").alias("processed"), F.count_if(F.col("id") > 9).alias("receipts"))
    run = counted.writeStream.queryName("counted").trigger(availableNow=True).format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination(60)
    broken = docs.select(F.raise_error(F.lit("no good"))).writeStream.queryName("broken").trigger(availableNow=True).format("noop").option("checkpointLocation", str(tmp_path / "d")).start()
    with pytest.raises(Exception, match="no good"):
        broken.awaitTermination(60)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    for _ in range(100):
        if seen.of("broken")["error"]:
            break
        __import__("time").sleep(0.1)
    found = seen.of("counted")
    assert (found["running"], found["rows"], found["counts"], found["error"]) == (False, 30, {"processed": 30, "receipts": 20}, None)
    assert not seen.of("broken")["running"] and "no good" in seen.of("broken")["error"]
    spark.streams.removeListener(seen)

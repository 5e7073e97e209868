"""The bucketed store: random merges against a dictionary, untouched files, conflicts, and what is deleted when."""

import hashlib
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import providers
from ledgerloom.sources import buckets, folders

TABLES = {"t": buckets.Keyed(("k",), "k long, a string, n int"), "pair": buckets.Keyed(("x", "y"), "x string, y int, n long")}


@pytest.fixture
def store(spark, tmp_path):
    return buckets.Store(spark, f"file://{tmp_path}/store", TABLES, 8)


def files(store, version):
    root = Path(store.files.root.removeprefix("file://"))
    return {b: {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in (root / f).glob("*.parquet")} for b, f in store.manifest(version)["tables"]["t"].items()}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_random_merges_equal_a_dictionary(spark, store):
    draw, held = random.Random(3), {}
    schema = "k long, a string, n int, gone boolean"
    for _ in range(5):
        changes = {draw.choice([None, *range(30)]): (draw.choice("abc"), draw.randint(0, 9), draw.random() < 0.2) for _ in range(12)}
        frame = spark.createDataFrame([(k, *v) for k, v in changes.items()], schema).repartition(3)
        batch = store.begin()
        gone = [k for k, v in changes.items() if v[2]]
        marked = frame.select("k", F.when(F.col("gone"), None).otherwise(F.col("a")).alias("a"), "n")
        batch.merge("t", marked, lambda old, new: {"n": F.coalesce(old["n"], F.lit(0)) + F.coalesce(new["n"], F.lit(0)), buckets.GONE: new.isNotNull() & new["a"].isNull()})
        batch.publish()
        for k, (a, n, _) in changes.items():
            held[k] = (a, held.get(k, ("", 0))[1] + n)
        for k in gone:
            held.pop(k)
        assert rows(store.read("t")) == sorted(((k, *v) for k, v in held.items()), key=repr)
    assert rows(store.read("t", 0)) == []


def test_untouched_buckets_keep_their_files(spark, store):
    batch = store.begin()
    batch.merge("t", spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("a"), F.lit(1).alias("n")))
    first = batch.publish(batch=1)
    batch = store.begin()
    touched = batch.merge("t", spark.createDataFrame([(7, "new"), (1000, "new")], "k long, a string"))
    second = batch.publish(other="x")
    before, after = files(store, first), files(store, second)
    assert len(before) == 8 and 1 <= len(touched) <= 2
    assert all((before[b] == after[b]) == (int(b) not in touched) for b in before)
    assert all(len(f) == 1 for f in after.values())
    assert rows(store.read("t").where("a = 'new'")) == [(1000, "new", None), (7, "new", 1)]
    assert store.read("t").count() == 201 and store.notes() == {"batch": 1, "other": "x"}
    assert rows(store.begin().read_for("t", spark.createDataFrame([(7,)], "k long")).where("k = 7")) == [(7, "new", 1)]


def test_a_batch_is_seen_whole_or_not_at_all(spark, store):
    one, two = store.begin(), store.begin()
    one.merge("t", spark.createDataFrame([(1, "one")], "k long, a string"))
    one.merge("pair", spark.createDataFrame([("x", 1, 5), (None, None, 6)], "x string, y int, n long"))
    two.merge("t", spark.createDataFrame([(1, "two")], "k long, a string"))
    assert rows(store.read("t")) == [] and rows(one.read("t")) == [(1, "one", None)]
    one.publish()
    with pytest.raises(buckets.Conflict):
        two.publish()
    assert rows(store.read("t")) == [(1, "one", None)]
    assert rows(store.read("pair")) == [("x", 1, 5), (None, None, 6)]
    twice = store.begin()
    for n in (1, 10):
        twice.merge("pair", spark.createDataFrame([("x", 1, n)], "x string, y int, n long"), lambda old, new: {"n": F.coalesce(old["n"], F.lit(0)) + F.coalesce(new["n"], F.lit(0))})
    twice.merge("t", spark.createDataFrame([], "k long"))
    twice.publish()
    assert rows(store.read("pair")) == [("x", 1, 16), (None, None, 6)]


def test_vacuum_keeps_what_versions_name(spark, store):
    for n in range(4):
        batch = store.begin()
        batch.merge("t", spark.createDataFrame([(n, str(n)), (9, "all")], "k long, a string"))
        batch.publish()
    lost = store.begin()
    lost.merge("t", spark.createDataFrame([(77, "lost")], "k long, a string"))
    wanted = {v: rows(store.read("t", v)) for v in (3, 4)}
    store.vacuum(keep=2, older_than=10_000)
    assert {v: rows(store.read("t", v)) for v in (3, 4)} == wanted
    store.vacuum(keep=2, older_than=-10)
    assert {v: rows(store.read("t", v)) for v in (3, 4)} == wanted
    assert [n for n in store.files.names("versions") if n.endswith("json")] == ["00000000.json", "00000003.json", "00000004.json"]
    root = Path(store.files.root.removeprefix("file://"))
    used = {f for v in (3, 4) for f in store.manifest(v)["tables"]["t"].values()}
    assert {str(p.parent.relative_to(root)) for p in root.glob("data/**/*.parquet")} == used
    again = buckets.Store(spark, store.files.root, TABLES, 99)
    assert again.buckets == 8 and again.version() == 4


def test_every_bucket_has_a_task_of_its_own(spark, tmp_path):
    """Bucket numbers that are hashed to tasks meet in some of them."""
    store = buckets.Store(spark, f"file://{tmp_path}/store", TABLES, 40)
    batch = store.begin()
    new = spark.range(4000).select(F.col("id").alias("k"), F.lit("a").alias("a"), F.spark_partition_id().alias("n"))

    def combine(old, new):
        return {"n": F.spark_partition_id()}

    seen = batch.merge("t", new, combine)
    held = batch.read("t").select(store.bucket("t").alias("b"), "n").distinct().collect()
    assert len(seen) == len(held) == len({r.n for r in held}) == 40


def test_merges_in_parts_are_one_change(spark, store, monkeypatch):
    monkeypatch.setattr(buckets, "PART_BUCKETS", 1)
    batch = store.begin()
    batch.merge("t", spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("a"), F.lit(1).alias("n")))
    first = batch.publish()
    batch = store.begin()
    changes = batch.stage(spark.range(50, 150).select(F.when(F.col("id") != 149, F.col("id")).alias("k"), F.lit("b").alias("a")))
    touched = batch.merge("t", changes, lambda old, new: {"n": F.coalesce(old["n"], F.lit(0)) + 1, buckets.GONE: old["n"].isNotNull() & new.isNotNull()})
    assert len({f.rsplit("/", 1)[0] for f in batch.held["t"].values()}) == buckets.PARTS and touched == list(range(8))
    second = batch.publish()
    assert rows(store.read("t", first)) == sorted(((k, "a", 1) for k in range(100)), key=repr)
    assert rows(store.read("t", second)) == sorted([(k, "a", 2) for k in range(50)] + [(k, "b", 1) for k in [*range(100, 149), None]], key=repr)


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.length()) if found.apply(i).getName().startswith("shuffle_")}


@pytest.mark.parametrize("use", [lambda df, path: folders.write(df, path), lambda df, path: providers.kept(df)])
def test_shuffle_files_go_with_their_query(spark, tmp_path, use):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_files(spark), spark.conf.get(key)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")).join(spark.range(5).withColumnRenamed("id", "k"), "k")
    use(df, f"file://{tmp_path}/out")
    end = time.time() + 10
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before and spark.conf.get(key) == setting

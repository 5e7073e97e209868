"""The ledger in a bucketed store: batches, edits and deletions that touch only what they change.

Besides the documents' states, receipts and flags, two tables are derived and kept with them, under the same version pointer: the latest category of each
vendor, and the sums by month, category and vendor. A batch reads the buckets of its documents, receipts, vendors and groups, so its cost
follows the batch and not the history.

The latest category of a vendor is that of its receipt with a category updated last (ties by the greater id). A batch puts its own receipts over it;
where it takes the category, the vendor or the whole of the very receipt that a vendor's row stands on, that vendor is worked out again from its
receipts (a scan of four columns for those vendors, only in such batches).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import catalog, ledger, review, rollups
from ledgerloom.plans.providers import Provider
from ledgerloom.sources import readers
from ledgerloom.sources.buckets import BUCKETS, GONE, Batch, Combine, Keyed, Store
from ledgerloom.sources.sinks import batch_write_back
from ledgerloom.streaming.incremental import idle, latest, looked_at, outcomes, upsert_receipts

LATEST = "normalized_vendor string, category_id int, updated_at {time}, id long"


#: Receipts, or states with their texts, that a bucket is to hold: some 100 MB with the longest usual texts, so that the task that merges it stays small.
BUCKET_ROWS = 100_000


def buckets_for(rows: int, least: int = 8) -> int:
    """How many buckets a store of so many documents needs. A merge is a task for each bucket, so their number follows the ledger, not the size of one task."""
    return max(least, -(-rows // BUCKET_ROWS))


def open_store(spark: SparkSession, root: str, *, buckets: int = BUCKETS, receipts: str = readers.RECEIPTS, flags: str = readers.FLAGS) -> Store:
    """The ledger's store; the receipts' and flags' schemas may have columns of their own."""
    time = next(x.split()[1] for x in receipts.split(", ") if x.split()[0] == "updated_at")
    tables = {
        "state": Keyed(("doc_id",), readers.STATE), "receipts": Keyed(("document_id",), receipts), "flags": Keyed(("receipt_id",), flags),
        "latest": Keyed(("normalized_vendor",), LATEST.format(time=time)), "sums": Keyed(rollups.KEY, rollups.SCHEMA),
    }
    return Store(spark, root, tables, buckets)


def load(store: Store, receipts: DataFrame, state: DataFrame | None = None, flags: DataFrame | None = None) -> int:
    """Fills an empty store."""
    batch = store.begin()
    receipts = batch.stage(receipts)
    _put(batch, receipts.limit(0), receipts)
    batch.drop(receipts)
    for table, rows in (("state", state), ("flags", flags)):
        if rows is not None:
            batch.merge(table, rows)
    return batch.publish()


def _contenders(receipts: DataFrame) -> DataFrame:
    """The row of each vendor of receipts that would be its latest."""
    known = receipts.where("category_id IS NOT NULL AND normalized_vendor != ''")
    return known.groupBy("normalized_vendor").agg(F.max(F.struct("updated_at", "id", "category_id")).alias("x")).select("normalized_vendor", "x.*")


def _later(old: Column, new: Column) -> dict[str, Column]:
    """The later of two rows of a vendor."""
    place = lambda x: F.struct(x["updated_at"], x["id"])
    wins = old.isNull() | (new.isNotNull() & (place(new) >= place(old)))
    return {c: F.when(wins, new[c]).otherwise(old[c]) for c in ("category_id", "updated_at", "id")}


def _retract(batch: Batch, before: DataFrame, after: DataFrame) -> None:
    """Works out again the latest category of vendors that stood on a receipt of before and cannot stand on it as it is after."""
    vendors = before.where("category_id IS NOT NULL AND normalized_vendor != ''").select("id", "normalized_vendor")
    stood = batch.read_for("latest", vendors).join(vendors, ["id", "normalized_vendor"], "left_semi")
    same = after.where("category_id IS NOT NULL").select("id", "normalized_vendor", F.col("updated_at").alias("_now"))
    lost = stood.join(same, ["id", "normalized_vendor"], "left").where(F.col("_now").isNull() | (F.col("_now") < F.col("updated_at")))
    lost = batch.stage(lost.select("normalized_vendor"))
    if lost.isEmpty():
        return
    columns = ["id", "normalized_vendor", "category_id", "updated_at"]
    rest = batch.read("receipts").join(before.select("document_id"), "document_id", "left_anti")
    found = _contenders(rest.select(columns).unionByName(after.select(columns)).join(lost, "normalized_vendor", "left_semi"))
    # Vendors that no categorised receipt is left of lose their row.
    again = lambda old, new: {c: F.when(new.isNotNull(), new[c]).otherwise(old[c]) for c in ("category_id", "updated_at", "id")} | {GONE: new.isNotNull() & new["id"].isNull()}
    batch.merge("latest", batch.stage(lost.join(found, "normalized_vendor", "left")), again)


def _put(batch: Batch, before: DataFrame, after: DataFrame) -> None:
    """Replaces the receipts before by those after in all tables that hold them; either side may lack rows of the other. Both are staged."""
    batch.merge("latest", _contenders(after), _later)
    sums = batch.stage(rollups.difference(before, after))
    batch.merge("sums", sums, rollups.added)
    batch.drop(sums)
    batch.merge("receipts", after)
    batch.merge("receipts", before.select("document_id").join(after.select("document_id"), "document_id", "left_anti"), lambda old, new: {GONE: new.isNotNull()})


@dataclass
class Done:
    """A published batch: its version, its counts, and what is to be written back for it."""

    version: int
    stats: dict[str, int]
    write_back: DataFrame


def ingest(
    store: Store, docs: DataFrame, categories: DataFrame, *, as_of_year: int, now: Column, provider: Provider | None = None, settings: dict | None = None, force: bool = False,
    batch_id: int | None = None, name: str = "receipt-batch",
) -> Done | None:
    """incremental.ingest on a store, published as one version. With batch_id, that of a stream, a batch that the store already has is passed over (None), so
    that one repeated after a failure counts once. Counts are observed while states and receipts are written; no job is run for them. Documents that are
    neither parsed nor get another state are counted and then left out, so that what a batch writes follows what has changed, not what it looks at."""
    if batch_id is not None and store.notes().get(name, -1) >= batch_id:
        return None
    batch = store.begin()
    docs = batch.stage(latest(docs))
    states, warned = Observation(), Observation()
    passed = [F.count_if(c).alias(n) for n, c in {"processed": idle(), "skipped": idle() & (F.col("used") == ""), "receipts": idle() & (F.col("used") != "") & F.col("has_receipt")}.items()]
    # Both sides of the join hold all texts, so it is made a part of the buckets at a time.
    found, same = [], []
    for only, part in batch.parts("state", docs):
        same.append(Observation())
        found.append(batch.stage(looked_at(part, batch.read("state", only), settings=settings, force=force).observe(same[-1], *passed).where(~idle()).drop("was")))
    found = found or [looked_at(docs, batch.read("state", []), settings=settings, force=force).drop("was")]
    touched, parsed = outcomes(reduce(DataFrame.unionByName, found), as_of_year=as_of_year, provider=provider, settings=settings)
    receipt = ~F.col("last_status").isin("error", "skipped") & F.col("has_receipt")
    counts = {"processed": F.count("*"), "errors": F.count_if(F.col("last_status") == "error"), "skipped": F.count_if(F.col("last_status") == "skipped"), "receipts": F.count_if(receipt)}
    touched = batch.stage(touched.observe(states, *[c.alias(n) for n, c in counts.items()]))
    parsed = batch.stage(parsed.withColumnRenamed("doc_id", "document_id").observe(warned, F.count_if(F.size("warnings") > 0).alias("flagged")))
    batch.drop(docs, *found)

    before = batch.stage(batch.read_for("receipts", parsed).join(parsed.select("document_id"), "document_id", "left_semi"))
    merged = batch.stage(upsert_receipts(before, parsed, now, "document_id"))
    batch.drop(parsed)
    _retract(batch, before, merged)
    # A receipt without a category gets its vendor's latest one, in which the batch's own receipts count.
    known = batch.read_for("latest", merged).unionByName(_contenders(merged)).withColumn("category_id", F.col("category_id").cast("int"))
    after = batch.stage(catalog.infer_category(merged, known))
    batch.drop(merged)
    _put(batch, before, after)
    batch.drop(before)
    batch.merge("state", touched)
    batch.drop(touched)
    batch.merge("flags", review.flag(after), _flagged(now))
    version = batch.publish(after, **({name: batch_id} if batch_id is not None else {}))
    stats = {n: count + sum(x.get.get(n, 0) for x in same) for n, count in states.get.items()}
    return Done(version, stats | dict(warned.get), batch_write_back(after, categories))


def _flagged(now: Column) -> Combine:
    """As review.merge_flags."""

    def combine(old: Column, new: Column) -> dict[str, Column]:
        fresh = new.isNotNull() & (old.isNull() | (old["status"] == "pending"))
        return {
            "reason": F.when(fresh, new["reason"]).otherwise(old["reason"]), "status": F.coalesce(old["status"], F.lit("pending")),
            "created_at": F.when(old.isNull(), now).otherwise(old["created_at"]),
        }

    return combine


def _edit(store: Store, batch: Batch, before: DataFrame, after: DataFrame) -> int:
    before, after = batch.stage(before), batch.stage(after)
    _retract(batch, before, after)
    _put(batch, before, after)
    return batch.publish()


def patch(store: Store, changes: DataFrame, categories: DataFrame, now: Column) -> int:
    """ledger.patch on a store. With document_id among the columns of changes only the receipts' buckets are read, else the ids of all."""
    batch = store.begin()
    if "document_id" in changes.columns:
        found = batch.read_for("receipts", changes).join(changes.select("id"), "id", "left_semi")
    else:
        keys = batch.stage(batch.read("receipts").join(changes.select("id"), "id", "left_semi").select("document_id"))
        found = batch.read_for("receipts", keys).join(keys, "document_id", "left_semi")
    found = batch.stage(found)
    return _edit(store, batch, found, ledger.patch(found, changes, categories, now))


def delete(store: Store, gone: DataFrame) -> int:
    """Takes out the receipts of gone (document_id)."""
    batch = store.begin()
    found = batch.stage(batch.read_for("receipts", gone).join(gone.select("document_id"), "document_id", "left_semi"))
    return _edit(store, batch, found, found.limit(0))


def clear_categories(store: Store, gone: DataFrame) -> int:
    """Takes the categories of gone (id) from the receipts that have them; these are found by a scan."""
    batch = store.begin()
    found = batch.stage(batch.read("receipts").join(gone.select(F.col("id").alias("category_id")), "category_id", "left_semi").select(*[f.name for f in store.schema("receipts")]))
    return _edit(store, batch, found, found.withColumn("category_id", F.lit(None).cast("int")))

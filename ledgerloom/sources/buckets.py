"""Keyed tables in hash buckets, of which a batch rewrites only those it touches, under one version pointer.

A store holds several tables. A table's rows are dealt by a hash of its key to ``buckets`` folders; a version is one small file that says
for every table and bucket which folder holds it. A batch begins at the newest version, merges changes into the buckets whose keys it
names, writes these to new folders and publishes one file: all tables change together or not at all, readers of the older version
keep their files, and buckets that no key falls into keep theirs byte for byte. If another batch has published meanwhile, nothing is
published and ``Conflict`` is raised: begin again. A lost task or driver leaves folders that no version names, which ``vacuum`` deletes.
What a batch stages goes as soon as it is no longer read, at the latest when it is published.

A merge is one shuffle of the touched buckets and the changes, by bucket: old and new rows of a key meet in an aggregation, and as each of its
tasks holds one whole bucket, it writes one file; a hash of the buckets would put several into one task, and more the more buckets there are. Cost follows the buckets touched, not the table; with changes of one row per
bucket or more that is all of it, so choose buckets of some 100 MB. Of a table of many buckets only a part is shuffled at a time, as shuffle files come on top of both versions.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.sources.folders import Files, write

#: From the old and the new row of a key (structs, null where there is none) to the columns that the key's row has
#: afterwards; columns that are left out are taken from the new row, else the old one. ``GONE``: whether the row goes.
Combine = Callable[[Column, Column], dict[str, Column]]
GONE = "_gone"
BUCKETS = 64
#: What shuffles many buckets goes in so many parts at most, each of so many buckets at least, so that the shuffle holds a part of the table at a time.
PARTS, PART_BUCKETS = 4, 64


class Conflict(RuntimeError):
    """Another batch has published a version since this one began."""


@dataclass(frozen=True)
class Keyed:
    """A table's key columns and schema."""

    key: tuple[str, ...]
    schema: str


class Store:
    """Tables under a root folder."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Keyed], buckets: int = BUCKETS) -> None:
        self.spark, self.tables, self.files = spark, tables, Files(spark, root)
        first = self.files.publish("versions/00000000.json", {"buckets": buckets, "tables": {t: {} for t in tables}, "notes": {}})
        self.buckets = buckets if first else self.manifest(0)["buckets"]

    def version(self) -> int:
        """The newest version."""
        return max(int(n[:8]) for n in self.files.names("versions") if n.endswith(".json"))

    def manifest(self, version: int) -> dict:
        return self.files.read(f"versions/{version:08d}.json")

    def schema(self, table: str) -> StructType:
        return StructType.fromDDL(self.tables[table].schema)

    def bucket(self, table: str) -> Column:
        """The bucket of a row, from its key columns."""
        return F.pmod(F.xxhash64(*self.tables[table].key), F.lit(self.buckets)).cast("int")

    def read(self, table: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The table at a version (the newest), or only some of its buckets."""
        return self.of_folders(table, self.manifest(self.version() if version is None else version)["tables"].get(table, {}), only)

    def of_folders(self, table: str, held: dict[str, str], only: list[int] | None = None) -> DataFrame:
        wanted = None if only is None else set(map(str, only))
        paths = [f"{self.files.root}/{folder}" for b, folder in sorted(held.items()) if wanted is None or b in wanted]
        schema = self.schema(table)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def begin(self) -> Batch:
        return Batch(self, self.version())

    def notes(self, version: int | None = None) -> dict:
        """What batches have noted: the newest value of each name."""
        return self.manifest(self.version() if version is None else version)["notes"]

    def vacuum(self, keep: int = 2, older_than: float = 3600.0) -> None:
        """Deletes the versions before the newest keep, and what no version left names and was written more than older_than seconds ago: give batches
        that are under way and readers of old versions time to end."""
        names = [n for n in self.files.names("versions") if n.endswith(".json")]
        for n in names[1 : max(1, len(names) - keep)]:
            self.files.delete(f"versions/{n}")
        left = [self.files.read(f"versions/{n}") for n in self.files.names("versions") if n.endswith(".json")]
        used = {folder for m in left for held in m["tables"].values() for folder in held.values()}
        for written in self.files.names("data"):
            if float(written.split("-")[0]) > time.time() - older_than:
                continue
            for table in self.files.names(f"data/{written}"):
                folders = [f"data/{written}/{table}/{b}" for b in self.files.names(f"data/{written}/{table}") if b.startswith("_bucket=")]
                for folder in folders:
                    if folder not in used:
                        self.files.delete(folder)
                if not used.intersection(folders):
                    self.files.delete(f"data/{written}/{table}")
            if not self.files.names(f"data/{written}"):
                self.files.delete(f"data/{written}")


class Batch:
    """Changes on top of one version; publish() makes them the next."""

    def __init__(self, store: Store, version: int) -> None:
        self.store, self.parent = store, version
        manifest = store.manifest(version)
        self.held, self.notes = {t: dict(manifest["tables"].get(t, {})) for t in store.tables}, dict(manifest["notes"])
        self.folder, self.merges = f"data/{time.time():.0f}-{uuid.uuid4().hex[:12]}", 0
        self.staged: list[tuple[DataFrame, str]] = []

    def touched(self, table: str, keys: DataFrame) -> list[int]:
        """The buckets that keys (with the key columns) fall into; as many numbers at most as there are buckets."""
        return sorted(r[0] for r in keys.select(self.store.bucket(table).alias("b")).distinct().collect())

    def read(self, table: str, only: list[int] | None = None) -> DataFrame:
        """The table as this batch has it, or only some buckets."""
        return self.store.of_folders(table, self.held[table], only)

    def parts(self, table: str, keys: DataFrame) -> list[tuple[list[int], DataFrame]]:
        """The buckets that keys fall into, dealt to one part or a few, each with its rows of keys."""
        touched = self.touched(table, keys)
        n = max(1, min(PARTS, len(touched) // PART_BUCKETS))
        return [(only, keys if n == 1 else keys.where(self.store.bucket(table).isin(only))) for only in (touched[k::n] for k in range(n)) if only]

    def read_for(self, table: str, keys: DataFrame) -> DataFrame:
        """The rows of the buckets that keys fall into."""
        return self.read(table, self.touched(table, keys))

    def stage(self, df: DataFrame) -> DataFrame:
        """df, written beside the batch's files and read back, so that it is worked out once and not again after a failure. It stays until it is dropped or
        the batch published; after a failure, until a vacuum."""
        self.merges += 1
        folder = f"{self.folder}/{self.merges:02d}-staged"
        write(df, f"{self.store.files.root}/{folder}")
        out = self.store.spark.read.schema(df.schema).parquet(f"{self.store.files.root}/{folder}")
        self.staged.append((out, folder))
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes what stage() gave, once nothing reads it any more."""
        for df, folder in self.staged:
            if any(df is x for x in frames):
                self.store.files.delete(folder)
        self.staged = [x for x in self.staged if not any(x[0] is y for y in frames)]

    def merge(self, table: str, changes: DataFrame, combine: Combine | None = None) -> list[int]:
        """Puts changes (the key and any columns) into the table and returns the buckets rewritten. Of several changes for a key the greatest row counts.
        changes is worked out once where the table is empty, else once more than there are parts: give what stage() returns, or something cheap."""
        if not self.held[table]:  # there is nothing to read, so the buckets are those that are written
            return self._merge(table, changes, [], combine)
        return sorted(b for only, rows in self.parts(table, changes) for b in self._merge(table, rows, only, combine))

    def _merge(self, table: str, changes: DataFrame, touched: list[int], combine: Combine | None) -> list[int]:
        """merge() for the changes of some buckets, or of all where the table is empty."""
        store, key = self.store, list(self.store.tables[table].key)
        fields = [f for f in store.schema(table) if f.name not in key]
        kind = StructType(fields).simpleString()

        def side(df: DataFrame, name: str) -> DataFrame:
            row = F.struct(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
            return df.select(store.bucket(table).alias("_bucket"), *key, *[(row if n == name else F.lit(None).cast(kind)).alias(n) for n in ("_old", "_new")])

        both = side(self.read(table, touched), "_old").unionByName(side(changes, "_new")).repartitionById(store.buckets, F.col("_bucket"))
        met = both.groupBy("_bucket", *key).agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
        old, new = F.col("_old"), F.col("_new")
        made = combine(old, new) if combine else {}
        usual = {f.name: F.when(new.isNotNull(), new[f.name]).otherwise(old[f.name]) if f.name in changes.columns else old[f.name] for f in fields}
        out = {c: F.col(c) for c in key} | {f.name: made.get(f.name, usual[f.name]).cast(f.dataType) for f in fields}
        if GONE in made:
            met = met.where(~F.coalesce(made[GONE], F.lit(False)))
        self.merges += 1
        folder = f"{self.folder}/{self.merges:02d}-{table}"
        write(met.select("_bucket", *[out[f.name].alias(f.name) for f in store.schema(table)]), f"{store.files.root}/{folder}", "_bucket")
        written = {n.removeprefix("_bucket=") for n in store.files.names(folder) if n.startswith("_bucket=")}
        touched = touched or sorted(map(int, written))
        for b in map(str, touched):
            if b in written:
                self.held[table][b] = f"{folder}/_bucket={b}"
            else:
                self.held[table].pop(b, None)
        return touched

    def publish(self, *kept: DataFrame, **notes: object) -> int:
        """Makes this batch the newest version, with notes put over the older ones. What was staged goes, but for kept, which stays until a vacuum."""
        version = self.parent + 1
        if not self.store.files.publish(f"versions/{version:08d}.json", {"buckets": self.store.buckets, "tables": self.held, "notes": self.notes | notes}):
            raise Conflict(f"version {version} was published by another batch")
        self.drop(*[df for df, _ in self.staged if not any(df is x for x in kept)])
        return version

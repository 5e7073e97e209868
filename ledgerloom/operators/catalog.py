"""Categories, vendor aliases and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.fixed import DEFAULT_SETTINGS
from ledgerloom.functions.text import blank_to_null, normalize_vendor, strip


def category_counts(categories: DataFrame, receipts: DataFrame) -> DataFrame:
    counts = receipts.where("category_id IS NOT NULL").groupBy(F.col("category_id").alias("id")).agg(F.count("*").alias("receipts"))
    return categories.join(counts, "id", "left").select("id", "name", F.coalesce("receipts", F.lit(0)).cast("long").alias("receipts")).orderBy("name")


def create_categories(categories: DataFrame, names: DataFrame, now: Column | None = None) -> DataFrame:
    """categories with new ones for names (name): trimmed, none blank, none that is there already; ids follow the greatest one in the order of names."""
    asked = names.select(strip(F.col("name")).alias("name")).where("name != ''").distinct().join(categories.select("name"), "name", "left_anti")
    # A request names a few categories, so numbering them in one place is no burden.
    numbered = asked.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("name")))
    last = categories.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    new = numbered.join(F.broadcast(last), F.lit(True))  # one row
    values = {"id": (F.col("_last") + F.col("_n")).cast(dict(categories.dtypes)["id"]), "name": F.col("name"), "created_at": now if now is not None else F.lit(None)}
    return categories.unionByName(new.select(*[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in categories.dtypes]))


def rename_category(categories: DataFrame, changes: DataFrame) -> DataFrame:
    """categories with the names of changes (id, name), trimmed; blank names change nothing, of several for one id the greatest counts."""
    new = changes.select("id", strip(F.col("name")).alias("name")).where("name != ''").groupBy("id").agg(F.max("name").alias("_name"))
    return categories.join(new, "id", "left").select(*[F.coalesce("_name", "name").alias("name") if c == "name" else F.col(c) for c in categories.columns])


def delete_categories(categories: DataFrame, receipts: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """categories without those of gone (id), and receipts that lose them."""
    keys = gone.select(F.col("id").alias("category_id"), F.lit(True).alias("_gone")).distinct()
    left = receipts.join(keys, "category_id", "left").select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == "category_id" else F.col(c) for c in receipts.columns])
    return categories.join(gone, "id", "left_anti"), left


def infer_category(receipts: DataFrame, history: DataFrame) -> DataFrame:
    """receipts without a category get that of the vendor's receipt updated last in history; ties by the greater id."""
    known = history.where("category_id IS NOT NULL AND normalized_vendor != ''")
    last = known.groupBy("normalized_vendor").agg(F.max_by("category_id", F.struct("updated_at", "id")).alias("_inferred"))
    return receipts.join(last, "normalized_vendor", "left").withColumn("category_id", F.coalesce("category_id", "_inferred")).select(receipts.columns)


def alias_keys(aliases: DataFrame) -> DataFrame:
    """normalized_raw, canonical_name and normalized_canonical; of several aliases for a key the first by id counts."""
    keyed = aliases.select("id", normalize_vendor(F.col("raw_name")).alias("normalized_raw"), "canonical_name", normalize_vendor(F.col("canonical_name")).alias("normalized_canonical"))
    first = keyed.groupBy("normalized_raw").agg(F.min_by(F.struct("canonical_name", "normalized_canonical"), "id").alias("x"))
    return first.select("normalized_raw", "x.*")


def resolve_vendors(names: DataFrame, aliases: DataFrame, column: str = "vendor") -> DataFrame:
    """names with resolved: the canonical name of an alias, or the name itself."""
    keys = alias_keys(aliases).select("normalized_raw", "canonical_name")
    keyed = names.withColumn("normalized_raw", blank_to_null(normalize_vendor(F.col(column))))
    return keyed.join(keys, "normalized_raw", "left").withColumn("resolved", F.coalesce("canonical_name", column)).select(*names.columns, "resolved")


def backfill_aliases(receipts: DataFrame, aliases: DataFrame) -> DataFrame:
    """receipts whose vendor has an alias get the canonical name and key."""
    keys = alias_keys(aliases).select(F.col("normalized_raw").alias("normalized_vendor"), "canonical_name", "normalized_canonical")
    new = {"vendor": F.coalesce("canonical_name", "vendor"), "normalized_vendor": F.coalesce("normalized_canonical", "normalized_vendor")}
    return receipts.join(keys, "normalized_vendor", "left").select(*[new.get(c, F.col(c)).alias(c) for c in receipts.columns])


def upsert_aliases(aliases: DataFrame, changes: DataFrame, now: Column | None = None) -> DataFrame:
    """aliases with those of changes (raw_name, canonical_name): an alias of the same key gets the new name and keeps its id
    and raw name, others are added with the next ids in the order of their keys. Of several changes for one key the greatest counts."""
    keyed = changes.select(normalize_vendor(F.col("raw_name")).alias("normalized_raw"), F.struct("raw_name", "canonical_name").alias("_new"))
    keyed = keyed.groupBy("normalized_raw").agg(F.max("_new").alias("_new"))
    name, key = F.col("_new.canonical_name"), normalize_vendor(F.col("_new.canonical_name"))
    changed = {"canonical_name": F.coalesce(name, F.col("canonical_name")), "normalized_canonical": F.when(name.isNotNull(), key).otherwise(F.col("normalized_canonical"))}
    kept = aliases.join(keyed, "normalized_raw", "left").select(*[changed.get(c, F.col(c)).alias(c) for c in aliases.columns])
    added = keyed.join(aliases.select("normalized_raw"), "normalized_raw", "left_anti")
    added = added.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("normalized_raw")))  # what one request adds
    added = added.join(F.broadcast(aliases.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))), F.lit(True))  # one row
    values = {
        "id": F.col("_last") + F.col("_n"), "raw_name": F.col("_new.raw_name"), "normalized_raw": F.col("normalized_raw"), "canonical_name": name, "normalized_canonical": key,
        "created_at": now if now is not None else F.lit(None),
    }
    return kept.unionByName(added.select(*[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in aliases.dtypes]))


def delete_aliases(aliases: DataFrame, gone: DataFrame) -> DataFrame:
    """aliases without those of gone (id). Receipts keep the names they were given."""
    return aliases.join(gone.select("id"), "id", "left_anti")


def merge_suggestions(receipts: DataFrame, threshold: int = 2) -> DataFrame:
    """key (the first two words), vendor, count, variants and receipts of keys with threshold vendors or more."""
    counts = receipts.where("normalized_vendor IS NOT NULL").groupBy(F.col("normalized_vendor").alias("vendor")).agg(F.count("id").alias("count"))
    words = F.filter(F.split("vendor", " "), lambda w: w != "")
    keyed = counts.withColumn("key", F.when(F.size(words) >= 2, F.array_join(F.slice(words, 1, 2), " ")).otherwise(F.col("vendor")))
    groups = keyed.groupBy("key").agg(F.count("*").alias("variants"), F.sum("count").alias("receipts")).where(F.col("variants") >= threshold)
    return keyed.join(groups, "key").select("key", "vendor", "count", "variants", "receipts").orderBy(F.desc("receipts"), "key", "vendor")


def settings(config: DataFrame) -> DataFrame:
    """One row of typed settings from rows of key and value."""
    value = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    flags = [(F.coalesce(value(k), F.lit(default)) == "true").alias(k) for k, default in DEFAULT_SETTINGS.items()]
    return config.agg(value("vision_model").alias("vision_model"), value("text_model").alias("text_model"), *flags)


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """current with changes' rows put in, or over the rows of the same key: null leaves a value; of several changes for one
    key the greatest row counts. Later steps write the result elsewhere."""
    rest = [c for c in changes.columns if c != key]
    new = changes.groupBy(key).agg(F.max(F.struct(*rest)).alias("_x")).select(key, *[F.col("_x")[c].alias(f"_{c}") for c in rest])
    columns = [F.col(c) if c == key or c not in changes.columns else F.coalesce(f"_{c}", c).alias(c) for c in current.columns]
    return current.join(new, key, "full_outer").select(columns)

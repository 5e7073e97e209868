"""Incremental processing: changed documents are parsed and merged into the state, by batch or by stream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions.fixed import DEFAULT_SETTINGS
from ledgerloom.functions.text import blank_to_null, content_hash, normalize_vendor
from ledgerloom.operators import catalog, review
from ledgerloom.operators.documents import batch_stats, changes, is_statement, shortened, usable
from ledgerloom.plans.providers import Provider, kept, parse
from ledgerloom.sources.sinks import batch_write_back


def latest(docs: DataFrame) -> DataFrame:
    """One row a document: of several that of the greatest text and tag, so that a batch's order does not matter. The
    grouping deals documents out by the key that the join with the state needs, so texts are shuffled once."""
    return docs.groupBy("doc_id").agg(F.max(F.struct("text", "tagged")).alias("x")).select("doc_id", "x.*")


def process(docs: DataFrame, state: DataFrame, *, as_of_year: int, provider: Provider | None = None, settings: dict | None = None, force: bool = False, limit: int | None = None, parity: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new state, parsed receipts) for docs (doc_id, text, tagged); limit: the first so many by doc_id only.

    settings are those of catalog.settings: text_model (a new one has texts parsed again and is kept in the state),
    use_stored_text_first, skip_vision_if_text_exists, force_rescan. A text too short to parse ends as an error; its hash
    is kept only with parity, where the next run then takes it for done. A statement of an account is done without a
    receipt; of other large texts a parser gets the beginning and the end.
    """
    if limit is not None:
        docs = docs.orderBy("doc_id").limit(limit)
    touched, receipts = results(latest(docs), state, as_of_year=as_of_year, provider=provider, settings=settings, force=force, parity=parity)
    untouched = state.join(docs.select("doc_id"), "doc_id", "left_anti")
    return untouched.select(touched.columns).unionByName(touched), receipts


def results(docs: DataFrame, state: DataFrame, *, as_of_year: int, provider: Provider | None = None, settings: dict | None = None, force: bool = False, parity: bool = False) -> tuple[DataFrame, DataFrame]:
    """As process, for docs of one row a document: the states of these documents alone, and the parsed receipts. state may hold other documents too."""
    return outcomes(looked_at(docs, state, settings=settings, force=force), as_of_year=as_of_year, provider=provider, settings=settings, parity=parity)


def _chosen(settings: dict | None) -> dict:
    return {k: v == "true" for k, v in DEFAULT_SETTINGS.items()} | {"text_model": None} | (settings or {})


def looked_at(docs: DataFrame, state: DataFrame, *, settings: dict | None = None, force: bool = False) -> DataFrame:
    """What each of docs, one row a document, needs (documents.changes), with the text that a parser would get."""
    chosen = _chosen(settings)
    found = changes(
        docs, state, text_model=chosen["text_model"], stored_first=chosen["use_stored_text_first"],
        skip_vision=chosen["skip_vision_if_text_exists"], force=force or chosen["force_rescan"],
    )
    return found.withColumn("statement", F.col("needs_ocr") & is_statement(F.col("used"))).withColumn("used", F.when(F.col("needs_ocr") & ~F.col("statement"), shortened(F.col("used"))).otherwise(F.col("used")))


def idle() -> Column:
    """Whether a row of looked_at is not parsed and its state stays as it is."""
    after = _state(F.lit(False), parity=False, text_model=None)
    return ~F.col("needs_parse") & F.struct(*[c.alias(n) for n, c in after.items()]).eqNullSafe(F.struct(*[F.col("was")[n].alias(n) for n in after]))


def _state(new: Column, *, parity: bool, text_model: str | None) -> dict[str, Column]:
    """The state of a row of looked_at afterwards; new: whether a receipt was found."""
    parsing = F.col("needs_parse") & ~F.col("statement")
    fails = parsing & ~usable(F.col("used"))
    statement = F.concat(F.lit("statement_detected:"), F.length("used").cast("string"), F.lit("_chars"))
    held = parsing & (F.lit(parity) | ~fails)
    return {
        "content_hash": F.col("content_hash"),
        "ocr_text": blank_to_null(F.col("used")),
        "parse_hash": F.when(held, content_hash(F.col("used"))).otherwise(F.col("parse_hash")),
        "text_model": F.when(held, F.lit(text_model)).otherwise(F.col("text_model")),
        "last_status": F.when(F.col("used") == "", "skipped").when(fails, "error").otherwise("done"),
        "error_message": F.when(F.col("used") == "", "No usable text").when(fails, "text_too_short").when(F.col("statement"), statement),
        "has_receipt": F.col("has_receipt") | new,
    }


def outcomes(found: DataFrame, *, as_of_year: int, provider: Provider | None = None, settings: dict | None = None, parity: bool = False) -> tuple[DataFrame, DataFrame]:
    """The states and the parsed receipts of what looked_at gives; it is worked out for each of the two."""
    todo = found.where("needs_parse AND NOT statement").where(usable(F.col("used"))).select("doc_id", F.col("used").alias("text"))
    parsed = parse(todo, as_of_year=as_of_year, provider=provider)
    receipts = parsed.where("is_receipt").select("doc_id", "receipt.*").withColumn("normalized_vendor", normalize_vendor(F.col("vendor")))
    if provider is None:  # then whatever is parsed is a receipt
        new = F.col("needs_parse") & ~F.col("statement") & usable(F.col("used"))
    else:
        receipts = kept(receipts)
        found = found.join(receipts.select("doc_id", F.lit(True).alias("_receipt")), "doc_id", "left")
        new = F.coalesce("_receipt", F.lit(False))
    after = _state(new, parity=parity, text_model=_chosen(settings)["text_model"])
    touched = found.select("doc_id", *[c.alias(n) for n, c in after.items()])
    return touched, receipts


def upsert_receipts(receipts: DataFrame, parsed: DataFrame, now: Column | None = None, key: str = "doc_id") -> DataFrame:
    """receipts with parsed ones put in or over by their key: all that parsed has is taken over, the category stays.
    With now, that is their updated_at, and the created_at of new ones; a new one's id is its document's."""
    new = parsed.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in parsed.columns if c != key and c in receipts.columns])
    rows = receipts.withColumn("_there", F.lit(True)).join(new, key, "full_outer")
    out = {c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in parsed.columns if f"_{c}" in new.columns}
    if "id" in receipts.columns and "id" not in out:
        out["id"] = F.coalesce("id", key)
    if now is not None:
        out |= {"updated_at": F.when(F.col("_hit"), now).otherwise(F.col("updated_at")), "created_at": F.when(F.col("_there").isNull(), now).otherwise(F.col("created_at"))}
    return rows.select(*[out.get(c, F.col(c)).alias(c) for c in receipts.columns])


@dataclass
class Ingested:
    """The tables after a batch, what is to be written back for it, and its counts."""

    state: DataFrame
    receipts: DataFrame
    flags: DataFrame
    write_back: DataFrame
    stats: DataFrame


def ingest(
    docs: DataFrame, state: DataFrame, receipts: DataFrame, flags: DataFrame, categories: DataFrame, *, as_of_year: int, now: Column, provider: Provider | None = None,
    settings: dict | None = None, force: bool = False, limit: int | None = None,
) -> Ingested:
    """One batch from texts to the ledger: parse what has changed, put the receipts in, give those without a category that of
    their vendor's receipt updated last, flag the doubtful ones, and say what goes back to the source.

    receipts and flags are tables of readers.RECEIPTS and readers.FLAGS; a receipt's document_id is the doc_id. Nothing is
    written: the caller stores the tables as next versions (sinks.write_snapshot). parsed receipts are cut by a
    checkpoint, so every document is parsed once."""
    state_after, parsed = process(docs, state, as_of_year=as_of_year, provider=provider, settings=settings, force=force, limit=limit)
    parsed = kept(parsed.withColumnRenamed("doc_id", "document_id"))
    batch = parsed.select("document_id")
    merged = upsert_receipts(receipts, parsed, now, "document_id")
    touched = merged.join(batch, "document_id", "left_semi")
    with_category = kept(catalog.infer_category(touched, merged))
    after = merged.join(batch, "document_id", "left_anti").select(receipts.columns).unionByName(with_category.select(receipts.columns))
    flagged = review.merge_flags(flags, review.flag(with_category), now)
    ran = docs.orderBy("doc_id").limit(limit) if limit is not None else docs
    outcome = state_after.join(ran.select("doc_id").distinct(), "doc_id").join(parsed.select(F.col("document_id").alias("doc_id"), F.size("warnings").alias("n_warnings")), "doc_id", "left")
    stats = batch_stats(outcome.select(F.col("last_status").alias("status"), F.col("has_receipt").alias("is_receipt"), F.coalesce("n_warnings", F.lit(0)).alias("n_warnings")))
    return Ingested(state_after, after, flagged, batch_write_back(with_category, categories), stats)


def status(spark: SparkSession, name: str = "receipt-batch") -> dict:
    """Whether the named stream is running, and what it last did."""
    found = next((q for q in spark.streams.active if q.name == name), None)
    return {"running": found is not None, "last": found.lastProgress if found else None}


def start(spark: SparkSession, source: str, schema: str, checkpoint: str, handle: Callable[[DataFrame, int], None], *, name: str = "receipt-batch") -> StreamingQuery:
    """Handles all new files of source once and stops; an outer scheduler starts it. A second start while one runs is refused."""
    if any(q.name == name for q in spark.streams.active):
        raise RuntimeError(f"{name} is running")
    docs = spark.readStream.schema(schema).parquet(source)
    return docs.writeStream.queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()

"""Source documents: gates before parsing, change detection, states, rows from text boxes, and what is written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import field_value
from ledgerloom.functions.fixed import BANK_KEYWORDS, BOTTOM_MARK, LARGE_TEXT_CHARS, LARGE_TEXT_GAP, LARGE_TEXT_HEAD, LARGE_TEXT_TAIL, MIN_TEXT_CHARS, OCR_ROW_GAP, RECEIPT_TAG, STATEMENT_CHARS, STATEMENT_KEYWORDS
from ledgerloom.functions.text import content_hash, let, strip


def is_pdf(column: str) -> Column:
    return F.coalesce(F.substring(F.col(column), 1, 4) == F.lit(b"%PDF"), F.lit(False))


def keyword_hits(text: Column) -> Column:
    words = F.array(*map(F.lit, BANK_KEYWORDS))
    return let(F.lower(text), lambda low: F.size(F.filter(words, lambda k: F.contains(low, k))))


def is_statement(text: Column, min_chars: int = STATEMENT_CHARS) -> Column:
    """Whether a text is long enough and holds enough of the words; only long texts are searched."""
    return (F.length(text) > min_chars) & let(F.lower(text), _enough_keywords)


def _enough_keywords(low: Column) -> Column:
    """keyword_hits(low) >= STATEMENT_KEYWORDS; when so many are found, the rest are not looked for."""
    words = F.array(*map(F.lit, BANK_KEYWORDS))
    hits = F.aggregate(words, F.lit(0), lambda n, k: F.when(n >= STATEMENT_KEYWORDS, n).when(F.contains(low, k), n + 1).otherwise(n))
    return hits >= STATEMENT_KEYWORDS


def usable(text: Column) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) >= MIN_TEXT_CHARS


def shortened(text: Column, limit: int = LARGE_TEXT_CHARS) -> Column:
    """A large text's beginning and end."""
    cut = F.concat(F.left(text, F.lit(LARGE_TEXT_HEAD)), F.lit(LARGE_TEXT_GAP), F.right(text, F.lit(LARGE_TEXT_TAIL)))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def good_text(text: Column) -> Column:
    """Whether embedded text can be used: 20 characters, 85 % of them printable, few unreadable font codes."""
    # What is printable in ASCII is told first, which is much cheaper than a character's category.
    size, unprintable = F.length(text), F.regexp_count(text, F.lit(r"[[^\x20-\x7E\n\t]&&[\p{C}\p{Zl}\p{Zp}]]"))
    codes = F.regexp_count(text, F.lit(r"\(cid:[0-9]+\)"))
    return F.coalesce((size >= 20) & ((size - unprintable) / size >= 0.85) & ~((codes > 5) & (codes * 8 / size > 0.15)), F.lit(False))


def gates(docs: DataFrame, *, statement_chars: int = STATEMENT_CHARS) -> DataFrame:
    """doc_id, n_chars, usable, good_text, is_large, is_statement, and the length of what a parser gets."""
    text = F.col("text")
    return docs.select(
        "doc_id",
        F.length(text).alias("n_chars"),
        usable(text).alias("usable"),
        good_text(strip(text)).alias("good_text"),
        (F.length(text) > LARGE_TEXT_CHARS).alias("is_large"),
        is_statement(text, statement_chars).alias("is_statement"),
        F.length(shortened(text)).alias("parse_chars"),
    )


def is_tagged(tags: Column) -> Column:
    """Whether tags (structs with a name) hold the receipt tag; plain ids never do."""
    return F.coalesce(F.exists(tags, lambda t: t["name"] == RECEIPT_TAG), F.lit(False))


def with_rescan(text: Column, bottom: Column, has_total: Column) -> Column:
    """A reader's text with what a second look at the bottom of the page gave, where the first found no total."""
    return F.when(~has_total & (strip(bottom) != ""), F.concat(text, F.lit(BOTTOM_MARK), bottom)).otherwise(text)


def chosen_text(pdf: Column, engine: Column, vision: Column, vision_method: Column, stored: Column, *, bottom: Column | None = None, has_total: Column | None = None) -> Column:
    """Struct of text and method: embedded text, else the engine's, else the vision reader's, else the stored text, else failed. A reader that failed gives null.

    The engine's own text must be usable; only then is what a second look at the bottom of the page gave put after it, where has_total is false."""
    pick = lambda text, method: F.struct(text.alias("text"), method.alias("method"))
    long = lambda text: F.coalesce(F.length(text) >= MIN_TEXT_CHARS, F.lit(False))
    return (
        F.when(long(pdf), pick(pdf, F.lit("pdf_direct")))
        .when(usable(engine), pick(engine if bottom is None else with_rescan(engine, bottom, has_total), F.lit("engine")))
        .when(vision.isNotNull(), pick(vision, F.concat(F.lit("vision_"), vision_method)))
        .when(long(stored), pick(stored, F.lit("stored_fallback")))
        .otherwise(pick(F.lit(""), F.lit("failed")))
    )


def enqueue(state: DataFrame, docs: DataFrame) -> DataFrame:
    """state with the documents of a batch marked as processing, new ones among them; all others as they are."""
    batch = docs.select("doc_id", F.lit(True).alias("_batch")).distinct()
    rows = state.join(batch, "doc_id", "full_outer")
    status = F.when(F.col("_batch"), "processing").otherwise(F.coalesce("last_status", F.lit("pending")))
    return rows.select(*[status.alias(c) if c == "last_status" else F.col(c) for c in state.columns])


def changes(docs: DataFrame, state: DataFrame, *, text_model: str | None = None, stored_first: bool = True, skip_vision: bool = True, force: bool = False) -> DataFrame:
    """What each document needs. docs: doc_id, text, tagged; state: doc_id, content_hash, ocr_text, parse_hash, text_model, has_receipt.

    Also used, the text that a parser gets (the stored text of the state where nothing is to be read again), of the state parse_hash, text_model and
    has_receipt, and was, the state as it was (null fields for none). Of rows of docs that share an id each gives a row."""
    named = {"content_hash": "_content", "ocr_text": "_ocr", "parse_hash": "_parse", "text_model": "_model", "last_status": "_status", "error_message": "_error", "has_receipt": "has_receipt"}
    named = {c: a for c, a in named.items() if c in state.columns}
    old = state.select("doc_id", *[F.col(c).alias(a) for c, a in named.items()])
    rows = docs.select("doc_id", strip(F.coalesce("text", F.lit(""))).alias("text"), "tagged").join(old, "doc_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    rows = rows.withColumn("content_hash", content_hash(F.col("text")))
    rows = rows.withColumns({
        "content_changed": F.col("content_hash").isNotNull() & ~F.col("content_hash").eqNullSafe(F.col("_content")),
        "model_changed": F.lit(bool(text_model)) & ~F.col("_model").eqNullSafe(F.lit(text_model)),
        "has_text": F.length("text") >= MIN_TEXT_CHARS,
        "forced": F.lit(force) | (~yes(F.col("tagged")) & yes(F.col("has_receipt"))),
    })
    rows = rows.withColumn("use_stored", F.col("has_text") & F.lit(stored_first) & ~F.col("forced") & (F.lit(skip_vision) | ~F.col("model_changed")))
    no_ocr = F.coalesce("_ocr", F.lit("")) == ""
    rows = rows.withColumn("needs_ocr", ~F.col("use_stored") & (F.col("forced") | F.col("content_changed") | no_ocr | ~F.col("has_text")))
    rows = rows.withColumn("used", F.when(F.col("use_stored") | F.col("needs_ocr") | no_ocr, F.col("text")).otherwise(F.col("_ocr")))
    fresh = ~content_hash(F.col("used")).eqNullSafe(F.col("_parse")) | F.col("_parse").isNull()
    rows = rows.withColumn("needs_parse", (F.col("used") != "") & (fresh | F.col("model_changed") | F.col("forced")))
    flags = ["content_changed", "model_changed", "has_text", "forced", "use_stored", "needs_ocr", "needs_parse"]
    return rows.select("doc_id", "content_hash", *flags, "used", F.col("_parse").alias("parse_hash"), F.col("_model").alias("text_model"), yes(F.col("has_receipt")).alias("has_receipt"), F.struct(*[F.col(a).alias(c) for c, a in named.items()]).alias("was"))


def batch_stats(results: DataFrame) -> DataFrame:
    """Counts of results (status, is_receipt, n_warnings); flagged counts receipts with warnings."""
    receipt = ~F.col("status").isin("error", "skipped") & F.col("is_receipt")
    return results.agg(
        F.count("*").alias("processed"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(receipt).alias("receipts"),
        F.count_if(receipt & (F.col("n_warnings") > 0)).alias("flagged"),
    )


def text_rows(boxes: DataFrame, gap: float = OCR_ROW_GAP) -> DataFrame:
    """doc_id, row and text from boxes (doc_id, y, ord, text): a row ends where the next box is gap lower or more."""
    over = Window.partitionBy("doc_id").orderBy("y", "ord")
    starts = F.when(F.col("y") - F.lag("y").over(over) < gap, 0).otherwise(1)
    rows = boxes.withColumn("start", starts).withColumn("row", F.sum("start").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct("y", "ord", "text")))
    return rows.groupBy("doc_id", "row").agg(F.array_join(F.transform(ordered, lambda b: b["text"]), " ").alias("text"))


def best_label(scores: Column, labels: list[str], threshold: float = 0.15) -> Column:
    """The label of the greatest score, if it reaches the threshold and is not the last, unknown."""
    at = F.array_position(scores, F.array_max(scores)).cast("int")
    found = F.get(F.array(*map(F.lit, labels)), at - 1)
    return F.when((F.array_max(scores) >= threshold) & (found != labels[-1]), found).otherwise("unknown")


def merged_tags(existing: Column, added: Column) -> Column:
    return F.array_sort(F.array_union(F.coalesce(existing, F.array().cast("array<int>")), added))


def custom_fields(updates: DataFrame, definitions: DataFrame, existing: DataFrame) -> DataFrame:
    """doc_id, field, value: all fields a document has after updates (doc_id, name, value) by definitions (name, field, data_type); names without one are left out."""
    new = updates.join(definitions, "name").select("doc_id", "field", field_value(F.col("data_type"), F.col("value")).alias("_value"))
    return existing.join(new, ["doc_id", "field"], "full_outer").select("doc_id", "field", F.coalesce("_value", "value").alias("value"))

"""Operator 12: benchmark decontamination by winnowed fingerprints.

Of every ``SPAN`` consecutive words, which hold ``SPAN - K + 1`` k-grams, the least k-gram hash is kept as the span's
fingerprint. It depends on the span's words alone, so a span that stands in a document and in a benchmark item has one
fingerprint in both: no shared span of ``SPAN`` words is missed, while neighbouring spans mostly share theirs. Documents'
fingerprints are joined with the items', and each hit is extended to its whole span, which must agree in two further
hashes (of 61 and 64 bits; word hashes are taken modulo 2^61 - 1). Hits that overlap or touch are merged into spans.
Items of fewer words than ``SPAN`` are one span each, searched at every place of a document; they are no longer than a
k-gram and its window, so winnowing has nothing to leave out there.

What is shuffled. A bit table of the items' fingerprints and spans (16 bits each, ``MAX_BITS`` in all at most, whatever
the benchmark's size) is broadcast. Only what passes it leaves a task, once for each document and distinct span, with its
places: a superset that shrinks to the exact hits in the join. The join's key holds the span as well as the fingerprint,
so a k-gram that a third of the documents and of the items share makes no pairs. A span that many items share does not
multiply either: spans with the same set of items form a class (items' hashes are combined by exclusive or, before the
shuffle), documents learn their classes, and each distinct set of classes is turned into its list of items once.

Defined cases: a null text, like one without words, has no words, hits or items; a text of fewer words than an item's span
cannot hold it; repeated rows, of documents or with the same id, each give a row of their own; items that share an id count
as one item; items without an id hit words but are neither counted nor listed; with no items nothing is hit; texts of any
length are searched whole; an empty table gives no rows; other columns are not read, whatever their names, and an id column
named like a column of the result is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import LETTER, LOWER, Rolling, cut, mix, runs, table, text_chunks

SPAN = 10
K = 5
#: Bits of the broadcast table at most (8 MB); more items make it less selective, never wrong.
MAX_BITS = 1 << 26
MIN_BITS = 1 << 16
_A, _B = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


class Chunk:
    """Words of some texts as hashes, with the texts that they stand in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        data = LOWER[data]
        starts, ends, self.docs = runs(LETTER[data], offsets)
        self.words = Rolling(data).of(starts, ends)
        self.first = np.searchsorted(self.docs, np.arange(len(offsets)))

    def places(self, size: int) -> np.ndarray:
        """Where spans of size words begin."""
        n = len(self.words) - size + 1
        return np.flatnonzero(self.docs[:n] == self.docs[size - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def spans(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the spans of size words that begin at at."""
        a, b = np.full(len(at), size, np.uint64), np.full(len(at), size, np.uint64) * _B
        for j in range(size):
            word = self.words[at + j]
            a = mix(a + _A) + word
            b = (b ^ (b >> np.uint64(29))) * _B + mix(word ^ _A)
        return mix(a), mix(b)

    def fingerprints(self, span: int, k: int) -> np.ndarray:
        """The fingerprint of the span that begins at each word, as if the texts were one."""
        n = len(self.words)
        if n < span:
            return np.zeros(0, np.uint64)
        grams = self.words[: n - k + 1].copy()
        for j in range(1, k):
            grams = grams * _A + self.words[j : n - k + 1 + j]
        grams = mix(grams)
        least = grams[: n - span + 1].copy()
        for j in range(1, span - k + 1):
            np.minimum(least, grams[j : n - span + 1 + j], out=least)
        return mix(least + _B)


class Bits:
    """The broadcast table: which keys may stand in the benchmark."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        held = np.ones(len(keys), bool)
        for at in (keys & self.mask, (keys >> np.uint64(32)) & self.mask):
            held &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return held


def _item_spans(items: DataFrame, item_col: str, text_col: str, span: int, k: int) -> DataFrame:
    """item (its id as a string), size, fp, a, b: the spans of every item."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(1)):
                chunk = Chunk(data, offsets)
                counts = np.diff(chunk.first)
                for size in [span, *sorted({int(c) for c in counts if 0 < c < span})]:
                    at = chunk.places(size) if size == span else chunk.first[:-1][counts == size]
                    a, b = chunk.spans(at, size)
                    fp = chunk.fingerprints(span, k)[at] if size == span else a
                    columns = [batch.column(0).slice(first, last - first).take(pa.array(chunk.docs[at])), pa.array(np.full(len(at), size, np.int32)), *(pa.array(x.view(np.int64)) for x in (fp, a, b))]
                    yield pa.RecordBatch.from_arrays(columns, ["item", "size", "fp", "a", "b"])

    return items.select(F.col(item_col).cast("string"), text_col).mapInArrow(task, "item string, size int, fp long, a long, b long")


def _bits(spans: DataFrame, count: int, most: int) -> Bits:
    """The bit table of count spans: words of 64 bits are put together by aggregation, so no more than the table comes to the driver."""
    size = MIN_BITS
    while size < min(32 * count, most):
        size *= 2
    keys = spans.select(F.explode(F.array("fp", "a")).alias("key"))
    places = keys.select(F.explode(F.array(F.col("key").bitwiseAND(size - 1), F.shiftrightunsigned("key", 32).bitwiseAND(size - 1))).alias("at"))
    words = places.groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 AS INT)))").alias("bits"))
    found = words.toArrow()
    held = np.zeros(size // 64, np.uint64)
    held[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Bits(held)


def _candidates(docs: DataFrame, id_col: str, text_col: str, bits: Bits, sizes: list[int], span: int, k: int) -> DataFrame:
    """row (a number of its own for every row), id, n_words and hits: distinct spans that pass the bit table, with the places (in words) where they begin."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    names = ["size", "fp", "a", "b", "at"]

    def found_in(chunk: Chunk) -> list[np.ndarray]:
        """size, fp, a, b, place of the spans that pass."""
        found = []
        for size in sizes:
            at = chunk.places(size)
            if size == span:
                fps = chunk.fingerprints(span, k)
                new = np.flatnonzero(np.concatenate([[True], fps[1:] != fps[:-1]])) if len(fps) else np.zeros(0, np.int64)
                passed = np.repeat(shared.value.may_hold(fps[new]), np.diff(np.append(new, len(fps))))
                at = at[passed[at]]
            a, b = chunk.spans(at, size)
            passed = shared.value.may_hold(a)
            at, a, b = at[passed], a[passed], b[passed]
            found.append((np.full(len(at), size, np.int32), fps[at] if size == span else a, a, b, at))
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(1)):
                chunk = Chunk(data, offsets)
                size, fp, a, b, at = found_in(chunk)
                order = np.lexsort((at, b, a, chunk.docs[at]))
                size, fp, a, b, at = (x[order] for x in (size, fp, a, b, at))
                doc = chunk.docs[at]
                new = np.ones(len(at), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                begins = np.flatnonzero(new)
                places = pa.ListArray.from_arrays(pa.array(np.append(begins, len(at)).astype(np.int32)), pa.array((at - chunk.first[doc]).astype(np.int32)))
                hits = pa.StructArray.from_arrays([pa.array(size[begins]), *(pa.array(x[begins].view(np.int64)) for x in (fp, a, b)), places], names)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[begins], np.arange(last - first + 1)).astype(np.int32)), hits)
                rows = pa.array(np.arange(row, row + last - first))
                row += last - first
                yield pa.RecordBatch.from_arrays([rows, batch.column(0).slice(first, last - first), pa.array(np.diff(chunk.first)), lists], ["row", "id", "n_words", "hits"])

    return docs.select(id_col, text_col).mapInArrow(task, f"row long, id {kind}, n_words long, hits array<struct<size:int,fp:bigint,a:bigint,b:bigint,at:array<int>>>")


def contamination(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, k: int = K, max_bits: int = MAX_BITS
) -> DataFrame:
    """id_col, n_words, n_hit (words in spans of items), spans (start and end, in words, merged) and items (sorted ids, as strings) of every row of docs."""
    if not 0 < k <= span or max_bits & (max_bits - 1) or max_bits > 1 << 31:
        raise ValueError("k is 1 to span; max_bits is a power of two, 2^31 at most")
    if id_col in ("n_words", "n_hit", "spans", "items"):
        raise ValueError(f"{id_col!r} is a column of the result")
    key = ["fp", "a", "b"]
    in_items = cut(_item_spans(items, item_col, item_text_col, span, k).distinct())
    sizes = sorted({r["size"] for r in in_items.select("size").distinct().collect()})
    bits = _bits(in_items, in_items.count(), max_bits)
    scanned = cut(_candidates(docs, id_col, text_col, bits, sizes or [span], span, k))

    # Spans with one set of items are a class, named by their number and two combined hashes of the items.
    in_set = lambda salt: F.expr(f"bit_xor(xxhash64(item, {salt}))")
    classes = in_items.groupBy(*key).agg(F.struct(F.count("*").alias("n"), in_set(1).alias("x"), in_set(2).alias("y")).alias("class"))
    members = classes.groupBy("class").agg(F.min(F.struct(*key)).alias("one")).select("class", "one.*").join(in_items.where("item IS NOT NULL"), key).select("class", "item")

    hits = scanned.where(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    # The fingerprint join, and the extension to the whole span.
    matched = hits.join(classes, key).select("row", "class", F.transform("at", lambda i: F.struct(i.alias("start"), (i + F.col("size")).alias("end"))).alias("spans"))
    by_doc = matched.groupBy("row").agg(F.array_sort(F.collect_set("class")).alias("classes"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("each"))
    by_doc = cut(by_doc.mapInArrow(_merged, "row long, classes array<struct<n:bigint,x:bigint,y:bigint>>, spans array<struct<start:int,end:int>>"))
    lists = by_doc.select("classes").distinct().select("classes", F.explode("classes").alias("class")).join(members, "class").groupBy("classes").agg(F.array_sort(F.collect_set("item")).alias("items"))
    by_doc = by_doc.join(lists, "classes", "left").select("row", "spans", "items")

    none = {"spans": F.lit(None).cast("array<struct<start:int,end:int>>"), "items": F.lit(None).cast("array<string>")}
    clean = scanned.where(F.size("hits") == 0).select("id", "n_words", *[c.alias(n) for n, c in none.items()])
    found = scanned.where(F.size("hits") > 0).select("row", "id", "n_words").join(by_doc, "row", "left").select("id", "n_words", "spans", "items").unionByName(clean)
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    spans, listed = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")), F.coalesce("items", F.array().cast("array<string>"))
    return found.select(F.col("id").alias(id_col), "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"), spans.alias("spans"), listed.alias("items"))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted spans of each row, those that overlap or touch put together."""
    for batch in batches:
        lists = batch.column(2)
        sizes = lists.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        starts, ends = (x.to_numpy().astype(np.int64) + (row << 32) for x in lists.flatten().flatten())
        # A span opens a merged one where it starts beyond all before it; rows are 2^32 apart.
        opens = np.flatnonzero(np.concatenate([[True], starts[1:] > np.maximum.accumulate(ends)[:-1]])) if len(starts) else np.zeros(0, np.int64)
        last = np.maximum.reduceat(ends, opens) if len(opens) else ends
        at = row[opens]
        merged = pa.StructArray.from_arrays([pa.array((x - (at << 32)).astype(np.int32)) for x in (starts[opens], last)], ["start", "end"])
        out = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(len(sizes) + 1)).astype(np.int32)), merged)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out], ["row", "classes", "spans"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH docs AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
items AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
wanted AS (SELECT item_id, least(len(w), {SPAN}) AS size, unnest([array_to_string(w[i : i + least(len(w), {SPAN}) - 1], ' ') FOR i IN range(1, greatest(len(w) - {SPAN - 1}, 1) + 1)]) AS words FROM items WHERE len(w) > 0),
spans AS (SELECT DISTINCT size, words FROM wanted),
placed AS (SELECT d.doc_id, s.size, d.w, unnest(range(1, len(d.w) - s.size + 2)) AS i FROM docs d, (SELECT DISTINCT size FROM spans) s WHERE len(d.w) >= s.size),
windows AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS words FROM placed),
found AS (SELECT doc_id, size, i, words FROM windows SEMI JOIN spans USING (size, words)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY doc_id),
held AS (SELECT DISTINCT f.doc_id, CAST(t.item_id AS VARCHAR) AS item FROM (SELECT DISTINCT doc_id, size, words FROM found) f JOIN wanted t USING (size, words)),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM held GROUP BY doc_id)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

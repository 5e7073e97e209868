"""Topics of texts: the nearest centroid of TF-IDF vectors. Fitted by spherical k-means to all texts and assigned to all.

A text's vector counts its words (runs of letters and digits, lower-cased) in ``FEATURES`` hash places; counts are damped by log(1 + n), weighted by
idf and scaled to length 1. The vectors are written once, as places and damped counts. Everything after that is a pass over this table in which each task adds up
what it reads and Spark adds up the tasks' sums by slices of the features: how many texts have a place (idf), the sums of the vectors that are likest to
each of ``STARTS`` fixed directions (of whose means those that differ most are the first centroids), and up to ``rounds`` times the sums by the nearest
centroid. Sums are of whole numbers, so they do not depend on how the table is dealt. The driver and a task hold ``TOPICS`` (or STARTS) times FEATURES numbers; the centroids
go along with the tasks. ``sample`` is for a quick look: the fit then reads that many texts, those with the lowest hash of id and text. No query gives it.

Defined cases: a null or empty text, or one without words, has the topic none, and so has every text if none holds words; ties go to the smaller
topic; rows that share an id and a text have one topic; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import LETTER, LOWER, Rolling, cut, drop, runs, text_chunks

FEATURES = 1 << 12
TOPICS = 12
#: Directions that the first centroids are found by.
STARTS = 64
ROUNDS = 10
#: Features whose sums go together, and steps into which a component from 0 to 1 is divided to be added up.
SLICE, STEPS = 512, 1 << 15
#: Texts whose vectors are held at once.
AT_ONCE = 256
NONE = "none"


def counts_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of damped word counts for each text of a chunk."""
    data = LOWER[data]
    starts, ends, docs = runs(LETTER[data], offsets)
    places = (Rolling(data).of(starts, ends) >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64)
    return np.log1p(np.bincount(docs * FEATURES + places, minlength=(len(offsets) - 1) * FEATURES).reshape(-1, FEATURES)).astype(np.float32)


def _few_at_once(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    for a in range(0, len(offsets) - 1, AT_ONCE):
        part = offsets[a : a + AT_ONCE + 1]
        yield counts_of(data[part[0] : part[-1]], part - part[0])


def _scaled(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of binary values, and the offsets of its rows."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data.view(kind) if data.ctypes.data % 4 == 0 else data.copy().view(kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def _components(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many components each row has, their places and their values."""
    docs, places = np.nonzero(rows)
    return np.bincount(docs, minlength=len(rows)), places.astype(np.uint16), rows[docs, places]


def vector_of(text: Column) -> Column:
    """The places of each text and the damped counts there, as a struct of two binary values; both empty for a text without words."""

    @F.arrow_udf("places binary, damped binary")
    def vector(texts: pa.Array) -> pa.Array:
        found = [x for _, _, data, offsets in text_chunks(texts) for rows in _few_at_once(data, offsets) for x in [_components(rows)]]
        sizes, places, damped = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, k) for k in (np.int64, np.uint16, np.float32))
        return pa.StructArray.from_arrays([_binary(places, np.cumsum(sizes)), _binary(damped, np.cumsum(sizes))], ["places", "damped"])

    return vector(text)


def _blocks(places: pa.Array, damped: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """A few vectors at once: how many, and of each component its row, place and damped count."""
    if not len(places):
        return
    (at, offsets), (values, _) = _flat(places, np.uint16), _flat(damped, np.float32)
    for a in range(0, len(places), AT_ONCE):
        part = offsets[a : a + AT_ONCE + 1]
        yield len(part) - 1, np.repeat(np.arange(len(part) - 1), np.diff(part)), at[part[0] : part[-1]].astype(np.int64), values[part[0] : part[-1]]


#: From a block of vectors (how many, and of each component its row, place and damped count) to the group of each row and what each component adds.
Share = Callable[[int, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _sums(table: DataFrame, groups: int, share: Share) -> tuple[np.ndarray, np.ndarray]:
    """How many rows of the table are in each group, and the sums of what they add to each place."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sizes = np.zeros((groups, FEATURES), np.int64), np.zeros(groups, np.int64)
        for batch in batches:
            for n, docs, places, damped in _blocks(batch.column(0), batch.column(1)):
                own, adds = share(n, docs, places, damped)
                sizes += np.bincount(own[np.unique(docs)], minlength=groups)
                total += np.bincount(own[docs] * FEATURES + places, adds, groups * FEATURES).reshape(groups, -1).astype(np.int64)
        yield from slices({(k, p): (sizes[k], total[k, p * SLICE : (p + 1) * SLICE]) for k in np.flatnonzero(sizes).tolist() for p in range(FEATURES // SLICE)})

    def slices(held: dict) -> Iterator[pa.RecordBatch]:
        keys = list(held)
        columns = [pa.array([k for k, _ in keys], pa.int32()), pa.array([p for _, p in keys], pa.int32()), pa.array([int(held[x][0]) for x in keys], pa.int64()), pa.array([held[x][1].tobytes() for x in keys], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["k", "part", "n", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for r in batch.to_pylist():
                n, sums = held.get((r["k"], r["part"]), (0, 0))
                held[r["k"], r["part"]] = n + r["n"], sums + np.frombuffer(r["sums"], np.int64)
        yield from slices(held)

    kind = "k int, part int, n long, sums binary"
    found = table.mapInArrow(task, kind).repartition(8, "k", "part").mapInArrow(merge, kind).collect()  # groups times FEATURES numbers
    sizes, total = np.zeros(groups, np.int64), np.zeros((groups, FEATURES), np.int64)
    for r in found:
        sizes[r.k], total[r.k, r.part * SLICE : (r.part + 1) * SLICE] = r.n, np.frombuffer(r.sums, np.int64)
    return sizes, total


def _nearest(idf: np.ndarray, centres: np.ndarray) -> Share:
    """Rows by the likest centre; components scaled, in whole steps."""

    def share(n: int, docs: np.ndarray, places: np.ndarray, damped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = damped * idf[places]
        values /= np.sqrt(np.bincount(docs, values**2, n))[docs]
        rows = np.zeros((n, FEATURES), np.float32)
        rows[docs, places] = values
        return (rows @ centres.T).argmax(1), np.rint(values * STEPS)

    return share


def _first_centres(idf: np.ndarray, texts_with: np.ndarray, table: DataFrame, topics: int) -> np.ndarray:
    """Means of the rows that are likest to one of the directions: the mean of the most rows, then each that is least like those before."""
    directions = np.random.default_rng(STARTS).standard_normal((STARTS, FEATURES)).astype(np.float32)
    usual = _scaled((texts_with * idf)[None].astype(np.float32))  # what most texts share tells none apart
    sizes, sums = _sums(table, STARTS, _nearest(idf, directions - directions @ usual.T * usual))
    means = _scaled(sums.astype(np.float32))
    some = np.flatnonzero(sizes)
    chosen = [int(sizes.argmax())]
    while len(chosen) < min(topics, len(some)):
        chosen.append(int(some[(means[some] @ means[chosen].T).max(1).argmin()]))
    return means[chosen]


def centroids_of(table: DataFrame, topics: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """idf and centroids of a table of vectors, in the order of how many rows they have."""
    sizes, sums = _sums(table, 1, lambda n, docs, places, damped: (np.zeros(n, np.int64), np.ones(len(docs))))
    idf = (np.log((1 + sizes[0]) / (1 + sums[0])) + 1).astype(np.float32)
    if not sizes[0]:
        return idf, np.zeros((0, FEATURES), np.float32)
    centres = _first_centres(idf, sums[0], table, topics)
    for _ in range(rounds):
        sizes, sums = _sums(table, len(centres), _nearest(idf, centres))
        moved = np.where((sizes > 0)[:, None], _scaled(sums.astype(np.float32)), centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return idf, centres[np.argsort(-sizes, kind="stable")]


@dataclass
class Topics:
    idf: np.ndarray
    centroids: np.ndarray

    def of(self, counts: np.ndarray) -> list[str]:
        rows = counts * self.idf
        if not len(self.centroids):
            return [NONE] * len(rows)
        best = (rows @ self.centroids.T).argmax(1)
        return [f"t{k:02d}" if some else NONE for k, some in zip(best.tolist(), rows.any(1).tolist(), strict=True)]


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", topics: int = TOPICS, sample: int | None = None) -> Topics:
    text = F.col(text_col)
    texts = docs.where(text != "")
    if sample is not None:
        texts = texts.orderBy(F.xxhash64(F.col(id_col).cast("string"), text)).limit(sample)
    table = cut(texts.select(vector_of(text).alias("v")).select("v.*"))
    model = Topics(*centroids_of(table, topics))
    drop(table)
    return model


def topic_of(text: Column, model: Topics) -> Column:
    """The topic of each text."""

    @F.arrow_udf("string")
    def topic(texts: pa.Array) -> pa.Array:
        return pa.array([t for _, _, data, offsets in text_chunks(texts) for part in _few_at_once(data, offsets) for t in model.of(part)], pa.string())

    return topic(text)


def topic_at(vector: Column, model: Topics) -> Column:
    """The topic of each vector: that of its text, without reading the text again."""

    @F.arrow_udf("string")
    def topic(places: pa.Array, damped: pa.Array) -> pa.Array:
        out: list[str] = []
        for n, docs, at, values in _blocks(places, damped):
            rows = np.zeros((n, FEATURES), np.float32)
            rows[docs, at] = values
            out += model.of(rows)
        return pa.array(out, pa.string())

    return topic(vector["places"], vector["damped"])

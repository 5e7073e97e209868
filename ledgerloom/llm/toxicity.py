"""Operator 2: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits, lower-cased. A document's features are its distinct words, pairs of
neighbouring words, and pairs with one word between, hashed to 2**bits places. Training follows the
regularised leader with rates of each coordinate and L1 sparsity, so that few weights stay other than 0;
those are broadcast (2**bits at most). It reads a bounded sample: at most ``train_docs`` labelled
documents of each class (lowest crc32 of the id first), never one whose crc32(id) mod 5 is 0.

Defined cases: a null or empty text has no features and gets the score of the bias; with no labels at all,
every score is 0 and nothing is toxic; with labels of one class the bias leans to that class; a null id has no label
and is not held out; a score of exactly 0.5 predicts 1; rows with equal features have equal scores; repeated rows each
give a row; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import LETTER, LOWER, Rolling, mix, runs, text_chunks

BITS = 20
FOLDS = 5


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, document) of every n-gram and skip-gram; a document's places may repeat."""
    data = LOWER[data]
    starts, ends, docs = runs(LETTER[data], offsets)
    words = Rolling(data).of(starts, ends)
    keys, owners = [words], [docs]
    for salt, gap in ((1, 1), (2, 2)):
        if len(words) > gap:
            at = np.flatnonzero(docs[:-gap] == docs[gap:])
            keys.append(mix(mix(words[at] + np.uint64(salt)) + words[at + gap]))
            owners.append(docs[at])
    shift = np.uint64(64 - bits)
    return (np.concatenate(keys) >> shift).astype(np.int64), np.concatenate(owners)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, *, bits: int, epochs: int = 8, alpha: float = 2.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0) -> np.ndarray:
    """Weights of 2**bits places and, last, the bias."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rows = [np.append(r, size - 1) for r in rows]
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at = rows[k]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - labels[k]
            rise = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - rise * w
            n[at] += g * g
    return weights(slice(None))


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = 6000, bits: int = BITS, **options: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(places with weights other than 0, their weights, bias). One task trains, on the bounded sample."""
    order = [F.crc32(F.col(id_col).cast("string")), F.col(id_col)]
    known = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).cast("int").alias("_label")).distinct()
    picked = [known.where(F.col("_label") == c).orderBy(*order).limit(train_docs) for c in (0, 1)]
    sample = picked[0].union(picked[1])  # at most 2 * train_docs rows, so it may be broadcast

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(2)):
                at, owner = features(data, offsets, bits)
                pairs = np.unique((owner << bits) | at)
                borders = np.searchsorted(pairs >> bits, np.arange(last - first + 1))
                places = (pairs & ((1 << bits) - 1)).astype(np.int32)
                rows = [places[a:b].tobytes() for a, b in zip(borders, borders[1:])]  # noqa: B905
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array(rows, pa.binary())], ["id", "label", "places"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, y, x) for b in batches for i, y, x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        if rows:
            w = ftrl([np.frombuffer(x, np.int32) for *_, x in rows], np.array([y for _, y, _ in rows]), bits=bits, **options)
            at = np.flatnonzero(w[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([w[at].tobytes()], pa.binary()), pa.array([w[-1]])], ["places", "weights", "bias"])

    rows = docs.select(id_col, text_col).join(F.broadcast(sample), id_col).select(F.col(id_col).cast("string").alias("id"), F.col("_label").alias("label"), text_col)
    found = rows.mapInArrow(hashed, "id string, label int, places binary").repartition(1).mapInArrow(learn, "places binary, weights binary, bias double").collect()
    if not found:
        return np.zeros(0, np.int32), np.zeros(0), -np.inf
    return np.frombuffer(found[0][0], np.int32), np.frombuffer(found[0][1]), found[0][2]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], *, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """id_col, held_out, score, predicted."""
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, bias = shared.value
        weights = np.zeros(1 << bits)
        weights[at] = values
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(2)):
                places, owner = features(data, offsets, bits)
                heavy = weights[places] != 0
                pairs = np.unique((owner[heavy] << bits) | places[heavy])
                sums = bias + np.bincount(pairs >> bits, weights[pairs & ((1 << bits) - 1)], minlength=last - first)
                p = 1 / (1 + np.exp(-np.clip(sums, -700, 700))) if np.isfinite(bias) else np.zeros(last - first)
                part = [batch.column(k).slice(first, last - first) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    return docs.select(id_col, held_out(id_col).alias("held_out"), text_col).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")

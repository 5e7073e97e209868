"""Operator 13: runs of periodic words, found by probing harmonic grids.

A run is a stretch of consecutive words with smallest period p, of at least ``times`` periods and ``least`` words, that no
neighbouring word extends with that period. A run of ``times`` periods covers ``times`` points of the grid 0, p, 2p, ... in
a row, so words are compared at jp and (j + 1)p only, n/p probes for each period and n log n in all; points where times - 1
comparisons in a row succeed survive. Survivors are compared at a few more places at once and then extended to both sides
in chunks that double in size.

Periods are taken in blocks [P, 2P), ascending. Survivors whose grid points all lie in a run that is known are skipped, and
so is a stretch that does: two runs of different smallest periods p > q share less than p + q words (theorem of Fine and
Wilf), less than the grid points of a survivor span, so none of a run with smallest period p is skipped; and a stretch with
a smaller period than p lies in a run whose period divides p, which an earlier block has found. As times is at least 3, a
text has less than n runs.

Words are told apart by a dictionary of the text's own, not by hashes. Every text is worked on alone: memory is some
hundred bytes a word of the longest text, and nothing is shuffled.

Defined cases: a null text counts as empty, which has no runs and collapses to the empty text; texts of any length are
searched whole; repeated rows each give a row; an empty table gives no rows; null ids pass through; other columns are not
read, whatever their names, and an id column named like a column of the result is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import table

TIMES = 4
LEAST = 6
#: Bytes of results that a task gathers before it hands them on.
FLUSH = 4 << 20
#: Further places at which survivors are compared before they are extended one by one.
AHEAD = 8
SEPARATORS = r"[\x20\x09-\x0D]+"

Run = tuple[int, int, int]


def _first(unequal: np.ndarray) -> int:
    """The first index that is True, or -1."""
    at = int(unequal.argmax()) if len(unequal) else 0
    return at if len(unequal) and unequal[at] else -1


def stretch(words: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """Start and end of the longest stretch around at in which words period apart are equal, if those at at are."""
    last, size, end = len(words) - period, 32, at
    while end < last:
        chunk = words[end : min(end + size, last)]
        miss = _first(chunk != words[end + period : end + period + len(chunk)])
        end += miss if miss >= 0 else len(chunk)
        if miss >= 0:
            break
        size *= 2
    start, size = at, 32
    while start > 0:
        low = max(0, start - size)
        miss = _first((words[low:start] != words[low + period : start + period])[::-1])
        start = start - miss if miss >= 0 else low
        if miss >= 0:
            break
        size *= 2
    return start, end + period


def runs_of(words: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[Run]:
    """(start, length, period) of every run, by start and then period, of words given as numbers."""
    n, low, found = len(words), 1, []
    starts, reach = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while low <= n // times:
        periods = np.arange(low, min(2 * low, n // times + 1))
        points = (n - 1) // periods - (times - 2)
        period = np.repeat(periods, points)
        at = (np.arange(len(period)) - np.repeat(np.cumsum(points) - points, points)) * period
        alive = np.flatnonzero(words[at] == words[at + period])
        at, period = at[alive], period[alive]
        for j in range(1, times - 1):
            alive = words[at + j * period] == words[at + (j + 1) * period]
            at, period = at[alive], period[alive]
        if len(at) and len(starts):
            before = np.searchsorted(starts, at, "right") - 1
            alive = (before < 0) | (reach[before] <= at + (times - 1) * period)
            at, period = at[alive], period[alive]
        for d in range(1, AHEAD + 1):
            if not len(at):
                break
            # A run's first grid point is followed by times - 2 periods of equal comparisons.
            beyond = d > (times - 2) * period
            place = np.where(beyond, at, at + d)
            alive = beyond | (words[place] == words[place + period])
            # Grid points further on in a run may be refused here: its first one never is.
            at, period = at[alive], period[alive]
        new, done = [], (0, 0)
        for p, i in zip(period.tolist(), at.tolist(), strict=True):
            if done[0] == p and i < done[1]:
                continue
            start, end = stretch(words, i, p)
            done = (p, end - p)
            if end - start < max(least, times * p):
                continue
            before = int(np.searchsorted(starts, start, "right")) - 1
            if before < 0 or reach[before] < end:
                new.append((start, end - start, p))
        if new:
            found += new
            order = np.array(sorted((s, s + length) for s, length, _ in found), np.int64)
            starts, reach = order[:, 0].copy(), np.maximum.accumulate(order[:, 1])
        low *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run covers after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, [s + p for s, _, p in runs], 1)
    np.add.at(change, [s + length for s, length, _ in runs], -1)
    return b" ".join(map(words.__getitem__, np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()))


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, least: int = LEAST) -> DataFrame:
    """id_col, runs (start, length and period, in words from 0, by start and period) and collapsed, the text with each run cut to its first period."""
    if times < 3:
        raise ValueError("times must be 3 at least")
    if id_col in ("runs", "collapsed"):
        raise ValueError(f"{id_col!r} is a column of the result")
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first, held, rows = batch.column(1).cast(pa.large_binary()), 0, 0, []
            for i in range(len(texts)):
                words = (texts[i].as_py() or b"").split()
                ids = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy() if words else np.zeros(0, np.int32)
                runs = runs_of(ids, times, least)
                rows.append((runs, collapse(words, runs)))
                held += len(rows[-1][1]) + 100
                if held >= FLUSH or i == len(texts) - 1:
                    spans = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r, _ in rows], run_type)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), spans, pa.array([t for _, t in rows], pa.binary()).cast(pa.string())], [id_col, "runs", "collapsed"])
                    first, held, rows = i + 1, 0, []

    return docs.select(id_col, text_col).mapInArrow(task, f"`{id_col}` {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def strongest(runs: Column | str) -> Column:
    """The run of greatest length / period, compared exactly; ties to the smaller start, then period. Null without runs."""
    runs = F.col(runs) if isinstance(runs, str) else runs
    better = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]  # noqa: E731  runs are sorted by start and period: the first of equals stays
    return F.when(F.size(runs) > 0, F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(better(r, best), r).otherwise(best)))


def planted(doc_id: Column, text: Column) -> Column:
    """The text that the query searches: in one document of ten, words from one place on repeat those that stand there."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        source = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, source(i).cast("int"))), " ")

    words = F.filter(F.split(text, SEPARATORS), lambda w: w != "")
    # An array of one array names the words, so that they are cut once and not for each word.
    done = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit(""))), F.lit(0))
    return F.when((h % 10 == 0) & text.isNotNull(), done).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    best = strongest(F.col("runs"))
    found = periodic_runs(docs).select("doc_id", "runs", "collapsed", best.alias("best"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )

"""What the corpus operators share: reading tables, cutting lineage, and byte-level text arithmetic in numpy.

Texts are handled as UTF-8 bytes in chunks of about ``CHUNK`` bytes, so the memory of a Python worker
depends on the longest text and not on the number of rows in a batch.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that are handled at once in a Python worker.
CHUNK = 1 << 20

#: Hashes of substrings are polynomials modulo this prime; modulo a power of two, texts of few letters can be built to collide.
PRIME = (1 << 61) - 1
_BASE = 0x12E3779B97F4A7C1
_M61, _M32, _M29 = np.uint64(PRIME), np.uint64((1 << 32) - 1), np.uint64((1 << 29) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_S61, _S32, _S29, _S3 = np.uint64(61), np.uint64(32), np.uint64(29), np.uint64(3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. One of our own is made only where none is set and all work is done in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Tables that cut() has written and nothing has dropped, one list for each open scratch().
_WRITTEN: list[list[DataFrame]] = [[]]


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: later steps neither repeat nor lose it."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._ledgerloom_path = path
    _WRITTEN[-1].append(out)
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes what cut() wrote, once nothing reads it any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._ledgerloom_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        for held in _WRITTEN:
            held[:] = [x for x in held if x is not df]


def clear() -> None:
    """Deletes all that cut() has written: to be called when no result of an operator is read any more."""
    for held in _WRITTEN:
        drop(*held)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end what is cut within it, but for what is kept()."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        drop(*_WRITTEN[-1])
        _WRITTEN.pop()


def kept(df: DataFrame) -> DataFrame:
    """df, which cut() has written, to outlive the innermost scratch()."""
    for held in _WRITTEN:
        held[:] = [x for x in held if x is not df]
    _WRITTEN[max(0, len(_WRITTEN) - 2)].append(df)
    return df


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (a finaliser of the splitmix kind)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & _M61) + (x >> _S61)
    return np.where(x >= _M61, x - _M61, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of values below it, by halves of 32 bits."""
    a1, a0, b1, b0 = a >> _S32, a & _M32, b >> _S32, b & _M32
    middle, low = a1 * b0 + a0 * b1, a0 * b0
    return reduced((a1 * b1 << _S3) + (middle >> _S29) + ((middle & _M29) << _S32) + (low >> _S61) + (low & _M61))


class Powers:
    """Powers of the hash base and of its inverse modulo PRIME, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK + CHUNK // 2)
            self.up, self.down = (self._grown(x, base, size) for x, base in ((self.up, _BASE), (self.down, pow(_BASE, -1, PRIME))))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _grown(known: np.ndarray, base: int, size: int) -> np.ndarray:
        while len(known) < size:
            known = np.concatenate([known, times(known, np.uint64(pow(base, len(known), PRIME)))])
        return known[:size].copy()


POWERS = Powers()


#: Values that are worked on at once, so that they stay in the processor's cache.
_BLOCK = 1 << 13


class Rolling:
    """61-bit hashes of any substrings of data, spread over 64 bits: equal bytes have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = POWERS.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        before = np.uint64(0)
        for a in range(0, len(data), _BLOCK):
            power, byte = up[a : a + _BLOCK][: len(data) - a], data[a : a + _BLOCK].astype(np.uint64) + np.uint64(1)
            high = byte * (power >> _S32)
            term = byte * (power & _M32) + (high >> _S29) + ((high & _M29) << _S32)
            high = np.cumsum(term >> _S32)
            part = reduced(reduced(np.cumsum(term & _M32) + (high >> _S29) + ((high & _M29) << _S32)) + before)
            self.sums[a + 1 : a + 1 + len(part)] = part
            before = part[-1]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        for a in range(0, len(starts), _BLOCK):
            first, last = starts[a : a + _BLOCK], ends[a : a + _BLOCK]
            out[a : a + _BLOCK] = mix(times(reduced(self.sums[last] + (_M61 - self.sums[first])), self.down[first]))
        return out


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """A cheap hash of every substring of size bytes, where a collision costs work at most: the sum of its bytes, coded and weighted, modulo 2**64."""
    code = mix(data.astype(np.uint64) + np.uint64(1))
    out = code[: max(0, len(code) - size + 1)].copy()
    for k in range(1, size):
        out *= _ODD
        out += code[k : k + len(out)]
    return mix(out)


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into them) of runs of rows; a null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of letters and digits; all bytes of characters beyond ASCII count as letters.
LETTER = np.zeros(256, bool)
LETTER[48:58] = LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the maximal runs of True that do not cross a document's border."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    edges = offsets[:-1][offsets[:-1] < len(inside)]
    before[edges] = False
    edges = offsets[1:][offsets[1:] > 0] - 1
    after[edges] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def grouped(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[pa.Table]:
    """The rows of each run of equal values in the named columns, for input that is sorted by them. Holds one run at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(batch.schema.get_field_index(n))) for n in names]
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        borders = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(borders, borders[1:]):  # noqa: B905
            key = tuple(k[a] for k in keys)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)

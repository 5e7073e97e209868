"""Operator 7: removal of repeated 200-byte strings by a distributed, common-prefix-aware merge sort of suffixes.

Sorting every suffix would exchange 200 times the text. Only those at anchors are sorted: the anchor of a
window of ``length`` bytes is the least (leftmost) 16-byte hash among its first ``GAP`` places. It depends on
the window's bytes alone, so equal windows have it at the same place.

1. Prefix detection. Each anchor sends a hash of its core (the bytes that all its windows hold) and one of its
   surroundings (all bytes of all its windows). A core that is nowhere else is dropped: its suffix is
   distinguished by a prefix. Anchors with equal surroundings are repeats in full and need no sorting.
2. Merge sort. What is left are cores with different surroundings; one anchor of each goes, as suffix and
   bytes to the left, into sorted front-coded runs. A task merges the runs of its cores by a loser tree
   (suffix_merge.py). From the common prefixes on both sides follows, for each place of the window around
   the anchor, which windows are equal.
3. A core with more than ``HOT`` different surroundings, such as the edge of a passage that a third of the
   documents share, is not sorted in one task: each window around its anchors is hashed and counted. Windows, like
   surroundings and hot cores, are reduced to one in the map task before they meet.
4. The covered bytes of each document are merged and removed.

Anchors meet by a shuffle on their core and are streamed in its order, so a task holds one core at a time. Work
is linear in the text. Hashes of cores, surroundings and windows have 61 bits and are believed.

Defined cases: a null text counts as empty; a text shorter than the window loses nothing; texts of any length
are taken whole; repeated rows count as repeats of each other and each give a row, as do rows that share an
id; an empty table gives no rows; other columns are not read. Cut characters stay cut: bytes are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Rolling, cut, grams, kept, mix, scratch, text_chunks
from ledgerloom.llm.suffix_merge import Run, front_code, merge

LENGTH = 200
GAP = 96
GRAM = 16
#: Anchors that a worker gathers before it sends them on, 32 bytes each.
FLUSH = 1_500_000
#: Different surroundings of one core that are sorted; beyond, its windows are counted.
HOT = 512
#: Anchors of one core that a task gathers before it looks whether that is hot.
HELD = 1 << 16
#: Suffixes that one task merges, on average.
MERGED = 50_000
#: Bits of a gram's hash that hold its place; a text with more places is taken in slices.
_PLACE = np.uint64((1 << 28) - 1)
SLICE = 1 << 27


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in the chunk, document) of every anchor of a whole window."""
    if len(data) > SLICE + length - 1:
        # A slice holds the windows that begin in SLICE places; an anchor depends on its window alone.
        parts = []
        for a in range(0, len(data) - length + 1, SLICE):
            part = data[a : a + SLICE + length - 1]
            parts.append(a + anchors_of(part, np.unique(np.clip(offsets - a, 0, len(part))), length)[0])
        found = np.unique(np.concatenate(parts))
        return found, np.searchsorted(offsets, found, "right") - 1
    last = len(data) - length
    if last < 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(last + GAP)
    least = (grams(data, GRAM)[: len(at)] & ~_PLACE) | at.astype(np.uint64)
    short = least
    for step in (1, 2, 4, 8, 16):
        short = np.minimum(short[:-step], short[step:])
    least = np.minimum(np.minimum(short[:-64], short[32:-32]), short[64:])  # GAP is 96: three times 32
    starts = np.arange(last + 1)
    docs = np.searchsorted(offsets, starts, "right") - 1
    whole = starts + length <= offsets[docs + 1]
    found = np.unique((least[: last + 1][whole] & _PLACE).astype(np.int64))
    return found, np.searchsorted(offsets, found, "right") - 1


def around(at: np.ndarray, docs: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes of an anchor's windows can stand to its left and, from it on, to its right."""
    return np.minimum(GAP - 1, at - offsets[docs]), np.minimum(length, offsets[docs + 1] - at)


def _bucket(core: np.ndarray, buckets: int) -> np.ndarray:
    return ((core >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


SETTLED, SORT, WINDOWS = 0, 1, 2
ANCHORS = "core long, whole long, row long, info long"
FOUND = "row long, at int, low int, high int, step int, wanted boolean"


def _marked(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    """Anchors of one flush. info holds the place, what is to the right and left, and two marks.

    many: 1 for one of several equal ones here, 2 for the others, which are settled. hot: of a core with
    more than HOT different surroundings here, 1 for the one that tells the core's task and 2 for the rest.
    """
    core, whole, row, at, left, right = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((whole, core))
    c, w = core[order], whole[order]
    same = np.zeros(len(order), bool)
    same[1:] = (c[1:] == c[:-1]) & (w[1:] == w[:-1])
    many, hot = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    many[order[same]] = 2
    many[order[~same & np.concatenate([same[1:], [False]])]] = 1
    kinds, kc = order[~same], c[~same]
    begins = np.flatnonzero(np.concatenate([[True], kc[1:] != kc[:-1]]))
    sizes = np.diff(np.append(begins, len(kc)))
    place, size = np.arange(len(kc)) - np.repeat(begins, sizes), np.repeat(sizes, sizes)
    hot[kinds] = np.where(size <= HOT, 0, np.where(place < 1, 1, 2))
    info = (at.astype(np.int64) << 32) | (right.astype(np.int64) << 12) | (left.astype(np.int64) << 4) | (many << 2) | hot
    return pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(row), pa.array(info)], ["core", "whole", "row", "info"])


def _detect_map(rows: DataFrame, length: int) -> DataFrame:
    """All anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        held = 0
        for batch in batches:
            keys = np.asarray(batch.column(0))
            for first, _, data, offsets in text_chunks(batch.column(1)):
                at, docs = anchors_of(data, offsets, length)
                if not len(at):
                    continue
                rolling = Rolling(data)
                left, right = around(at, docs, offsets, length)
                core = rolling.of(at, at + length - GAP + 1)
                whole = mix(rolling.of(at - left, at + right) + left.astype(np.uint64) * np.uint64(1 << 20) + right.astype(np.uint64))
                parts.append([core, whole, keys[first + docs], at - offsets[docs], left, right])
                held += len(at)
                if held > FLUSH:
                    yield _marked(parts)
                    parts, held = [], 0
        if held:
            yield _marked(parts)

    return rows.select("row", "text").mapInArrow(run, ANCHORS)


def _window_map(rows: DataFrame, length: int) -> DataFrame:
    """Every window around the given anchors, like an anchor: core and surroundings are the window itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        held = 0
        for batch in batches:
            for row, text, places in zip(*(batch.column(k) for k in range(3)), strict=True):
                data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                at = np.array([p["at"] for p in places.as_py()], np.int64)
                left, right = around(at, np.zeros(len(at), np.int64), np.array([0, len(data)]), length)
                starts = at[:, None] - np.arange(GAP)[None, :]
                fits = (starts >= at[:, None] - left[:, None]) & (starts + length <= (at + right)[:, None])
                at = np.unique(starts[fits])  # anchors near one another have windows in common
                window = Rolling(data).of(at, at + length)
                none, full = np.zeros(len(at), np.int64), np.full(len(at), length)
                parts.append([window, window, np.full(len(at), row.as_py(), np.int64), at, none, full])
                held += len(at)
                if held > FLUSH:
                    yield _marked(parts)
                    parts, held = [], 0
        if held:
            yield _marked(parts)

    return rows.mapInArrow(run, ANCHORS)


def _detected(anchors: DataFrame, length: int) -> DataFrame:
    """Settled anchors with the window places they cover, and anchors that are to be sorted or whose windows are to be counted."""

    def out(step: np.ndarray | int, wanted: np.ndarray | bool, x: list[np.ndarray]) -> pa.RecordBatch:
        _, _, row, info = x
        at, right, left = (info >> 32).astype(np.int32), (info >> 12) & ((1 << 20) - 1), (info >> 4) & 255
        columns = [row, at, np.maximum(0, length - right).astype(np.int32), np.minimum(left, GAP - 1).astype(np.int32), np.broadcast_to(np.int32(step), len(row)), np.broadcast_to(wanted, len(row))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "at", "low", "high", "step", "wanted"])

    def met(x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Of whole cores, sorted by core and surroundings."""
        core, whole, _, info = x
        many, hot = (info >> 2) & 3, info & 3
        new_core = np.concatenate([[True], core[1:] != core[:-1]])
        new_whole = new_core | np.concatenate([[True], whole[1:] != whole[:-1]])
        kind, group = np.cumsum(new_whole) - 1, np.cumsum(new_core) - 1
        copies = np.bincount(kind, 1 + (many == 1))
        kinds = np.bincount(group[new_whole])
        is_hot = (np.bincount(group, hot == 1) > 0) | (kinds > HOT)
        settled = copies[kind] > 1
        partner = new_whole & ((kinds[group] > 1) | is_hot[group])
        # Settled anchors cover their windows, also those that are partners of others in a later step.
        yield out(SETTLED, True, [c[settled] for c in x])
        yield out(np.where(is_hot[group], WINDOWS, SORT)[partner], ~settled[partner], [c[partner] for c in x])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = [np.zeros(0, np.int64)] * 4
        busy = None  # a core that was found hot before its end
        for batch in batches:
            x = [np.asarray(batch.column(k)) for k in range(4)]
            many, hot = (x[3] >> 2) & 3, x[3] & 3
            aside = (many == 2) | (hot == 2)
            yield out(SETTLED, True, [c[(many == 2) | ((hot == 2) & (many == 1))] for c in x])
            yield out(WINDOWS, True, [c[hot == 2] for c in x])
            x = [np.concatenate([t, c[~aside]]) for t, c in zip(tail, x, strict=True)]
            if busy is not None and len(x[0]):
                more = x[0] == busy
                yield out(WINDOWS, True, [c[more] for c in x])
                x = [c[~more] for c in x]
            if len(x[0]):
                whole = int(np.flatnonzero(x[0] == x[0][-1])[0])  # the last core may go on
                tail = [c[whole:] for c in x]
                if whole:
                    yield from met([c[:whole] for c in x])
                if len(tail[0]) > HELD and (tail[1][1:] != tail[1][:-1]).sum() > HOT:
                    busy = tail[0][-1]
                    yield out(WINDOWS, True, tail)
                    tail = [c[:0] for c in tail]
            else:
                tail = x
        if len(tail[0]):
            yield from met(tail)

    aside = (F.col("info").bitwiseAND(8) == 8) | (F.col("info").bitwiseAND(2) == 2)
    where = F.when(aside, F.xxhash64("row", "info")).otherwise(F.col("core"))
    return anchors.repartition(where).sortWithinPartitions("core", "whole").mapInArrow(run, FOUND)


RUN = [("shared", np.int32), ("lengths", np.int32), ("lefts", np.uint8), ("row", np.int64), ("at", np.int32), ("wanted", np.uint8)]


def _runs(rows: DataFrame, buckets: int, length: int) -> DataFrame:
    """row, text and places to front-coded sorted runs: one of each bucket and map task's flush."""

    def packed(entries: list[tuple[int, bytes, bytes, int, int, int]]) -> pa.RecordBatch:
        entries.sort()
        out: list[list] = [[] for _ in range(3 + len(RUN))]
        first = 0
        while first < len(entries):
            last = first
            while last < len(entries) and entries[last][0] == entries[first][0]:
                last += 1
            part = entries[first:last]
            shared, rests, lengths = front_code([e[1] for e in part])
            lefts = [len(e[2]) for e in part]
            columns = [shared, lengths, lefts, [e[3] for e in part], [e[4] for e in part], [e[5] for e in part]]
            for x, v in zip(out, [part[0][0], rests, b"".join(e[2] for e in part), *(np.array(c, k).tobytes() for c, (_, k) in zip(columns, RUN, strict=True))], strict=True):
                x.append(v)
            first = last
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], ["bucket", "rests", "left_bytes", *(n for n, _ in RUN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[tuple[int, bytes, bytes, int, int, int]] = []
        for batch in batches:
            for row, text, places in zip(*(batch.column(k) for k in range(3)), strict=True):
                data = (text.as_py() or "").encode()
                marks = places.as_py()
                at = np.array([p["at"] for p in marks], np.int64)
                core = Rolling(np.frombuffer(data, np.uint8)).of(at, at + length - GAP + 1)
                for p, b in zip(marks, _bucket(core, buckets).tolist(), strict=True):
                    a = p["at"]
                    entries.append((b, data[a : a + length], data[max(0, a - GAP + 1) : a][::-1], row.as_py(), a, int(p["wanted"])))
                if len(entries) > 100_000:
                    yield packed(entries)
                    entries = []
        if entries:
            yield packed(entries)

    return rows.mapInArrow(run, "bucket int, rests binary, left_bytes binary, " + ", ".join(f"{n} binary" for n, _ in RUN))


def equal_windows(suffixes: list[bytes], shared: np.ndarray, lefts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, in sorted order with its common prefixes, the least and greatest o for which the window from o bytes to its left is found elsewhere; -1 for none.

    Suffixes share a window at o if they share length - o bytes to the right and o bytes to the left.
    """
    n = len(suffixes)
    low, high = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    right_size, left_size = np.array([len(s) for s in suffixes]), np.array([len(s) for s in lefts])
    group = np.cumsum(shared < length - GAP + 1)
    # The bytes to the left, sorted within each group of equal cores.
    order = sorted(range(n), key=lambda k: (group[k], lefts[k]))
    left_shared = np.zeros(n, np.int64)
    for i in range(1, n):
        a, b = order[i - 1], order[i]
        if group[a] == group[b]:
            x, y = lefts[a], lefts[b]
            end = min(len(x), len(y))
            if x[:end] == y[:end]:
                left_shared[i] = end
            else:
                k = 0
                while x[k] == y[k]:
                    k += 1
                left_shared[i] = k
        else:
            left_shared[i] = -1
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    for o in range(GAP):
        there = (right_size >= length - o) & (left_size >= o)
        right_class = np.cumsum(shared < length - o)
        left_class = np.cumsum(left_shared < o)[back] if o else group
        at = np.flatnonzero(there)
        key = right_class[at] * np.int64(n + 1) + left_class[at]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        hit = np.zeros(len(at), bool)
        hit[by[1:][same]] = True
        hit[by[:-1][same]] = True
        found = at[hit]
        high[found] = o
        low[found[low[found] < 0]] = o
    return low, high


def _merge(length: int):
    def each(table: pa.Table) -> pa.Table:
        names = [n for n, _ in RUN]
        runs, fields, lefts = [], [], []
        for k in range(table.num_rows):
            x = {n: np.frombuffer(table.column(n)[k].as_buffer(), kind) for n, kind in RUN}
            runs.append(Run(x["shared"].tolist(), table.column("rests")[k].as_py(), x["lengths"].tolist()))
            fields.append(x)
            ends = np.cumsum(x["lefts"]).tolist()
            joined = table.column("left_bytes")[k].as_py()
            lefts.append([joined[e - n : e] for e, n in zip(ends, x["lefts"].tolist(), strict=True)])
        texts = [[] for _ in runs]
        for k, r in enumerate(runs):  # the strings themselves, for their lengths
            place = 0
            last = b""
            for n, size in zip(r.coded, r.lengths, strict=True):
                last = last[:n] + r.rests[place : place + size]
                place += size
                texts[k].append(last)
        order = merge(runs)
        column = {n: np.array([fields[r][n][i] for r, i, _ in order]) for n in names[3:]}
        low, high = equal_windows([texts[r][i] for r, i, _ in order], np.array([s for *_, s in order], np.int64), [lefts[r][i] for r, i, _ in order], length)
        keep = (high >= 0) & (column["wanted"] == 1)
        out = [column["row"][keep], column["at"][keep], low[keep], high[keep]]
        return pa.Table.from_arrays([pa.array(c) for c in out], ["row", "at", "low", "high"])

    return each


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_output: bool = False) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans and kept_sha256; with keep_output also kept (bytes)."""
    if not GAP + GRAM <= length < 1 << 20:
        raise ValueError(f"length must be {GAP + GRAM} or more and less than {1 << 20}")
    kind = dict(docs.dtypes)[id_col]
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(id_col).isNull(), F.col(text_col))
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"), key.alias("row")).toDF("id", "text", "row")
    with scratch():
        found = cut(_detected(_detect_map(rows, length), length))
        steps = {r.step: r.n for r in found.groupBy("step").agg(F.count("*").alias("n")).collect()}

        def with_text(step: int) -> DataFrame:
            places = found.where(F.col("step") == step).groupBy("row").agg(F.collect_set(F.struct("at", "wanted")).alias("places"))
            return rows.select("row", "text").join(places.hint("shuffle_hash"), "row").select("row", "text", "places")

        covered = found.where(F.col("step") == SETTLED).select("row", "at", "low", "high")
        if steps.get(SORT):
            buckets = max(8, -(-steps[SORT] // MERGED))
            covered = covered.union(_runs(with_text(SORT), buckets, length).groupBy("bucket").applyInArrow(_merge(length), "row long, at int, low int, high int"))
        if steps.get(WINDOWS):
            met = _detected(_window_map(with_text(WINDOWS), length), length)
            covered = covered.union(met.where(F.col("step") == SETTLED).select("row", "at", "low", "high"))
        spans = covered.groupBy("row").agg(F.collect_set(F.struct((F.col("at") - F.col("high")).alias("a"), (F.col("at") - F.col("low") + length).alias("b"))).alias("spans"))
        spans = kept(cut(spans))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                data = (text.as_py() or "").encode()
                mark = np.zeros(len(data) + 1, np.int64)
                if found.is_valid and len(found):
                    a, b = map(np.asarray, found.values.flatten())
                    np.add.at(mark, a, 1)
                    np.add.at(mark, b, -1)
                gone = np.cumsum(mark[:-1]) > 0
                begins = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if begins else data
                out.append((len(data), len(data) - len(kept), begins, hashlib.sha256(kept).hexdigest(), *([kept] if keep_output else [])))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names[: 1 + len(columns)])

    whole = rows.join(spans.hint("shuffle_hash"), "row", "left").select("id", "text", "spans")
    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_output
    return whole.mapInArrow(finish, schema)

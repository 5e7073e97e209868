"""Sets of word shingles, and the cells by which similar sets meet (used by operator 3).

Cells. Two sets x and y with Jaccard similarity 0.8 or more differ in D <= (|x| + |y|) / 9 elements. Cut the
hash space into more than D ranges: in one of them at least x and y hold the same elements. So the content
of each range, hashed, is a cell, and any linked pair meets in one. Sizes are classed so that linked sizes
are in one class or in neighbouring ones; each set enters the cells of its class and of the next. Ranges
where a set is empty are no cells, unless the set fills too few ranges to be sure of a common one. As D is
at most a quarter of either set, a set that fills f ranges shares f - D cells with any that it is linked to.
"""

from __future__ import annotations

import numpy as np

from ledgerloom.llm.common import LOWER, SPACE, Rolling, mix, runs

WORDS = 5
SIMILAR = 80  # per cent

#: Lower bounds of the size classes; each is 1.25 times the one before or more.
CLASSES = [1]
while CLASSES[-1] < 1 << 40:
    CLASSES.append(-(-CLASSES[-1] * 5 // 4))
CLASSES = np.array(CLASSES, np.int64)


def differing(klass: np.ndarray | int) -> np.ndarray | int:
    """The most elements in which linked sets that meet in this class can differ."""
    return 2 * (CLASSES[klass + 1] - 1) // 9


def ranges(klass: np.ndarray | int) -> np.ndarray | int:
    most = differing(klass)
    return np.where(most == 0, 1, (most + 1) * 11 // 10 + 2)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a chunk."""
    data = LOWER[data]
    starts, ends, docs = runs(~SPACE[data], offsets)
    words = Rolling(data).of(starts, ends)
    n = len(offsets) - 1
    borders = np.searchsorted(docs, np.arange(n + 1))
    counts = np.diff(borders)
    full = np.zeros(0, np.uint64)
    if len(words) >= WORDS:
        full = words[: len(words) - WORDS + 1]
        for k in range(1, WORDS):
            full = mix(full + np.uint64(k)) + words[k : len(words) - WORDS + 1 + k]
        full = mix(full)
    out = []
    for d in range(n):
        if counts[d] >= WORDS:
            h = np.sort(full[borders[d] : borders[d + 1] - WORDS + 1])
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        elif counts[d]:
            h = np.array([counts[d]], np.uint64)
            for k in range(borders[d], borders[d + 1]):
                h = mix(h + np.uint64(77)) + words[k : k + 1]
            out.append(mix(h))
        else:
            out.append(full[:0])
    return out


def cells(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, index of the set, mark) of each set's cells. The mark is twice the least number of cells that the set shares
    with any linked one in this class, plus 1 in the class above the set's own."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    home = np.searchsorted(CLASSES, sizes, "right") - 1
    found, owners, marks = [], [], []
    for up in (0, 1):
        klass = home + up
        m = np.where(sizes > 0, ranges(np.maximum(klass, 0)), 1)
        at = ((flat >> np.uint64(32)) * m[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        new = np.ones(len(flat), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1])
        begins = np.flatnonzero(new)
        if not len(begins):
            continue
        content = np.add.reduceat(mix(flat), begins)
        who, part = owner[begins], at[begins]
        label = mix((klass[who].astype(np.uint64) << np.uint64(40)) + part.astype(np.uint64))
        most = np.minimum(differing(np.maximum(klass, 0)), sizes // 4)
        filled = np.bincount(who, minlength=len(sets))
        mark = 2 * np.maximum(filled - most, 1) + up
        found.append(mix(content + label))
        owners.append(who)
        marks.append(mark[who])
        for s in np.flatnonzero((sizes > 0) & (filled <= most)):
            empty = np.setdiff1d(np.arange(m[s]), part[who == s])
            label = mix((np.uint64(klass[s]) << np.uint64(40)) + empty.astype(np.uint64))
            found.append(mix(label + np.uint64(1)))
            owners.append(np.full(len(empty), s))
            marks.append(np.full(len(empty), mark[s]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners), np.concatenate(marks)


def linked(shared: int, a: int, b: int) -> bool:
    """The exact test on the sizes of an intersection and of the two sets."""
    return 100 * shared >= SIMILAR * (a + b - shared) and shared > 0

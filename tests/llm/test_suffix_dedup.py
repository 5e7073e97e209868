"""Operator 7 against a dictionary of all windows, and its merge against sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle

from ledgerloom.llm import suffix_dedup
from ledgerloom.llm.suffix_dedup import remove_repeats
from ledgerloom.llm.suffix_merge import Run, common_prefix, front_code, merge


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        last = -1
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                for j in range(max(i, last), i + length):
                    gone[j] = True
                last = i + length
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, row string").repartition(4)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs).collect()}
    wanted = brute(texts)
    assert [found[k] for k in range(len(texts))] == wanted
    return wanted


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    words = ["alpha", "beta", "gâteau", "delta", "ε", "中文", "zz", "the", "of", "a"]
    make = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    passage, other = make(70), make(60)
    out = [None, "", "x" * 199, "x" * 200, "y" * 450, "ab" * 300, make(10)]
    for cut in (199, 200, 201, 250):
        same = "".join(rng.choice("abcdefgh") for _ in range(cut))
        out += [make(20) + same + make(15), make(3) + same, same]
    for _ in range(25):
        a, b = rng.randrange(len(passage) // 2), rng.randrange(len(passage) // 2, len(passage))
        out.append(make(rng.randrange(60)) + passage[a:b] + make(rng.randrange(60)) + (other if rng.random() < 0.5 else ""))
    base = make(200)
    for _ in range(8):
        at = rng.randrange(len(base))
        out.append(base[:at] + "#" * rng.randrange(3) + base[at + rng.randrange(4) :])
    return [*out, base, base, make(4000) + passage + make(500) + passage]


def test_against_all_windows(spark, texts):
    wanted = check(spark, texts)
    assert sum(n for _, n, *_ in wanted) > 5000


def test_hot_cores_by_windows(spark, texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    cloudpickle.register_pickle_by_value(suffix_dedup)
    check(spark, texts)
    cloudpickle.unregister_pickle_by_value(suffix_dedup)


def test_test_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    check(spark, [r.text for r in rows])


def test_repeated_rows_and_ids(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdef ") for _ in range(300))
    rows = [(1, text), (1, text), (2, text[:250]), (3, text[::-1]), (3, "short"), (None, text[40:] + "q")]
    found = sorted((r.doc_id or 0, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, "doc_id int, text string")).collect())
    assert found == [(0, 260), (1, 300), (1, 300), (2, 250), (3, 0), (3, 0)]
    assert remove_repeats(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_merge_sorts_and_knows_common_prefixes():
    rng = random.Random(4)
    for runs in (1, 2, 3, 7):
        parts = [sorted(bytes(rng.choices(b"ab", k=rng.randrange(9))) for _ in range(rng.randrange(30))) for _ in range(runs)]
        order = merge([Run(*front_code(p)) for p in parts])
        out = [parts[r][i] for r, i, _ in order]
        assert out == sorted(s for p in parts for s in p)
        assert [n for *_, n in order] == [0 if k == 0 else common_prefix(out[k - 1], s) for k, s in enumerate(out)]


def test_long_texts_are_searched_in_slices(monkeypatch):
    data = np.random.default_rng(5).integers(97, 100, 6000).astype(np.uint8)
    offsets = np.array([0, 50, 50, 1000, 1150, 6000])
    whole = suffix_dedup.anchors_of(data, offsets, 200)
    assert len(whole[0]) > 50
    for size in (300, 701):
        monkeypatch.setattr(suffix_dedup, "SLICE", size)
        for a, b in zip(whole, suffix_dedup.anchors_of(data, offsets, 200), strict=True):
            assert a.tolist() == b.tolist()

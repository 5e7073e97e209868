import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from ledgerloom.llm import periodic_runs, queries

SF = "/root/testdata/sf0.001"


def plain_runs(words, times=4, least=6):
    found = []
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            length = i + p - start
            if i > start and length >= max(least, times * p):
                part = words[start : i + p]
                if all(part[:-q] != part[q:] for q in range(1, p)):
                    found.append((start, length, p))
            i += i == start
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(kept))


def test_runs_of_random_words_equal_plain_loops():
    draw = random.Random(13)
    for _ in range(800):
        n, letters = draw.randint(0, 70), draw.choice([1, 2, 2, 3, 5])
        words = [draw.randrange(letters) for _ in range(n)]
        for _ in range(draw.randint(0, 3) if n > 4 else 0):
            a, p = draw.randrange(n), draw.randint(1, 9)
            for i in range(max(a, p), min(n, a + draw.randint(1, 60))):
                words[i] = words[i - p]
        times, least = draw.choice([3, 4, 5]), draw.choice([1, 6, 10])
        assert periodic_runs.runs_of(np.array(words, np.int32), times, least) == plain_runs(words, times, least)


def test_long_runs_are_extended_over_many_chunks():
    words = np.concatenate([np.arange(1000), np.tile(np.arange(5000, 5700), 9), np.arange(1000, 2000), np.zeros(50_000, int)])
    assert periodic_runs.runs_of(words) == [(1000, 6300, 700), (8300, 50_000, 1)]


def test_query_equals_plain_loops(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = sorted(map(tuple, queries.op13_periodic_runs(spark, SF).collect()))
    assert found == sorted(plain_row(*r) for r in rows)
    assert sum(r[1] > 0 for r in found) > 5


def test_defined_cases(spark):
    rows = [
        (1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "a a a a a", "x"), (5, "a a a a a a", "x"), (5, "a a a a a a", "x"), (None, "b\x0ba\x0cb a b a b a", "x"),
        (7, "            q", "x"), (8, " ".join(["x", "y", "z"] * 40_000 + ["end"]), "x"), (9, "a a a a a a b a a a a a a", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    found = sorted(periodic_runs.periodic_runs(docs).collect(), key=lambda r: (r[0] is None, r[0]))
    assert [(r[0], [tuple(x) for x in r[1]], r[2]) for r in found] == [
        (1, [], ""), (2, [], ""), (3, [], ""), (4, [], "a a a a a"), (5, [(0, 6, 1)], "a"), (5, [(0, 6, 1)], "a"), (7, [(0, 6, 1)], "  q"),
        (8, [(0, 120_000, 3)], "x y z end"), (9, [(0, 6, 1), (7, 6, 1)], "a b a"), (None, [(0, 8, 2)], "b a"),
    ]
    best = periodic_runs.periodic_runs(docs.where("doc_id = 9")).select(periodic_runs.strongest("runs").alias("b")).first().b
    assert tuple(best) == (0, 6, 1)
    assert periodic_runs.periodic_runs(docs.where("false")).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, id_col="runs")

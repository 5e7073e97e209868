"""Operator 4: documents without the words that each text needs are left out, and nothing else is."""

import random

from pyspark.sql import functions as F

from ledgerloom.llm import licenses


def documents(n, seed):
    """Prose with German `mit`, notices, pieces of bodies and CR line ends, in directories with licence files."""
    rng = random.Random(seed)
    prose = "rain sun wind mit all work the of and 0 Straße größer".split()
    texts = list(licenses.TEMPLATES.values()) + [t for _, t in licenses.license_texts()]
    rows = []
    for k in range(n):
        lines = [" ".join(rng.choices(prose, k=rng.randint(1, 12))) for _ in range(rng.randint(0, 8))]
        if rng.random() < 0.4:
            words = rng.choice(texts).split()
            start = rng.randrange(len(words))
            lines.insert(rng.randint(0, len(lines)), rng.choice(["", "# "]) + " ".join(words[start : start + rng.randint(1, 60)]).upper())
        rows.append((k, f"d{k % 5}/{rng.choice(['LICENSE', f'{k}.txt'])}", rng.choice(["\n", "\r\n", "\r"]).join(lines)))
    return [*rows, (n, "d0/x", None), (n + 1, "d0/y", ""), (n + 2, None, licenses.TEMPLATES["MIT"])]


def test_the_gate_of_documents_loses_nothing(spark, monkeypatch):
    files = spark.createDataFrame(documents(150, 3), "doc_id int, path string, text string").repartition(3)
    found = lambda: sorted(map(repr, licenses.scan(files).collect()))
    gated = found()
    monkeypatch.setattr(licenses, "_needed", lambda of, *_: set(of.df) | set("rain sun wind mit all work the of and 0 stra".split()))
    assert gated == found() and sum("own_license=None" not in r for r in gated) > 8


def test_only_documents_with_a_needed_word_are_cut_into_units(spark, monkeypatch):
    prose = [(k, "d/x.txt", f"the rain of day r{k}\nand the wind\n\n" * 3) for k in range(40)]
    files = spark.createDataFrame([*prose, (40, "d/y.txt", "rain\nReleased under the MIT License")], "doc_id int, path string, text string")
    read, match = [], licenses.best_matches

    def noted(units, *args, **kw):
        read.append({r._id for r in units.select("_id").distinct().collect()})
        return match(units, *args, **kw)

    monkeypatch.setattr(licenses, "best_matches", noted)
    assert [r.doc_id for r in licenses.scan(files).where("own_license = 'MIT'").collect()] == [40]
    assert read == [{40}, {40}]


def test_what_is_left_of_each_text_is_too_few(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    texts = [(f"L{k}", " ".join(rng.choices(words, k=rng.randint(1, 40)))) for k in range(12)]
    counted = spark.createDataFrame([(" ".join(rng.choices(words[:15] + ["other"], k=9)),) for _ in range(80)], "unit string")
    of = licenses.weigh(counted, texts)
    for least in (0.0, 0.3, 0.6, 1.0):
        needed = licenses._needed(of, of.in_units, of.total, least)
        for _, _, w in of.weights:
            left, norm = (sum(v * v for t, v in w.items() if every or t not in needed) for every in (False, True))
            assert left / norm < max(least - 5e-5, 0) ** 2 or not any(t not in needed for t in w)
    assert licenses._needed(of, of.in_units, of.total, 0.0) == set(of.df)


def test_quick_marker_is_the_marker(spark):
    parts = ["licens", "licenc", "Copyright", "rights reserved", "rights  reserved", "SPDX", "warrant", "redistribut", "public domain", "lice", "x", "K", "İ"]
    rng = random.Random(6)
    rows = spark.createDataFrame([("".join(rng.choices(parts, k=3))[rng.randint(0, 4) :],) for _ in range(300)], "t string").withColumn("t", F.lower("t"))
    assert rows.where(rows.t.rlike(licenses.MARKER) != rows.t.rlike(licenses.QUICK_MARKER)).count() == 0

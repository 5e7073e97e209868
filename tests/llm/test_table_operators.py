"""Operators 4, 6, 8, 9 and 10 and the pipeline against brute force or SQL, with nulls, ties, repeats and empty tables."""

import math
import random
import textwrap
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import common, licenses, line_dedup, mixing, queries, topics, url_lists, vector_search
from ledgerloom.llm.sentencepiece_codec import Codec, default_model
from tests.llm.test_text_operators import brute_components, shingles

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_like_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found, wanted = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    text = lambda rows: sorted(repr([str(r[c]) for c in columns]) for r in rows)
    assert text(found.collect()) == text(dict(zip(wanted.columns, r, strict=True)) for r in wanted.fetchall())


# Operator 10


def brute_lines(texts):
    lines = {k: t.split("\n") for k, t in texts.items() if t is not None}
    first = {}
    covered = {k: set() for k in texts}
    for k in sorted(lines):
        for i in range(len(lines[k]) - 2):
            window = tuple(lines[k][i : i + 3])
            if window in first:
                covered[k] |= {i, i + 1, i + 2}
            else:
                first[window] = (k, i)
    return {k: None if t is None else "\n".join(x for i, x in enumerate(lines[k]) if i not in covered[k]) for k, t in texts.items()}


def test_line_dedup(spark):
    rng = random.Random(6)
    texts = {k: "\n".join(rng.choice("abcdef") * rng.randint(0, 2) for _ in range(rng.randint(0, 30))) for k in range(40)}
    texts |= {40: None, 41: "", 42: "\n\n\n\n", 43: "a\na\na\na\na", 44: "x\ny", 45: "\n".join(f"line {k % 700}" for k in range(3000)), 46: texts[3]}
    docs = spark.createDataFrame([(k, t, -1, "z") for k, t in texts.items()], "doc_id long, text string, n_lines int, _hash string").repartition(3)
    found = line_dedup.dedup_lines(docs)
    assert {r.doc_id: r.text for r in found.collect()} == brute_lines(texts)
    assert found.columns == ["doc_id", "text", "_hash", "n_lines", "n_removed"]
    again = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc")], "doc_id int, text string")
    assert [r.text for r in line_dedup.dedup_lines(again).collect()] == ["a\nb\nc"] * 2
    assert line_dedup.dedup_lines(docs, counts=False).columns == docs.columns


def test_lines_whose_hashes_collide_are_told_apart(spark, monkeypatch):
    """The first of two hashes takes three values only, of windows and of documents."""
    rng, real = random.Random(7), F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(3)) if len(c) in (1, 3) else real(*c))
    texts = {k: "\n".join(rng.choice("abcd") * rng.randint(0, 2) for _ in range(20)) for k in range(30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == brute_lines(texts)
    assert line_dedup.dedup_lines(docs.where("doc_id < 0")).count() == 0


def test_line_dedup_of_shared_and_null_ids(spark):
    rng = random.Random(12)
    rows = [(rng.choice([None, 1, 2, 3, 3]), "\n".join(rng.choices("abc", k=rng.randint(0, 9)))) for _ in range(60)]
    rows += [(1, "a\nb\nc\nd\ne\nf"), (1, "q\nr\ns\na\nb\nc"), (None, None), (7, None)]
    docs = spark.createDataFrame([(i, t, [k], "y") for k, (i, t) in enumerate(rows)], "doc_id int, text string, _covered array<int>, _id string").repartition(4)
    keys = {tuple(r[:2]): r[2] for r in docs.select("doc_id", "text", F.xxhash64(F.col("doc_id").cast("string"), F.col("doc_id").isNull(), "text")).collect()}
    places = sorted((i is None, i or 0, keys[i, t], i, t) for i, t in set(rows) if t is not None)
    texts = brute_lines({k: t for k, (*_, t) in enumerate(places)})
    wanted = {(i, t): texts[k] for k, (*_, i, t) in enumerate(places)} | {(None, None): None, (7, None): None}
    found = {r._covered[0]: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert found == {k: wanted[r] for k, r in enumerate(rows)}
    assert found[60] == "a\nb\nc\nd\ne\nf" or "d\ne\nf" in found[60]


# Operator 6


def test_url_lists(spark):
    entries = [("bad.org", "add", 10), ("bad.org", "remove", 20), ("bad.org", "add", 20), ("BAD.org", "remove", 30), ("x.bad.org", "add", 15), ("gone.net", "remove", 1), (None, "add", 1), ("late.com", "add", 50), ("odd.com", "other", 1)]
    captures = [(1, "http://bad.org/a", 9), (2, "https://u:p@X.bad.org:8080?q", 10), (3, "http://x.bad.org", 16), (4, "http://bad.org.", 29), (5, "http://bad.org", 30), (6, None, 12), (7, "nothing", 12), (8, "http://gone.net", 5), (9, "http://late.com", None), (10, "http://notbad.org", 12), (1, "http://bad.org/a", 9)]
    table = spark.createDataFrame(entries, "domain string, action string, day int").repartition(3)
    found = url_lists.evaluate(spark.createDataFrame(captures, "id int, url string, day int"), table, id_col="id")
    got = sorted((r.id, r.listed, r.n_active, r.list_domain) for r in found.collect())
    assert got == [(1, False, 0, None), (1, False, 0, None), (2, True, 1, "bad.org"), (3, True, 2, "x.bad.org"), (4, True, 1, "bad.org"), (5, False, 0, None), (6, False, 0, None), (7, False, 0, None), (8, False, 0, None), (9, False, 0, None), (10, False, 0, None)]
    assert url_lists.evaluate(spark.createDataFrame(captures, "id int, url string, day int"), table.where("false"), id_col="id").where("listed").count() == 0


# Operator 4


def test_licenses(spark):
    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0"]
    files = [
        (1, "a/LICENSE", mit), (2, "a/b/c.txt", "plain"), (3, "a/b/d.txt", f"x\n  {apache}  \ny"), (4, "a/b/LICENSE.md", "no licence named"), (5, "e/f.txt", ""), (6, "e/g.txt", None),
        (7, None, mit), (8, "ab/x", "nothing"), (9, "a/q/COPYING", apache), (10, "a/q/r/s/t", "deep"), (10, "a/q/r/s/t", "deep"),
    ]
    found = licenses.scan(spark.createDataFrame(files, "doc_id int, path string, text string"))
    got = {r.doc_id: (r.own_license, r.inherited_license, r.inherited_from, r.license) for r in found.collect()}
    assert found.count() == len(files)
    assert got[1] == ("MIT", None, None, "MIT") and got[2] == (None, "MIT", "a", "MIT") and got[3][3] == "Apache-2.0"
    assert got[4][0] is None and got[4][3] == "MIT" and got[5][3] is None and got[6][3] is None and got[7][0] == "MIT" and got[8][3] is None
    assert got[10] == (None, "Apache-2.0", "a/q", "Apache-2.0")
    assert licenses.scan(spark.createDataFrame([], "doc_id int, path string, text string")).count() == 0


def test_licenses_of_blocks_and_whole_files(spark):
    texts = {}
    for name, text in licenses.license_texts():
        texts.setdefault(name, []).append(text)
    header = min(texts["Apache-2.0"], key=len)
    wrapped = "\n".join(f"# {x}" for x in textwrap.wrap(" ".join(header.split()), 40))
    files = [
        (1, "mit/LICENSE", "Copyright (c) 2020 Someone\n\n" + texts["MIT"][0]), (2, "mit/src/a.txt", "plain"), (3, "bsd/LICENSE", texts["BSD-3-Clause"][0]),
        (4, "gpl/COPYING", max(texts["GPL-3.0"], key=len)), (5, "x/a.py", wrapped + "\nimport os\nprint(os)\n"), (6, "x/b.txt", "Creative Commons Attribution 4.0 International"),
        (7, "x/c.py", "/*\n * Released under\n * the MIT License\n */\nint x;\nint y;"), (8, "x/d.txt", "the rain of the day\nand the use of it\nin any other form"), (9, "x/e.c", "".join(f" * {x}\r\n" for x in min(texts["GPL-3.0"], key=len).splitlines())),
        (10, "x/long.txt", "word here\n" * 30000), (11, None, texts["MIT"][0]),
    ]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(files, "doc_id int, path string, text string")).collect()}
    got = {k: r.own_license for k, r in found.items()}
    assert got == {1: "MIT", 2: None, 3: "BSD-3-Clause", 4: "GPL-3.0", 5: "Apache-2.0", 6: "CC-BY-4.0", 7: "MIT", 8: None, 9: "GPL-3.0", 10: None, 11: "MIT"}
    assert found[2].license == "MIT" and found[4].own_score > 0.95


def test_gate_of_licenses_keeps_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    words = [w for t in licenses.TEMPLATES.values() for w in t.split()] + ["rain", "sun", "wind"] * 20
    lines = [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(300)] + [t for t in licenses.TEMPLATES.values()]
    units = spark.createDataFrame(list(enumerate(lines)), "_id int, unit string")
    texts = sorted(licenses.TEMPLATES.items())
    best = lambda: sorted(map(tuple, licenses.best_matches(units, units, texts, 0.6).collect()))
    gated = best()
    # With few buckets and bits, bounds are loose and words are counted that nobody asked for.
    for name, n in (("BUCKETS", 7), ("PLACES", 5), ("LEAST_BITS", 64), ("MOST_BITS", 64)):
        monkeypatch.setattr(licenses, name, n)
    assert gated == best()
    monkeypatch.setattr(licenses, "_may_reach", lambda *_: F.lit(True))
    assert gated == best() and len(gated) > 8


# Operator 8


def raked(cells, wanted, sweeps=400):
    """Ratios of cells {(source, language, topic): tokens} by plain loops."""
    ratio = dict.fromkeys(cells, 1.0)
    for _ in range(sweeps):
        for d in range(3):
            for value, aim in wanted[d].items():
                now = sum(n * ratio[c] for c, n in cells.items() if c[d] == value)
                for c in cells:
                    if c[d] == value and now:
                        ratio[c] *= aim / now
    return ratio


def test_mixing_like_plain_raking(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(["w"] * rng.randint(0, 60)) + rng.choice(["", " 7", " | a | b"]), rng.choice("AAAAAB") if k % 9 else None, rng.choice(["en", "fr"]), k, "y") for k in range(600)]
    docs = spark.createDataFrame([*rows, (1000, None, "A", "en", 1, "y"), (1001, "", "B", "fr", 1, "y"), (None, "w", None, None, None, None)], "doc_id long, text string, source string, lang string, n int, row string").repartition(5)
    mixture = mixing.rake(docs, max_ratio=1e9)
    out = mixing.sample(docs, mixture).collect()
    assert len(out) == 603 and mixture.change < 1e-6 and out[0].row in ("y", None)
    cells = Counter()
    for r in out:
        cells[r.source or "", r.lang or "", r.topic] += r.n_tokens
    wanted = []
    for d in range(3):
        natural = Counter()
        for c, n in cells.items():
            natural[c[d]] += n
        shares = {k: v**mixing.TEMPER for k, v in natural.items() if v}
        wanted.append({k: v / sum(shares.values()) * sum(natural.values()) for k, v in shares.items()})
    ratio = raked(cells, wanted)
    greatest = max(ratio[c] for c, n in cells.items() if n)
    for r in out:
        c = r.source or "", r.lang or "", r.topic
        assert not cells[c] or math.isclose(r.ratio, ratio[c], rel_tol=1e-4) and math.isclose(r.probability, ratio[c] / greatest, rel_tol=1e-4)
    same = {(r.doc_id, r.sampled) for r in mixing.sample(docs.repartition(7), mixture).collect()}
    assert same == {(r.doc_id, r.sampled) for r in out}
    fixed = mixing.rake(docs, {"source": {"A": 1.0}})
    assert {r.ratio for r in mixing.sample(docs, fixed).where("source = 'B' AND n_tokens > 0").collect()} == {0.0}
    assert mixing.sample(docs.where("doc_id < 0"), mixing.rake(docs.where("doc_id < 0"))).count() == 0
    table = mixing.rake(docs, max_cells=1, max_ratio=1e9, sweeps=40)
    assert table.table is not None and table.change < 1e-6 and math.isclose(table.sampled_share(), mixture.sampled_share(), rel_tol=1e-4)
    assert {(r.doc_id, r.sampled) for r in mixing.sample(docs, table).collect()} == same


def test_mixing_sample_meets_skewed_targets(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(["w"] * 20) + rng.choice(["", "", "", " | a", " 7"]), "hot" if k % 3 == 0 else f"s{k % 19}", rng.choice(["en", "en", "fr"]), rng.choice("xyz")) for k in range(40000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, subject string").repartition(3)
    targets = {"topic": {"x": 0.6, "y": 0.3, "z": 0.1}, "lang": {"en": 0.3, "fr": 0.7}}
    mixture = mixing.rake(docs, targets, topic=F.col("subject"))
    taken = [r for r in mixing.sample(docs, mixture, topic=F.col("subject")).collect() if r.sampled]
    total = sum(r.n_tokens for r in taken)
    assert abs(total / sum(len(r[1].split()) for r in rows) / mixture.sampled_share() - 1) < 0.05
    for d, shares in targets.items():
        for value, share in shares.items():
            assert abs(sum(r.n_tokens for r in taken if r[d] == value) / total - share) < 0.02
    natural = Counter()
    for r in rows:
        natural[r[2]] += len(r[1].split())
    aims = {k: v**mixing.TEMPER for k, v in natural.items()}
    for k, v in aims.items():
        assert abs(sum(r.n_tokens for r in taken if r.source == k) / total - v / sum(aims.values())) < 0.02


def test_mixing_copies_meet_skewed_targets_whatever_a_rare_cell_wants(spark):
    rows = [(k, " ".join(["w"] * 20), "rare" if k < 12 else "hot" if k % 3 == 0 else f"s{k % 5}", "en" if k % 2 else "fr", "x" if k % 7 else "y") for k in range(20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, subject string").repartition(3)
    targets = {"topic": {"x": 0.6, "y": 0.4}, "lang": {"en": 0.3, "fr": 0.7}, "source": {"hot": 0.2, **{f"s{k}": 0.1594 for k in range(5)}, "rare": 0.003}}
    prepared = mixing.prepare(docs, topic=F.col("subject"))
    mixture = mixing.rake(prepared, targets)
    found = mixing.copies(prepared, mixture).collect()
    total = sum(r.n_tokens * r.copies for r in found)
    assert abs(total / (20 * len(rows)) - 1) < 0.02 and mixture.sampled_share() < 0.3
    for d, shares in targets.items():
        for value, share in shares.items():
            assert abs(sum(r.n_tokens * r.copies for r in found if r[d] == value) / total - share / sum(shares.values())) < 0.02
    bound = mixing.rake(prepared, targets | {"source": {"hot": 0.2, "rare": 0.8}})
    assert max(r for *_, r in bound.cells) == mixing.MAX_RATIO and bound.missed["source"] > 0.7 and max(mixture.missed.values()) < 0.001


def test_many_cells_are_raked_as_a_table(spark):
    docs = spark.range(130_000).selectExpr("id AS doc_id", "concat_ws(' ', array_repeat('w', int(1 + id % 3))) AS text", "concat('s', id) AS source", "IF(id % 4 = 0, 'en', 'fr') AS lang", "concat('t', id % 3) AS topic")
    mixture = mixing.rake(docs, {"lang": {"en": 0.5, "fr": 0.5}}, topic=F.col("topic"), sweeps=40, tolerance=1e-3)
    assert mixture.table is not None and mixture.table.count() == 130_000
    sums = mixture.table.groupBy("lang").agg((F.sum(F.col("n") * F.col("ratio")) / F.lit(260_000)).alias("share")).collect()
    assert all(abs(r.share - 0.5) < 0.02 for r in sums)
    assert mixing.copies(docs, mixture, topic=F.col("topic")).where("copies > 0").count() > 60_000


def test_topics_tell_kinds_of_text_apart(spark):
    rng = random.Random(3)
    kinds = [[f"{c}{k}" for k in range(30)] for c in "abc"]
    rows = [(k, " ".join(rng.choices(kinds[k % 3], k=rng.randint(5, 60)))) for k in range(300)] + [(300, None), (301, ""), (302, " .,! "), (303, kinds[0][0] * 3 + " " + " ".join(kinds[1] * 3000))]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    model = topics.fit(docs, topics=3, sample=150)
    found = {r.doc_id: r.t for r in docs.select("doc_id", topics.topic_of(F.col("text"), model).alias("t")).collect()}
    names = [{found[k] for k in range(300) if k % 3 == j} for j in range(3)]
    assert all(len(x) == 1 for x in names) and len(set.union(*names)) == 3
    assert [found[k] for k in (300, 301, 302)] == ["none"] * 3 and {found[303]} == names[1]
    nothing = topics.fit(docs.where("doc_id IN (300, 301)"))
    assert {r.t for r in docs.select(topics.topic_of(F.col("text"), nothing).alias("t")).collect()} == {"none"}


def test_mixing_stage_meets_its_targets_without_weights(spark):
    words = {"prose": ["rain", "sun", "wind", "tree"], "rare": ["table", "row", "cell", "sum"]}
    rows = [(k, " ".join(words["rare" if k % 100 == 7 else "prose"] * 5), "hot" if k % 3 == 0 else f"s{k % 19}", "en") for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    out = corpus_pipeline.mixing_stage(spark, docs, SF)
    assert out.columns == docs.columns
    for kind in (lambda r: r.source, lambda r: "table" in r.text):
        natural, real = Counter(), Counter()
        for counts, found in ((natural, docs.collect()), (real, out.collect())):
            for r in found:
                counts[kind(r)] += len(r.text.split())
        aims = {k: v**mixing.TEMPER for k, v in natural.items()}
        for k, v in aims.items():
            assert abs(real[k] / sum(real.values()) - v / sum(aims.values())) < 0.012
    few = spark.createDataFrame([(1, "w", "A", "en")], docs.schema)
    mixture = mixing.Mixture({}, [("A", "en", "prose", 1, 3.0)], 1, 0.0)
    assert mixing.resample(few, mixture).count() == 3


# Operator 9


def brute_top(vectors, k=20):
    whole = {i: tuple(math.floor(64 * x) for x in map(float, v)) for i, v in sorted(vectors) if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for q, v in whole.items():
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole.items() if i != q and len(w) == len(v))
            out |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 37, "block_rows": 5}, {"shard_rows": 10, "max_clusters": 3}])
def test_top_k(spark, sizes):
    rng = np.random.default_rng(3)
    near = rng.normal(size=(4, 6))
    vectors = [(k, [float(np.float32(x)) for x in near[k % 4] * 0.4 + rng.normal(size=6) * 0.1]) for k in range(300)]
    vectors += [(k, [0.25] * 6) for k in range(300, 360)]
    vectors += [(380, None), (381, [None] * 6), (382, [float("nan")] * 6), (383, [float("inf")] + [0.0] * 5), (400, [1.0, 2.0]), (401, [2.0, 1.0]), (420, []), (421, [])]
    rows = [(k, v, 0, 0) for k, v in vectors]
    docs = spark.createDataFrame([*rows, (None, [0.25] * 6, 0, 0)], "vec_id long, embedding array<float>, row int, kth int").repartition(5)
    found = vector_search.top_k(docs, **sizes).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found} == brute_top(vectors)
    assert vector_search.top_k(docs.where("false")).count() == 0


def test_top_k_of_repeated_rows(spark):
    docs = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [1.0]), (2, [2.0])], "vec_id long, embedding array<double>").repartition(3)
    each = [(0, 1, 2, 8192), (0, 2, 0, 4096), (0, 3, 1, 4096)]
    assert sorted(map(tuple, vector_search.top_k(docs).collect())) == sorted(each * 2)


def test_top_k_sends_no_pair_below_its_bound(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(16, 8)) * 4
    vectors = [(k, [float(x) for x in centres[k % 16] + rng.normal(size=8) * 0.05]) for k in range(4000)]
    docs = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(4)
    made = []
    found = vector_search.top_k(docs, shard_rows=125, made=made)
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found.collect()} == brute_top(vectors)
    assert sum(made) < 200 * 32 * 20 / 5  # of queries x shards x k


def test_bounds_skip_leaves():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.05, size=(200, 8)) for c in rng.normal(size=(10, 8)) * 5])
    q = x[:20]
    scores, best = vector_search.search(x, np.arange(len(x)), q, np.arange(20), np.full(20, -np.inf), 5)
    full = q @ x.T
    full[np.arange(20), np.arange(20)] = -np.inf
    assert np.allclose(scores, -np.sort(-full, axis=1)[:, :5])


# The pipeline


def test_pipeline_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns or k == len(corpus_pipeline.STAGES) - 1
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in kept.select("doc_id").collect()}
        if k == 1:
            texts = {r.doc_id: r.text for r in kept.collect()}
            assert {r.doc_id: r.text for r in after.collect()} == brute_lines(texts)
        if k == 2:
            sets = {r.doc_id: shingles(r.text) for r in kept.collect()}
            least = brute_components([r.text for r in sorted(kept.collect(), key=lambda r: r.doc_id)])
            order = sorted(sets)
            assert ids == {order[root] for _, root in least.values()} | {i for i in sets if not sets[i]}
        if k == 4:
            library = Codec(default_model()).library
            rows = sorted((r.doc_id, len(library.encode(r.text or ""))) for r in kept.collect())
            assert sorted((r.doc_id, r.n_tokens) for r in after.collect()) == rows
        counts.append(after.count())
        kept = after
    assert counts == sorted(counts, reverse=True) and counts[0] == counts[1] and counts[3] == counts[4]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    first = spark.read.parquet(str(tmp_path / "0"))
    clean = docs.join(labels.where("quality = 1"), "doc_id").where(F.size(F.split("text", r"\s+")) >= 60)
    assert clean.join(first, "doc_id", "left_anti").count() <= 0.05 * clean.count()
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == {tuple(r) for r in kept.collect()}


def test_pipeline_does_each_stage_once_and_leaves_one_table(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(spark, docs, sf_dir):
        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return docs.mapInArrow(run, docs.schema)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", counted), *corpus_pipeline.STAGES[1:]])
    common.clear()
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and seen.value == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sum(map(len, common._WRITTEN)) == 1


def test_pipeline_keeps_columns_and_null_ids(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["rain", "sun", "wind", "sea", "of", "the"]) + str(rng.randrange(99)) for _ in range(80))
    one = text()
    rows = [(k, text(), "en", "s", 5, "mine", 7) for k in range(30)] + [(None, text(), "en", "s", 5, "mine", 7), (40, one, "en", "s", 5, "mine", 7), (None, one + " x", "en", "s", 5, "mine", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, kept string, row int")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[1:-1]):
        docs = common.cut(stage(spark, docs, SF))
        kept = docs.collect() if k < 2 else kept
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_words", "kept", "row"]
        assert {tuple(r)[4:] for r in docs.collect()} == {(5, "mine", 7)}
    assert docs.count() <= 32 and len(kept) == 32 and sum(r.doc_id is None for r in kept) == 1 and one in {r.text for r in kept}


def test_pipeline_of_nothing(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_topics_are_fitted_to_all_texts(spark):
    """All 12,002 texts count for the idf, a kind of two texts has its own centroid, and the fit is the same however the table is dealt."""
    made = [(i, f"alpha beta gamma {'delta' if i % 2 else 'epsilon'}") for i in range(12_000)] + [(20_000 + i, "violin cello oboe flute") for i in range(2)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    one, other = topics.fit(docs.repartition(7), topics=3), topics.fit(docs.repartition(3), topics=3)
    assert (one.idf == other.idf).all() and (one.centroids == other.centroids).all() and len(one.centroids) == 3
    assert one.idf.max() == pytest.approx(np.log(1 + len(made)) + 1)
    found = {r.doc_id: r.t for r in docs.where("doc_id < 2 OR doc_id >= 20000").select("doc_id", topics.topic_of(F.col("text"), one).alias("t")).collect()}
    assert len({found[0], found[1], found[20_000]}) == 3 and found[20_000] == found[20_001]

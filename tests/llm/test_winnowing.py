import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from ledgerloom.llm import queries, winnowing

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, span=10):
    """(id, n_words, n_hit, spans, items) by comparing every span."""
    held = {}
    for item, text in items:
        w = words(text)
        m = min(len(w), span)
        for i in range(len(w) - m + 1 if w else 0):
            held.setdefault(tuple(w[i : i + m]), set()).add(item)
    sizes = {len(x) for x in held}
    rows = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if (x := tuple(w[i : i + m])) in held:
                    hit |= set(range(i, i + m))
                    found |= held[x]
        # Spans that touch are put together, so a span is a maximal stretch of hit words.
        spans = [[i, i] for i in sorted(hit) if i - 1 not in hit]
        for s in spans:
            while s[1] in hit:
                s[1] += 1
        rows.append((doc_id, len(w), len(hit), spans, sorted(str(x) for x in found if x is not None)))
    return rows


def result(df):
    return sorted(((r[0], r[1], r[2], [list(s) for s in r[3]], list(r[4])) for r in df.collect()), key=repr)


def test_query_equals_plain_comparison_and_sql(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = sorted(tuple(r) for r in queries.op12_winnowing(spark, SF).collect())
    wanted = sorted((d, n, hit, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), hit > 0) for d, n, hit, _, i in plain(docs, items))
    assert found == wanted and 0 < sum(r[5] for r in found) < len(found)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(con.sql(queries.oracle_sql()["op12_winnowing"]).fetchall()) == wanted


@pytest.mark.parametrize("span,k,letters", [(10, 5, 2), (4, 2, 3), (6, 6, 2), (5, 1, 4)])
def test_random_words_equal_plain_comparison(spark, span, k, letters):
    draw = random.Random(span)
    text = lambda n: " ".join(draw.choice("abcdefgh"[:letters]) for _ in range(n))
    items = [(i, text(draw.choice([1, 3, 5, 9, 12, 30]) if i > 3 else 14)) for i in range(12)]
    docs = [(i, text(draw.randint(0, 200))) for i in range(40)]
    found = winnowing.contamination(spark.createDataFrame(docs, "doc_id int, text string").repartition(3), spark.createDataFrame(items, "item_id int, text string"), span=span, k=k)
    assert result(found) == sorted(map(tuple, plain(docs, items, span)), key=repr)


def test_a_small_bit_table_changes_nothing(spark):
    draw = random.Random(4)
    text = lambda n: " ".join(draw.choice("abcdefghijklmnopqrst") * 2 for _ in range(n))
    items = [(i, text(40)) for i in range(60)]
    docs = [(i, text(50) + " " + items[i][1][20:90] + " " + text(50)) for i in range(50)]
    found = winnowing.contamination(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"), max_bits=64)
    assert result(found) == sorted(map(tuple, plain(docs, items)), key=repr)


def test_every_span_has_its_fingerprint_wherever_it_stands():
    draw = np.random.default_rng(2)
    w = [b"%d" % x for x in draw.integers(0, 50, 400)]
    other = [b"%d" % x for x in draw.integers(0, 50, 30)] + w[100:160] + [b"z"] * 20
    both = []
    for x in (w, other):
        data = np.frombuffer(b" ".join(x), np.uint8)
        chunk = winnowing.Chunk(data, np.array([0, len(data)]))
        both.append((chunk.fingerprints(10, 5), *chunk.spans(chunk.places(10), 10)))
    for a, b in zip(*both, strict=True):
        assert (a[100:151] == b[30:81]).all()
    assert len(set(both[0][0].tolist())) < 0.45 * len(both[0][0])


def test_defined_cases(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = [
        (1, None, "x"), (2, "", "x"), (3, "w0 w1", "x"), (4, passage, "x"), (4, passage, "x"), (4, "other", "x"), (None, passage.upper(), "x"), (7, "Ünder, w0; ONE\tw1", "x"), (8, "... !!", "x"),
        (9, " ".join(f"q{i}" for i in range(60_000)) + " " + passage, "x"), (10, passage + " " + passage, "x"),
    ]
    items = [(1, passage), (1, passage + " more"), (20, passage), (3, None), (4, ""), (5, "One!"), (None, "Ünder"), (6, "-")]
    frame = spark.createDataFrame(docs, "doc_id int, text string, hits string")
    found = winnowing.contamination(frame, spark.createDataFrame(items, "item_id int, text string"))
    assert result(found) == sorted(map(tuple, plain([d[:2] for d in docs], items)), key=repr)
    seven = found.where("doc_id = 7").first()
    assert (seven.n_hit, list(seven["items"])) == (2, ["5"])
    empty = spark.createDataFrame([], "item_id int, text string")
    assert result(winnowing.contamination(frame, empty)) == sorted(((i, len(words(t)), 0, [], []) for i, t, _ in docs), key=repr)
    assert winnowing.contamination(frame.where("false"), empty).collect() == []
    with pytest.raises(ValueError):
        winnowing.contamination(frame, empty, id_col="items")


def test_a_span_of_a_third_of_all_items_and_documents(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    items = [(i, passage + f" item {i} " + " ".join(f"i{i}x{j}" for j in range(12)) if i % 3 == 0 else " ".join(f"i{i}x{j}" for j in range(20))) for i in range(300)]
    docs = [(i, f"start {i} " + passage if i % 3 == 0 else items[i % 300][1]) for i in range(400)]
    found = winnowing.contamination(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"))
    assert result(found) == sorted(map(tuple, plain(docs, items)), key=repr)

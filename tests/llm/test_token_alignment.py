import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerloom.llm import queries, token_alignment

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain_tokens(libraries, text):
    """(ids, byte ends) of either side, of whole texts; None where bytes are not given back."""
    if not text:
        return None
    a, b = libraries
    value = token_alignment.byte_values()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    bytes_a = [bytes(value[c] for c in a.id_to_token(i)) for i in ids_a]
    ids_b = b.encode(text)
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, b.id_to_piece(ids_b), strict=True)]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return None
    out = []
    for ids, tokens in ((ids_a, bytes_a), (ids_b, bytes_b)):
        ends, at = [], 0
        for t in tokens:
            at += len(t)
            ends.append(at)
        out.append((ids, ends))
    return out


def plain_rows(libraries, docs, links="ends"):
    rows, pairs = [], []
    for doc_id, text in docs:
        sides = plain_tokens(libraries, text)
        if sides is None:
            rows.append((doc_id, 0, 0, 0, ""))
            pairs.append([])
            continue
        (ids_a, ends_a), (ids_b, ends_b) = sides
        cuts = sorted(set(ends_a) & set(ends_b))
        parts, i, j = [], 0, 0
        for c in cuts:
            left, right = [], []
            while i < len(ends_a) and ends_a[i] <= c:
                left.append(str(ids_a[i]))
                i += 1
            while j < len(ends_b) and ends_b[j] <= c:
                right.append(str(ids_b[j]))
                j += 1
            parts.append(",".join(left) + "|" + ",".join(right))
        rows.append((doc_id, len(ids_a), len(ids_b), len(cuts), ";".join(parts)))
        at_b = dict(zip(ends_b, ids_b, strict=True))
        found = [(x, at_b[e]) for x, e in zip(ids_a, ends_a, strict=True) if e in at_b]
        if links == "overlaps":
            starts_a, starts_b = [0, *ends_a[:-1]], [0, *ends_b[:-1]]
            found, j = [], 0
            for x, lo, hi in zip(ids_a, starts_a, ends_a, strict=True):
                while ends_b[j] <= lo:
                    j += 1
                k = j
                while k < len(ids_b) and starts_b[k] < hi:
                    found.append((x, ids_b[k]))
                    k += 1
        pairs.append(found)
    counts = Counter(p for found in pairs for p in found)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(*r, len(p), sum(counts[x] == best[x[1]] for x in p), sum(counts[x] for x in p)) for r, p in zip(rows, pairs, strict=True)]


TEXTS = [
    None, "", " ", "   ", "a", "a ", " a", "  a  b  ", "a\n b\n\n  c\t d", "x  y　 z", "a▁b", "a ▁ b", " ", "don't 's we'll 'LL", "1234 5678, (a) [b] {c}",
    "<s> </s> <unk> <|endoftext|>", "naïve café ﬁn ① é", "\U0001f600\U0001f601 \U0001f600", "中文没有空格的文本 中文", "\x00 \x01\x7f \x85 \x1c x", "word " * 500, "Zürich " * 3 + "\r\n\r\n x", "ab" * 3000,
    "​ ‍ a", "the The THE tHe", "a" * 50 + " " + "-" * 70 + "   " + "=" * 9,
]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_query_equals_plain_loops(spark, libraries):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    wanted = [(*r[:4], *r[5:], hashlib.sha256(r[4].encode()).hexdigest() if r[4] else "") for r in plain_rows(libraries, docs)]
    assert sorted(map(tuple, queries.op11_token_alignment(spark, SF).collect())) == sorted(wanted)


@pytest.mark.parametrize("links", ["ends", "overlaps"])
def test_odd_texts_in_small_blocks_equal_plain_loops(spark, libraries, links, monkeypatch):
    docs = [(i, t) for i, t in enumerate(TEXTS * 2)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id int, text string, links string").repartition(3)
    found = token_alignment.weigh(token_alignment.align(frame, links=links))
    assert rows_of(found, "doc_id", "n_a", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum") == sorted(plain_rows(libraries, docs, links), key=repr)


def test_pieces_blocks_and_a_table_that_is_emptied(libraries, monkeypatch):
    a, b = token_alignment.default_models()
    monkeypatch.setattr(token_alignment, "WORK", 40)
    monkeypatch.setattr(token_alignment, "TABLE_ROWS", 12)
    aligner = token_alignment.Aligner(token_alignment.byte_level(a), token_alignment.sentence_piece(b), "ends")
    texts = [t or "" for t in TEXTS] + ["many short words of one text, " * 9 + " and  spaces \n at all places " * 5 + "▁", "many short words of one text, " * 9]
    found = [(len(texts[i]), *counts[:3].tolist(), groups) for i, (_, counts, groups, _) in enumerate(token_alignment._results(aligner, texts))]
    assert found == [(len(t), *r[1:5]) for t, r in zip(texts, plain_rows(libraries, enumerate(texts)), strict=True)]
    assert all(len(x) <= 5 for x in token_alignment.pieces("ab " * 40, 10))
    for t in texts:
        cut = list(token_alignment.pieces(t, 10))
        assert [c for x in cut for c in x] == token_alignment.chunks(t)


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, None)], "doc_id int, text string")
    found = token_alignment.weigh(token_alignment.align(docs))
    assert rows_of(found, "doc_id", "n_links", "n_best", "count_sum") == [(1, 2, 2, 6), (1, 2, 2, 6), (2, 0, 0, 0), (None, 2, 2, 6)]
    assert token_alignment.weigh(token_alignment.align(docs.where("false"))).collect() == []
    with pytest.raises(ValueError):
        token_alignment.align(docs.withColumnRenamed("doc_id", "block"), id_col="block")


def test_new_chunks_are_aligned_in_portions(monkeypatch):
    """What is encoded and joined at once is bounded, however many chunks of the texts are new."""
    assert list(token_alignment.portions(["aa", "b", "cccc", "d"], 3)) == [["aa", "b"], ["cccc"], ["d"]]
    assert list(token_alignment.portions([], 3)) == []
    path_a, path_b = token_alignment.default_models()
    aligner = token_alignment.Aligner(token_alignment.byte_level(path_a), token_alignment.sentence_piece(path_b), "ends")
    texts = [" ".join(f"word{i * 7919 % 1000} x{i}" for i in range(k, k + 200)) for k in range(0, 2000, 200)]
    whole = [(c.tolist(), g, p.tolist()) for _, c, g, p in token_alignment._results(aligner, texts)]
    aligner.clear()
    seen, align = [], aligner.align
    monkeypatch.setattr(token_alignment, "PORTION", 1000)
    monkeypatch.setattr(aligner, "align", lambda a, *rest: seen.append(int(aligner.a.size[a].sum())) or align(a, *rest))
    assert [(c.tolist(), g, p.tolist()) for _, c, g, p in token_alignment._results(aligner, texts)] == whole
    assert len(seen) > 5 and max(seen) <= 2000

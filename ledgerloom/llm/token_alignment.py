"""Operator 11: alignment of two tokenizers over one corpus, in DuckDB per Arrow partition.

Both tokenizers cut a text at a space that follows no white space: no token reaches over such a place from the left, so
the tokens of the chunk that begins there do not depend on what stands before it. Chunks repeat, so each task aligns the
distinct chunks that it meets, and texts are put together from theirs by
position. For the new chunks of some ``WORK`` characters the tokens of either side become an interval table (number, id, first byte, byte
after the last, on one line of bytes), which DuckDB joins: a window sum over the ends that both sides share numbers the
groups; an ASOF join finds the B token in which each A token ends; tokens that end together are links, or, if asked for, all
that overlap, which the range between two ASOF joins gives.

Counts over the corpus. A block of documents (``BLOCK`` characters, or one longer text) keeps its links as places in the
block's table of distinct id pairs, with the pairs' partial counts. Spark sums these by pair, marks the most frequent pair
of each B id, and joins the sums back to the blocks' tables, so a pair is shuffled once for each block and not for each link;
a last exchange brings a block and its table together. No table of all pairs is broadcast or brought to the driver.

The chunks' property is a property of the tokenizers: they are tried on ``PROBES`` when a task starts, and refused if cutting changes
anything. A text in which some chunk does not give its own bytes on both sides is encoded again as a whole.

Defined cases: texts that are null or empty, or whose bytes either side does not give back, have no tokens, links or groups
(zeros and the empty string); texts of any length are encoded whole, and a text without a place to cut is one chunk; repeated rows
each give a row and count; equal counts of a B id's pairs are all its best; an empty table gives no rows; null ids pass through; other
columns are not read, whatever their names, and an id column named like a column of the result is refused.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, table

#: Characters of text whose links share a table of pairs.
BLOCK = 2_000_000
#: Characters of text whose chunks are aligned at once.
WORK = 1_000_000
#: Characters of new chunks that are encoded and joined at once: what both libraries and DuckDB hold meanwhile is some hundred bytes for each.
PORTION = 250_000
#: Chunks and characters that a task keeps before its table is emptied.
TABLE_ROWS = 250_000
TABLE_CHARS = 10_000_000
#: What DuckDB may hold in memory; beyond, it writes to the worker's own folder for the time of a query.
DUCK_MEMORY = "100MB"
#: Chunks that one call's line holds, where none has white space in it.
LINE_CHUNKS = 64
MARKER = "▁"
PROBES = (
    "a", " a", "a ", "  ", "a b", " a  b ", "a\n b", "a \nb\t\tc ", "don't 's x's", "1 22 a1", "x y 　 z", "é é ﬁ", "\U0001f600 \U0001f600\U0001f601", "中文 中",
    "<s> </s> <unk> <|endoftext|> <|endoftext|>", "\x00 \x01 \x1c \x85 b", "%$ -- 3.4, (x) [y]", "​ ‍ a", "word " * 30,
)
_CUT = re.compile(r"(?<=\S) ")
_WIDE = re.compile(r"\s ")
RESULT = ("n_a", "n_b", "n_groups", "groups", "links", "pairs", "pair_counts", "block")

#: Which tokens are linked: SQL over the interval tables a and b.
LINKS = {
    "ends": "SELECT a.k AS ka, b.k AS kb FROM a ASOF JOIN b ON a.hi <= b.hi WHERE a.hi = b.hi ORDER BY ka",
    "overlaps": """
        WITH first AS (SELECT a.k, b.k AS kb FROM a ASOF JOIN b ON a.lo >= b.lo), last AS (SELECT a.k, b.k AS kb FROM a ASOF JOIN b ON a.hi <= b.hi)
        SELECT k AS ka, unnest(range(f.kb, l.kb + 1)) AS kb FROM first f JOIN last l USING (k) ORDER BY ka, kb""",
}
GROUPS = """
    CREATE OR REPLACE TEMP TABLE ends AS
    SELECT hi, CAST(sum(meets) OVER (ORDER BY hi ROWS UNBOUNDED PRECEDING) - meets AS BIGINT) AS g
    FROM (SELECT hi, CAST(count(*) = 2 AS INT) AS meets FROM (SELECT hi FROM a UNION ALL SELECT hi FROM b) GROUP BY hi)"""


def default_models() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def chunks(text: str) -> list[str]:
    """text cut at every space that follows no white space; the spaces are left out, one before the text is taken for granted."""
    return text.split(" ") if text[:1] != " " and not _WIDE.search(text) else _CUT.split(text)


def pieces(text: str, most: int) -> Iterator[list[str]]:
    """The chunks of a text in lists of some most characters."""
    start = 0
    while True:
        place = _CUT.search(text, start + most) if len(text) - start > most else None
        yield chunks(text[start : place.start() if place else len(text)])
        if not place:
            return
        start = place.end()


def portions(found: list[str], most: int) -> Iterator[list[str]]:
    """found in lists of no more than most characters, or of one longer text."""
    some: list[str] = []
    held = 0
    for c in found:
        if some and held + len(c) > most:
            yield some
            some, held = [], 0
        some.append(c)
        held += len(c)
    if some:
        yield some


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others counted up from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer: encode takes texts and gives the ids of a space followed by each; token is the bytes of each id."""

    def __init__(self, encode: Callable[[list[str]], Iterable[list[int]]], token: list[bytes]) -> None:
        self.encode, self.token = encode, token
        self.size = np.array([len(t) for t in token], np.int64)
        self.begins = np.array([t[:1] == b" " for t in token])

    def text(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def byte_level(path: str) -> Side:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    value, token = byte_values(), [b""] * library.get_vocab_size()
    for t, i in library.get_vocab().items():
        token[i] = bytes(map(value.__getitem__, t)) if all(c in value for c in t) else t.encode()
    return Side(lambda texts: [x.ids for x in library.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], token)


def sentence_piece(path: str) -> Side:
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    token = [bytes([int(n[3:5], 16)]) if library.is_byte(i) else n.replace(MARKER, " ").encode() for i, n in enumerate(names)]
    alone = [library.piece_to_id(MARKER)]
    return Side(lambda texts: [ids if t else alone for t, ids in zip(texts, library.encode(texts, num_threads=1), strict=True)], token)


class Aligner:
    """The alignments of the chunks that a task has met; lives in a task."""

    def __init__(self, a: Side, b: Side, links: str) -> None:
        import duckdb

        self.a, self.b, self.links = a, b, LINKS[links]
        self.duck = duckdb.connect(config={"threads": 1, "memory_limit": DUCK_MEMORY})
        # An id with what follows it: a comma within a side's part of a group, else a bar after A's and a semicolon after B's.
        self.labels = [f"{i}{after}" for side, follow in ((a, ",|"), (b, ",;")) for after in follow for i in range(len(side.token))]
        self.label_sizes = np.array([len(x) for x in self.labels], np.int64)
        self.clear()
        for probe in PROBES:
            for side in (a, b):
                apart = [i for ids in side.encode(chunks(probe)) for i in ids]
                if apart != list(side.encode([probe])[0]):
                    raise ValueError(f"these tokenizers do not encode {probe!r} chunk by chunk")

    def clear(self) -> None:
        self.table: dict[str, int] = {}
        self.texts: list[str] = []
        self.chars = 0
        self.good, self.counts, self.first, self.pairs = np.zeros(0, bool), np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def align(self, ids_a: np.ndarray, ids_b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Of texts with tokens from_a[i] to from_a[i + 1] and so on: n_a, n_b, n_groups and n_links; the groups; all links' id pairs in order."""
        sides = {"a": (self.a.size[ids_a], ids_a), "b": (self.b.size[ids_b], ids_b)}
        for name, (size, ids) in sides.items():
            hi = np.cumsum(size)
            self.duck.register(name, pa.table({"k": np.arange(len(ids)), "lo": hi - size, "hi": hi}))
        self.duck.execute(GROUPS)
        group_a, group_b = (self.duck.execute(f"SELECT g FROM {n} JOIN ends USING (hi) ORDER BY k").fetchnumpy()["g"] for n in ("a", "b"))
        links = self.duck.execute(self.links).fetchnumpy()
        for name in sides:
            self.duck.unregister(name)

        last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
        label = np.empty(len(ids_a) + len(ids_b), np.int64)
        label[np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)] = ids_a + last_a * len(self.a.token)
        label[np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")] = ids_b + last_b * len(self.b.token) + 2 * len(self.a.token)
        text = "".join(map(self.labels.__getitem__, label.tolist()))
        edges = np.concatenate([[0], np.cumsum(self.label_sizes[label])])[from_a + from_b].tolist()
        groups = [text[x : y - 1] for x, y in zip(edges, edges[1:], strict=False)]
        n_groups = np.diff(np.concatenate([[0], np.cumsum(last_a)])[from_a])
        n_links = np.diff(np.searchsorted(links["ka"], from_a))
        pairs = (ids_a[links["ka"]].astype(np.int64) << 32) | ids_b[links["kb"]]
        return np.stack([np.diff(from_a), np.diff(from_b), n_groups, n_links], 1), groups, pairs

    def learn(self, found: list[str]) -> None:
        """Aligns the chunks that the table lacks."""
        new = [c for c in dict.fromkeys(found) if c not in self.table]
        self.chars += sum(map(len, new))
        if len(self.table) + len(new) > TABLE_ROWS or self.chars > TABLE_CHARS:
            self.clear()
            new = list(dict.fromkeys(found))
            self.chars = sum(map(len, new))
        for some in portions(new, PORTION):
            self.learn_new(some)

    def learn_new(self, new: list[str]) -> None:
        """Aligns chunks that are not in the table, all at once."""
        plain, alone = [], []
        for c in new:
            (plain if c.split() == [c] and MARKER not in c else alone).append(c)
        # Chunks without white space are encoded many to a line, which is cut where a token begins with a space.
        lines = [plain[i : i + LINE_CHUNKS] for i in range(0, len(plain), LINE_CHUNKS)]
        order: list[str] = []
        tokens: tuple[list, list] = ([], [])
        counts: tuple[list, list] = ([], [])
        bad: list[str] = []
        joined = [" ".join(line) for line in lines]
        for line, text, *ids in zip(lines, joined, self.a.encode(joined), self.b.encode(joined), strict=True):
            ids = [np.array(x, np.int32) for x in ids]
            starts = [np.flatnonzero(s.begins[x]) for s, x in zip((self.a, self.b), ids, strict=True)]
            if all(len(at) == len(line) and s.text(x) == b" " + text.encode() for s, x, at in zip((self.a, self.b), ids, starts, strict=True)):
                order += line
                for k in (0, 1):
                    tokens[k].append(ids[k])
                    counts[k].append(np.diff(np.append(starts[k], len(ids[k]))))
            else:
                alone += line
        for c, *ids in zip(alone, self.a.encode(alone), self.b.encode(alone), strict=True):
            if all(s.text(x) == b" " + c.encode() for s, x in zip((self.a, self.b), ids, strict=True)):
                order.append(c)
                for k in (0, 1):
                    tokens[k].append(np.array(ids[k], np.int32))
                    counts[k].append([len(ids[k])])
            else:
                bad.append(c)
        known = len(self.table)
        self.table.update(zip(order + bad, range(known, known + len(order) + len(bad)), strict=True))
        if order:
            borders = [np.concatenate([[0], np.cumsum(np.concatenate(x))]).astype(np.int64) for x in counts]
            rows, groups, pairs = self.align(*(np.concatenate(x) for x in tokens), *borders)
            self.first = np.concatenate([self.first, len(self.pairs) + np.cumsum(rows[:, 3]) - rows[:, 3], np.zeros(len(bad), np.int64)])
            self.counts = np.concatenate([self.counts, rows, np.zeros((len(bad), 4), np.int64)])
            self.pairs = np.concatenate([self.pairs, pairs])
            self.texts += groups + [""] * len(bad)
        else:
            self.first, self.counts = np.append(self.first, np.zeros(len(bad), np.int64)), np.concatenate([self.counts, np.zeros((len(bad), 4), np.int64)])
            self.texts += [""] * len(bad)
        self.good = np.concatenate([self.good, np.ones(len(order), bool), np.zeros(len(bad), bool)])

    def put_together(self, found: list[str]) -> tuple[np.ndarray, str, np.ndarray] | None:
        """Counts, groups and links of neighbouring chunks that are known; None if one of them does not give back its bytes."""
        at = np.fromiter(map(self.table.__getitem__, found), np.int64, len(found))
        if not self.good[at].all():
            return None
        sizes = self.counts[at, 3]
        places = np.repeat(self.first[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return self.counts[at].sum(0), ";".join(map(self.texts.__getitem__, at.tolist())), self.pairs[places]

    def whole(self, text: str) -> tuple[np.ndarray, str, np.ndarray] | None:
        """The same of a text that is encoded as a whole; None if its bytes are not given back."""
        ids = [np.array(s.encode([text])[0], np.int32) for s in (self.a, self.b)]
        if any(s.text(x.tolist()) != b" " + text.encode() for s, x in zip((self.a, self.b), ids, strict=True)):
            return None
        counts, groups, pairs = self.align(*ids, *(np.array([0, len(x)]) for x in ids))
        return counts[0], groups[0], pairs


def _results(aligner: Aligner, texts: Iterable[str]) -> Iterator[tuple[int, np.ndarray, str, np.ndarray]]:
    """Characters, counts, groups and links of every text, worked out for some WORK characters at a time."""
    none = (np.zeros(4, np.int64), "", np.zeros(0, np.int64))
    waiting: list[tuple[str, int, list[str]]] = []  # text, whether it ends here, chunks
    done: list[tuple | None] = []  # of the pieces of a text that is not at its end
    held = 0

    def worked() -> Iterator[tuple[int, np.ndarray, str, np.ndarray]]:
        aligner.learn([c for _, _, found in waiting for c in found])
        for text, ends, found in waiting:
            done.append(aligner.put_together(found) if found else none)
            if ends:
                parts = [aligner.whole(text) or none] if any(p is None for p in done) else list(done)
                yield len(text), sum(p[0] for p in parts), ";".join(p[1] for p in parts), np.concatenate([p[2] for p in parts])
                done.clear()
        waiting.clear()

    for text in texts:
        found = list(pieces(text, WORK)) if len(text) > WORK else [chunks(text) if text else []]
        for i, piece in enumerate(found):
            waiting.append((text, i == len(found) - 1, piece))
            held += min(len(text), WORK)
            if held >= WORK:
                yield from worked()
                held = 0
    if waiting:
        yield from worked()


def align(docs: DataFrame, models: tuple[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text", links: str = "ends") -> DataFrame:
    """id_col, n_a, n_b, n_groups, groups (a1,a2|b1;a3|b2,b3: ids of either side), links (places in the block's pairs), block,
    and in a block's first row pairs (A id * 2^32 + B id) and pair_counts."""
    if id_col in RESULT:
        raise ValueError(f"{id_col!r} is a column of the result")
    if links not in LINKS:
        raise ValueError(f"links is one of {', '.join(LINKS)}")
    path_a, path_b = models or default_models()
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(ids: list[pa.Array], found: list[tuple], block: int) -> pa.RecordBatch:
        pairs, codes, counts = np.unique(np.concatenate([f[3] for f in found]), return_inverse=True, return_counts=True)
        sizes = np.concatenate([[0], np.cumsum([len(f[3]) for f in found])]).astype(np.int32)
        first = lambda values: pa.array([values] + [None] * (len(found) - 1), pa.list_(pa.int64()))
        columns = [*(pa.array([int(f[1][k]) for f in found], pa.int64()) for k in range(3)), pa.array([f[2] for f in found], pa.string())]
        columns += [pa.ListArray.from_arrays(pa.array(sizes), pa.array(codes.astype(np.int32))), first(pairs), first(counts), pa.array(np.full(len(found), block))]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *columns], [id_col, *RESULT])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_level(path_a), sentence_piece(path_b), links)
        block, held, ids, found, chars = TaskContext.get().partitionId() << 33, [], [], [], 0

        def texts() -> Iterator[str]:
            for batch in batches:
                held.extend(batch.column(0).slice(i, 1) for i in range(batch.num_rows))
                yield from (t or "" for t in batch.column(1).to_pylist())

        for result in _results(aligner, texts()):
            ids.append(held.pop(0))
            found.append(result)
            chars += result[0]
            if chars >= BLOCK:
                yield rows(ids, found, block)
                block, ids, found, chars = block + 1, [], [], 0
        if found:
            yield rows(ids, found, block)

    schema = f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, groups string, links array<int>, pairs array<bigint>, pair_counts array<bigint>, block long"
    return docs.select(id_col, text_col).mapInArrow(task, schema)


def weigh(aligned: DataFrame) -> DataFrame:
    """What align() gives, with n_links, n_best (links whose pair is the most frequent of its B id) and count_sum (of the pairs' counts in the corpus)
    in place of links, pairs, pair_counts and block. Other columns stay."""
    aligned = cut(aligned)
    pairs = aligned.where("pairs IS NOT NULL").select(F.col("block").alias("of"), F.posexplode(F.arrays_zip("pairs", "pair_counts")).alias("code", "p"))
    pairs = pairs.select("of", "code", F.col("p.pairs").alias("pair"), F.col("p.pair_counts").alias("n"))
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND((1 << 32) - 1))
    weights = counts.withColumn("best", F.col("count") == F.max("count").over(of_b))
    known = pairs.join(weights, "pair").select("of", "code", "count", "best")
    docs = aligned.drop("pairs", "pair_counts")
    kept = [f for f in docs.schema.fields if f.name not in ("block", "links")]

    def summed(docs: pa.Table, known: pa.Table) -> pa.Table:
        count, best = np.zeros(known.num_rows, np.int64), np.zeros(known.num_rows, np.int64)
        at = known["code"].to_numpy()
        count[at], best[at] = known["count"].to_numpy(), known["best"].to_numpy()
        links = docs["links"].combine_chunks()
        sizes, code = links.value_lengths().to_numpy(), links.flatten().to_numpy()
        edges = np.concatenate([[0], np.cumsum(sizes)])
        total = lambda of: pa.array(np.diff(np.concatenate([[0], np.cumsum(of[code])])[edges]))
        out = docs.select([f.name for f in kept])
        for name, column in (("n_links", pa.array(sizes.astype(np.int64))), ("n_best", total(best)), ("count_sum", total(count))):
            out = out.append_column(name, column)
        return out

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["n_links long, n_best long, count_sum long"])
    return docs.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(summed, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    found = weigh(aligned.withColumn("groups_sha256", digest).drop("groups"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

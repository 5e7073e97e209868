"""Operator 1: quality rules with a linear-chain conditional random field over lines.

Every line of a text gets the label content or boilerplate by Viterbi decoding; the share of a document's
words that stand in content lines decides whether it is kept. Counting rules come first.

The field is trained here, by conditional likelihood, on a bounded sample: at most ``train_docs``
documents of each quality label (lowest crc32 of the id first), and of these at most ``train_lines``
lines each, from stretches spread over the whole text. A document's label serves as the label of its lines. One task
trains. Scoring covers every line of every text.

Defined cases: a null or empty text has no words and fails the base rules; whitespace alone likewise; ties
between the labels go to content; repeated rows each give a row; with no labels, or labels of one class
only, all lines count as content; an empty table gives no rows; other columns are not read, whatever their names; labels
without an id, or other than 0 and 1, are ignored. With pass_through, columns named like the counts are replaced;
``keep_good`` leaves all as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ledgerloom.llm.common import LETTER, SPACE, Rolling, mix, runs, text_chunks

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_CONTENT_PERCENT = 50
FEATURES = 12


@dataclass
class Field:
    """Weights of the chain: state 1 is content, state 0 boilerplate."""

    weights: np.ndarray  # FEATURES x 2
    moves: np.ndarray  # 2 x 2, from and to


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key is found twice or more."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


@dataclass
class Counted:
    words: np.ndarray
    word_chars: np.ndarray
    symbols: np.ndarray
    dup_lines: np.ndarray
    repeat_words: np.ndarray
    line_docs: np.ndarray
    line_words: np.ndarray
    line_features: np.ndarray


def count(data: np.ndarray, offsets: np.ndarray, *, lines_too: bool = True) -> Counted:
    """The base counts of each document and the features of each line, for one chunk of texts."""
    n = len(offsets) - 1
    space = SPACE[data]
    starts, ends, docs = runs(~space, offsets)

    def summed(flags: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(flags)])

    point = summed(~space & ((data & 0xC0) != 0x80))
    symbol = summed(SYMBOL[data])
    rolling = Rolling(data)
    hashes = rolling.of(starts, ends)
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    covered = np.zeros(len(starts) + 1, np.int64)
    if len(starts) >= 3:
        at = np.flatnonzero(docs[:-2] == docs[2:])
        three = mix(mix(mix(hashes[at]) + hashes[at + 1]) + hashes[at + 2]) + salt[docs[at]]
        at = at[repeated(three)]
        np.add.at(covered, at, 1)
        covered[: len(starts)] -= np.bincount(at + 3, minlength=len(starts) + 1)[: len(starts)]
    covered = np.cumsum(covered[: len(starts)]) > 0

    breaks = np.flatnonzero(data == 10)
    line_docs = np.concatenate([np.searchsorted(offsets, breaks, "right") - 1, np.arange(n)])
    line_ends = np.concatenate([breaks, offsets[1:]])
    order = np.lexsort((line_ends, line_docs))
    line_docs, line_ends = line_docs[order], line_ends[order]
    first = np.concatenate([[True], line_docs[1:] != line_docs[:-1]]) if n else np.zeros(0, bool)
    line_starts = np.where(first, offsets[line_docs], np.concatenate([[0], line_ends[:-1] + 1]) if n else 0)
    line_words = np.searchsorted(starts, line_ends) - np.searchsorted(starts, line_starts)
    line_keys = mix(rolling.of(line_starts, line_ends)) + salt[line_docs]
    worded = line_words > 0
    unique = np.unique(np.stack([line_docs[worded].astype(np.uint64), line_keys[worded]]), axis=1) if worded.any() else np.zeros((2, 0), np.uint64)
    dup_lines = np.bincount(line_docs[worded], minlength=n) - np.bincount(unique[0].astype(np.int64), minlength=n)

    features = np.zeros((0, FEATURES))
    if lines_too:
        size = np.maximum(line_ends - line_starts, 1)
        share = lambda sums: (sums[line_ends] - sums[line_starts]) / size
        word_tail = np.zeros(len(data), bool)
        word_tail[ends - 1] = True
        tails = summed(word_tail & SYMBOL[data])
        shouts = summed(word_tail & (data == ord("!")))
        some = np.maximum(line_words, 1)
        last = data[np.maximum(line_ends - 1, 0)] if len(data) else np.zeros(len(line_ends), np.uint8)
        twin = np.zeros(len(line_docs), bool)
        twin[worded] = repeated(line_keys[worded])
        features = np.stack(
            [
                np.ones(len(size)),
                np.minimum(line_words, 40) / 40,
                share(symbol),
                share(summed(UPPER[data])),
                share(summed(DIGIT[data])),
                share(summed(LETTER[data])),
                (tails[line_ends] - tails[line_starts]) / some,
                (shouts[line_ends] - shouts[line_starts]) / some,
                share(summed(data == ord("|"))),
                np.isin(last, [ord(c) for c in ".!?"]).astype(float),
                twin.astype(float),
                np.minimum((point[line_ends] - point[line_starts]) / some, 20) / 20,
            ],
            axis=1,
        )
    return Counted(
        np.bincount(docs, minlength=n),
        point[offsets[1:]] - point[offsets[:-1]],
        symbol[offsets[1:]] - symbol[offsets[:-1]],
        dup_lines,
        np.bincount(docs[covered], minlength=n),
        line_docs,
        line_words,
        features,
    )


@dataclass
class Batch:
    """Line sequences of about the same length, padded to the longest."""

    x: np.ndarray  # sequence, line, feature
    there: np.ndarray  # sequence, line
    label: np.ndarray
    weight: np.ndarray  # of each line of a sequence


def batches_of(sequences: list[np.ndarray], labels: np.ndarray, shares: np.ndarray) -> list[Batch]:
    """Both classes weigh the same, and each sequence its share, however many lines it has."""
    sums = np.bincount(labels, shares, minlength=2)
    lengths = np.array([len(s) for s in sequences])
    out = []
    for size in np.unique(np.ceil(np.log2(lengths))):
        at = np.flatnonzero(np.ceil(np.log2(lengths)) == size)
        x, there = np.zeros((len(at), lengths[at].max(), FEATURES)), np.zeros((len(at), lengths[at].max()), bool)
        for k, s in enumerate(at):
            x[k, : lengths[s]] = sequences[s]
            there[k, : lengths[s]] = True
        out.append(Batch(x, there, labels[at], 0.5 * shares[at] / sums[labels[at]] / lengths[at]))
    return out


def likelihood(theta: np.ndarray, b: Batch) -> tuple[float, np.ndarray]:
    """The weighted conditional log-likelihood of a batch and its gradient, by forward-backward sums."""
    count_, length = b.there.shape
    w, moves = theta[:-4].reshape(FEATURES, 2), theta[-4:].reshape(2, 2)
    node = b.x @ w
    forward = np.zeros((count_, length, 2))
    forward[:, 0] = node[:, 0]
    for t in range(1, length):
        up = np.logaddexp(forward[:, t - 1, 0, None] + moves[0], forward[:, t - 1, 1, None] + moves[1])
        forward[:, t] = np.where(b.there[:, t, None], up + node[:, t], forward[:, t - 1])
    total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    backward = np.zeros((count_, length, 2))
    for t in range(length - 2, -1, -1):
        on = node[:, t + 1] + backward[:, t + 1]
        down = np.logaddexp(moves[:, 0] + on[:, 0, None], moves[:, 1] + on[:, 1, None])
        backward[:, t] = np.where(b.there[:, t + 1, None], down, 0)
    marginal = np.exp(forward + backward - total[:, None, None]) * b.there[:, :, None]
    target = np.eye(2)[b.label][:, None, :] * b.there[:, :, None]
    of_nodes = np.einsum("n,ntf,nts->fs", b.weight, b.x, target - marginal)
    pair = np.exp(forward[:, :-1, :, None] + moves[None, None] + (node + backward)[:, 1:, None, :] - total[:, None, None, None]) * b.there[:, 1:, None, None]
    of_moves = -np.einsum("n,ntab->ab", b.weight, pair)
    steps = b.there[:, 1:].sum(1)
    for c in (0, 1):
        of_moves[c, c] += (b.weight * steps)[b.label == c].sum()
    own = (node * target).sum((1, 2)) + steps * moves[b.label, b.label]
    return float((b.weight * (own - total)).sum()), np.concatenate([of_nodes.ravel(), of_moves.ravel()])


def train(sequences: list[np.ndarray], labels: np.ndarray, shares: np.ndarray | None = None, *, rounds: int = 150, rate: float = 0.1, l2: float = 1e-3) -> Field | None:
    """Maximises the conditional likelihood of all sequences, each of one line or more and with a label of 0 or 1."""
    if not len(labels) or labels.min() == labels.max():
        return None
    parts = batches_of(sequences, labels, np.ones(len(labels)) if shares is None else shares)
    theta = np.zeros(FEATURES * 2 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        g = sum(likelihood(theta, b)[1] for b in parts) - l2 * theta
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(theta[:-4].reshape(FEATURES, 2), theta[-4:].reshape(2, 2))


def viterbi(node: list[list[float]], moves: list[list[float]]) -> list[int]:
    """The likeliest labels of one document's lines; a tie goes to content."""
    (a00, a01), (a10, a11) = moves
    s0, s1 = node[0]
    back = []
    for n0, n1 in node[1:]:
        from0, to1 = s1 + a10 >= s0 + a00, s1 + a11 >= s0 + a01
        back.append((from0, to1))
        s0, s1 = n0 + (s1 + a10 if from0 else s0 + a00), n1 + (s1 + a11 if to1 else s0 + a01)
    state = int(s1 >= s0)
    labels = [state]
    for step in reversed(back):
        state = int(step[state])
        labels.append(state)
    return labels[::-1]


def content_words(counted: Counted, field: Field | None, n: int) -> np.ndarray:
    if field is None:
        return counted.words
    nodes = (counted.line_features @ field.weights).tolist()
    moves = field.moves.tolist()
    borders = np.searchsorted(counted.line_docs, np.arange(n + 1)).tolist()
    labels = [x for a, b in zip(borders, borders[1:]) for x in viterbi(nodes[a:b], moves)]  # noqa: B905
    return np.bincount(counted.line_docs, counted.line_words * np.array(labels), minlength=n).astype(np.int64)


def stretches(n: int, most: int) -> list[tuple[int, int]]:
    """Lines of a text of n lines to train on: all, or four stretches of most / 4 lines, spread from its first to its last line."""
    if n <= most:
        return [(0, n)]
    size = max(1, most // 4)
    return [(k * (n - size) // 3, k * (n - size) // 3 + size) for k in range(4)]


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = 2000, train_lines: int = 64) -> Field | None:
    """The field, trained in one task on the bounded sample."""
    picked = [labels.where(F.col(label_col) == c).select(F.col(id_col).alias("id"), F.lit(c).alias("label")).distinct().orderBy(F.crc32(F.col("id").cast("string")), "id").limit(train_docs) for c in (0, 1)]
    sample = picked[0].union(picked[1])  # at most 2 * train_docs rows, so it may be broadcast

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(1)):
                counted = count(data, offsets)
                borders = np.searchsorted(counted.line_docs, np.arange(last - first + 1))
                rows = []
                for label, a, b in zip(batch.column(0).slice(first, last - first).to_pylist(), borders, borders[1:]):  # noqa: B905
                    of_doc = stretches(int(b - a), train_lines)
                    rows += [(label, 1 / len(of_doc), counted.line_features[a + x : a + y].astype(np.float32).tobytes()) for x, y in of_doc]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.float64(), pa.binary()), strict=True)], ["label", "share", "features"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        field = train([np.frombuffer(x, np.float32).reshape(-1, FEATURES).astype(float) for *_, x in rows], np.array([r[0] for r in rows], int), np.array([r[1] for r in rows]))
        if field is not None:
            yield pa.RecordBatch.from_arrays([pa.array([field.weights.tobytes()], pa.binary()), pa.array([field.moves.tobytes()], pa.binary())], ["weights", "moves"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("label", "text")
    found = rows.mapInArrow(described, "label int, share double, features binary").repartition(1).mapInArrow(learn, "weights binary, moves binary").first()
    return Field(np.frombuffer(found[0]).reshape(FEATURES, 2), np.frombuffer(found[1]).reshape(2, 2)) if found else None


def quality_rules(docs: DataFrame, field: Field | None, *, id_col: str = "doc_id", text_col: str = "text", min_content_percent: int = MIN_CONTENT_PERCENT, pass_through: bool = False) -> DataFrame:
    """id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_content_words, base_failed, kept.

    With pass_through, all columns of docs come before these (without those named like them), so no join is needed.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_content_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(1)):
                c = count(data, offsets, lines_too=field is not None)
                content = content_words(c, field, last - first)
                failed = (c.words < MIN_WORDS) | (100 * c.repeat_words > MAX_REPEAT_PERCENT * c.words)
                kept = ~failed & (100 * content >= min_content_percent * c.words)
                columns = [pa.array(a.astype(np.int64)) for a in (c.words, c.word_chars, c.symbols, c.dup_lines, c.repeat_words, content)]
                same = [batch.column(k).slice(first, last - first) for k in carried]
                yield pa.RecordBatch.from_arrays([*same, *columns, pa.array(failed), pa.array(kept)], schema.names)

    added = [StructField(n, LongType()) for n in names] + [StructField(n, BooleanType()) for n in ("base_failed", "kept")]
    rest = [c for c in docs.columns if c not in (text_col, id_col, *(f.name for f in added))]
    source = docs.select(id_col, text_col, *rest) if pass_through else docs.select(id_col, text_col)
    carried = range(len(source.columns)) if pass_through else [0]
    schema = StructType([source.schema[k] for k in carried] + added)
    return source.mapInArrow(run, schema)


def keep_good(docs: DataFrame, field: Field | None, *, id_col: str = "doc_id", text_col: str = "text", min_content_percent: int = MIN_CONTENT_PERCENT) -> DataFrame:
    """The rows of docs that are kept, with all columns as they are, whatever their names."""
    inner = [f"c{k}" for k in range(len(docs.columns))]
    named = dict(zip(docs.columns, inner, strict=True))
    found = quality_rules(docs.toDF(*inner), field, id_col=named[id_col], text_col=named[text_col], min_content_percent=min_content_percent, pass_through=True)
    return found.where("kept").select(*[F.col(i).alias(c) for c, i in named.items()])

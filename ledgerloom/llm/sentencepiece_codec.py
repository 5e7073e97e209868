"""Operator 5: SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model holds a whitespace marker after another character, so a merge never crosses from
a character that is no marker to a marker. Texts are cut there: a chunk is a run of markers with the run
of other characters after it. Each task keeps a table of the distinct chunks it has met; a batch's new
chunks are segmented by one library call, and the documents' ids are joined back from the table by
position. The table is a task's own: one for all would send every word of the corpus through two shuffles. It is
emptied when it holds ``TABLE_ROWS`` chunks or ``TABLE_CHARS`` characters.

The model's pieces are checked for this property before anything is encoded, and so is, on ``PROBES``, what else the
method takes for granted: one marker before a text, no space removed or added, nothing else rewritten across
chunks, unknown characters of neighbouring chunks kept apart. A model that lacks any of this is refused.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to the empty text; texts
of any length are encoded whole; repeated rows each give a row; an empty table gives no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Chunks kept in a task's table before it is emptied; bounds a worker's memory to some 100 MB.
TABLE_ROWS = 300_000
TABLE_CHARS = 50_000_000
#: Texts on which chunks and the library must agree before a model is used.
PROBES = (
    "", " ", "   ", "a", " a", "a ", "a b", "  a  b  ", "a\tb\nc", "\u2581", "a\u2581b \u2581", "x\u00a0y", "\u3000 \uff21\uff22 c", "e\u0301 \u00e9", "\ufb01n \u2460",
    "\U0001f600 \U0001f600\U0001f601", "\ue000 \ue001 \ue000\ue001", "\x00 \x01", "<s> </s> <unk>", "A1-2,3.4 %$", "\u4e2d\u6587 \u4e2d", "word " * 40, " \u200b \u200d ", "a\u2009b",
)
#: Characters of text between two calls of the library.
BLOCK_CHARS = 1_000_000
#: Distinct chunks that are segmented in one call.
LINE_CHUNKS = 64
MARKER = "▁"
_CHUNKS = re.compile(r" +[^ ]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Encodes and decodes texts with one model; lives in a task."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        crossing = [p for p in map(self.library.id_to_piece, range(self.library.get_piece_size())) if re.search(f"[^{MARKER}]{MARKER}", p)]
        if crossing:
            raise ValueError(f"pieces of this model cross whitespace markers, such as {crossing[0]!r}")
        self.table: dict[str, list[int]] = {}
        self.chars = 0
        self.decimal = [str(i) for i in range(self.library.get_piece_size())].__getitem__
        self.begins = np.array([self.library.id_to_piece(i).startswith(MARKER) for i in range(self.library.get_piece_size())])
        for probe, ids in zip(PROBES, self.encode(list(PROBES)), strict=True):
            if ids != self.library.encode(probe):
                raise ValueError(f"this model does not encode {probe!r} chunk by chunk")

    def chunks(self, text: str) -> list[str]:
        """The chunks, each without its first marker: the library puts one before a text, unless that is empty."""
        text = text.replace(MARKER, " ")
        if "  " not in text and not text.startswith(" ") and not text.endswith(" "):
            return text.split(" ") if text else []
        return [c[1:] for c in _CHUNKS.findall(" " + text)]

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.table]
        self.chars += sum(map(len, new))
        if len(self.table) + len(new) > TABLE_ROWS or self.chars > TABLE_CHARS:
            self.table.clear()
            new = list(chunks)
            self.chars = sum(map(len, new))
        # Chunks of one marker are segmented many to a call, and cut where a piece begins with the marker.
        plain = [c for c in new if c and " " not in c]
        lines = [plain[i : i + LINE_CHUNKS] for i in range(0, len(plain), LINE_CHUNKS)]
        for line, ids in zip(lines, self.library.encode([" ".join(x) for x in lines], num_threads=1), strict=True):
            cuts = [*np.flatnonzero(self.begins[ids]).tolist(), len(ids)]
            self.table.update((c, ids[a:b]) for c, a, b in zip(line, cuts[:-1], cuts[1:], strict=True))
        rest = [c for c in new if " " in c]
        self.table.update(zip(rest, self.library.encode(rest, num_threads=1), strict=True))
        if "" in chunks:
            self.table[""] = [self.library.piece_to_id(MARKER)]

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        cut = [self.chunks(t) for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        for chunks in cut:
            yield list(chain.from_iterable(map(self.table.__getitem__, chunks)))


def blocks(texts: list[str]) -> Iterator[list[str]]:
    block: list[str] = []
    held = 0
    for t in texts:
        block.append(t)
        held += len(t)
        if held >= BLOCK_CHARS:
            yield block
            block, held = [], 0
    if block:
        yield block


def encode_decode(docs: DataFrame, model: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", keep_output: bool = False) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256; with keep_output also ids and decoded."""
    model = model or default_model()
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        gc.disable()  # the table's many small lists hold no cycles
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            first = 0
            for block in blocks(texts):
                rows = []
                for ids in codec.encode(block):
                    decoded = codec.library.decode(ids) if ids else ""
                    joined = ",".join(map(codec.decimal, ids))
                    row = (len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                    rows.append(row + ((ids, decoded) if keep_output else ()))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]
                names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(block)), *columns], [id_col, *names])
                first += len(block)

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_output
    return docs.select(id_col, text_col).mapInArrow(run, schema)

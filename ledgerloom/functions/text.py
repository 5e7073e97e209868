"""Text: accents, lines, vendor keys, titles, hashes."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.fixed import LEGAL_SUFFIXES

#: Letters with accents stand in these blocks; each decomposes to one letter and marks, or is left alone.
_BLOCKS = [range(0x00C0, 0x0250), range(0x0370, 0x0530), range(0x1E00, 0x2000)]
_COMPATIBLE = [range(0x00A0, 0x0250), range(0x0370, 0x0530), range(0x1E00, 0x2150), range(0xFF01, 0xFF5F)]


def _fold_table(form: str, blocks: list[range]) -> tuple[str, str]:
    found = []
    for c in (chr(k) for block in blocks for k in block):
        bare = "".join(x for x in unicodedata.normalize(form, c) if not unicodedata.combining(x))
        if len(bare) == 1 and bare != c:
            found.append((c, bare))
    return "".join(c for c, _ in found), "".join(b for _, b in found)


_NFD = _fold_table("NFD", _BLOCKS)
_NFKD = _fold_table("NFKD", _COMPATIBLE)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, where use names it many times or in a lambda of its own."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def constant(table: dict[str, str], key: str, value: str) -> Column:
    """A fixed table as an array of structs of two texts, in its order: one expression to read, however long it is."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("array(" + ", ".join(f"struct({quoted(k)} AS {key}, {quoted(v)} AS {value})" for k, v in table.items()) + ")")


def bare(word: str) -> str:
    """A word of a fixed table without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def has(text: Column, pattern: str) -> Column:
    """Whether the pattern is found in text under (?iU). In ASCII these flags only cost time: letters have no other forms there, and classes hold the same characters."""
    return F.when(is_ascii(text), text.rlike("(?i)" + pattern)).otherwise(text.rlike("(?iU)" + pattern))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(text, F.lit(w)) for w in words])


def strip_accents(text: Column) -> Column:
    # Most texts are ASCII, where there is nothing to fold.
    return let(text, lambda t: F.when(is_ascii(t), t).otherwise(F.regexp_replace(F.translate(t, *_NFD), r"\p{Mn}+", "")))


#: All white space, with the four separators that count as such.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """text without white space at its ends; only these are looked at."""
    return F.trim(text, F.lit(SPACES))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def clean_lines(text: Column) -> Column:
    """The lines of a text, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")


def title(text: Column) -> Column:
    """Every run of letters capitalised, whatever stands before it."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 20))), "")


def is_upper(text: Column) -> Column:
    return (text == F.upper(text)) & (text != F.lower(text))


def normalize_vendor(name: Column) -> Column:
    """The key by which vendor names are equal: no accents, case, legal suffixes or punctuation."""
    key = F.lower(F.regexp_replace(F.translate(F.coalesce(name, F.lit("")), *_NFKD), r"\p{M}+", ""))
    for suffix in LEGAL_SUFFIXES:
        key = F.regexp_replace(key, rf"(?iU)\b{suffix}\.?\b", "")
    key = F.regexp_replace(key, r"(?U)[^\p{L}\p{N}_\s]", "")
    return strip(F.regexp_replace(key, r"(?U)\s+", " "))


def clean_vendor(vendor: Column) -> Column:
    """A vendor for display: no placeholder, capitals or accents, 200 characters at most."""
    from ledgerloom.functions.fixed import PLACEHOLDER_VENDOR

    cased = lambda x: F.when(is_upper(x) & (F.length(x) > 3), title(x)).otherwise(x)
    shown = lambda name: F.when(~has(name, PLACEHOLDER_VENDOR), F.left(strip_accents(let(F.regexp_replace(name, r"(?U)\s+", " "), cased)), F.lit(200)))
    return F.when(vendor != "", let(strip(vendor), shown))


def safe_title(date: Column, vendor: Column) -> Column:
    """The title a document gets after an edit."""
    name = F.left(strip(F.regexp_replace(F.coalesce(vendor, F.lit("")), r'[<>:"/\\|?*\n\r\t]', "")), F.lit(60))
    some = (F.coalesce(date, F.lit("")) != "") | (F.coalesce(vendor, F.lit("")) != "")
    return F.when(some, F.concat_ws("-", blank_to_null(date), blank_to_null(name), F.lit("Receipt")))


def pipeline_title(date: Column, vendor: Column) -> Column:
    """The title a document gets from the batch: only with both date and vendor."""
    name = F.left(F.regexp_replace(vendor, r'[<>:"/\\|?*]', ""), F.lit(50))
    return F.when((date != "") & (vendor != ""), F.concat(date, F.lit("-"), name, F.lit("-Receipt")))


def document_url(base: str, document_id: Column) -> Column:
    root = base.rstrip("/")
    return F.when(document_id != 0, F.concat(F.lit(f"{root}/documents/"), document_id.cast("string"))) if root else F.lit(None).cast("string")


def content_hash(text: Column) -> Column:
    """SHA-256 of a text; null for none."""
    return F.when(text != "", F.sha2(text, 256))

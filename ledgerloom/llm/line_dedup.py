"""Operator 10: removal of repeated lines by overlapping three-line windows. DataFrame functions only.

Every run of ``window`` consecutive lines is hashed (128 bits, two hashes of 64). Of equal windows anywhere in the table the
first by (id, document, line) stays; the lines that the others cover are merged and removed. The first occurrence of
any line content always stays. Counting is pre-aggregated before the shuffle and the windows' table
carries no text, so a window that a third of the rows share costs no task more than the others.

A document is told by a hash of its id and text (128 bits). Rows that share an id are documents of their own if their texts
differ, ordered by that hash; rows that are the same in both have the same windows, so they count as one document and
all lose the same lines.

Defined cases: a null text stays null with no lines removed; a text of fewer lines than a window stays as
it is (the empty text has one line); a window that overlaps itself keeps its first lines; null ids come after all
others, so their windows are first only where no row with an id has them; an empty table gives no rows; other columns
pass through unchanged, whatever their names, but n_lines and n_removed, which are replaced if counts are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, kept, scratch

WINDOW = 3


def _key(id_col: str, text_col: str) -> F.Column:
    parts = [F.col(id_col).cast("string"), F.col(id_col).isNull(), F.col(text_col)]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def _covered(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """doc (the key of a row) and covered, the sorted positions (from 0) of the lines to remove, for documents that have any."""
    lines = docs.select(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), _key(id_col, text_col).alias("doc"), F.split(F.col(text_col), "\n").alias("lines"))
    both = lambda w: F.struct(F.xxhash64(w).alias("a"), F.xxhash64(F.lit(1), w).alias("b"))
    hashes = F.transform(F.sequence(F.lit(1), F.size("lines") - (window - 1)), lambda i: both(F.slice("lines", i, window)))
    with scratch():
        found = cut(lines.where(F.size("lines") >= window).select("no_id", "id", "doc", F.posexplode(hashes).alias("at", "hash")))
        place, same = F.struct("no_id", "id", "doc", "at"), F.struct("doc", "at")
        of_hash = found.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        twice = of_hash.where("first.doc != last.doc OR first.at != last.at").select("hash", F.col("first.doc").alias("first_doc"), F.col("first.at").alias("first_at"))
        later = found.join(twice, "hash").where(same != F.struct("first_doc", "first_at"))
        spans = F.flatten(F.transform(F.collect_set("at"), lambda p: F.sequence(p, p + (window - 1))))
        covered = later.groupBy("doc").agg(F.array_sort(F.array_distinct(spans)).alias("covered"))
        return kept(cut(covered))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, counts: bool = True) -> DataFrame:
    """docs with the text rewritten, and (with counts) n_lines and n_removed beside it."""
    covered = _covered(docs, id_col, text_col, window).hint("shuffle_hash")
    # The columns of docs travel in a struct, so that no name of theirs can clash with one of ours.
    rows = docs.select(_key(id_col, text_col).alias("doc"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    rows = rows.join(covered, "doc", "left").select("row", "covered", F.split(F.col("row")[text_col], "\n").alias("lines"))
    size = F.size("lines")
    left = F.array_except(F.sequence(F.lit(0), size - 1), F.col("covered"))
    old = F.col("row")[text_col]
    text = F.when(F.col("covered").isNull(), old).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    added = {} if not counts else {"n_lines": F.when(old.isNull(), 0).otherwise(size).cast("long"), "n_removed": F.coalesce(F.size("covered"), F.lit(0)).cast("long")}
    return rows.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns if c not in added], *[c.alias(n) for n, c in added.items()])


SQL = """
WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
placed AS (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM lines),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY l[i], l[i + 1], l[i + 2] ORDER BY doc_id, i) AS rn FROM placed),
covered AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM ranked WHERE rn > 1),
each AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM lines),
kept AS (SELECT e.doc_id, string_agg(CASE WHEN c.i IS NULL THEN line END, chr(10) ORDER BY e.i) AS text, count(*) AS n_lines, count(c.i) AS n_removed
  FROM each e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY e.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM kept
"""

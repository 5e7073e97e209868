"""Operator 4: licence scan by sparse TF-IDF cosine and inheritance from directories. DataFrame functions only.

Three kinds of units are compared by the cosine of their TF-IDF vectors; each distinct unit is compared once:

- every line, with the notices ``TEMPLATES``;
- every block, a run of adjacent comment lines or of adjacent other lines that are not blank, with the headers and
  bodies of ``license_texts``, and with the notices if it has two lines or more;
- the whole text of every licence file, with the same.

A file's own licence is that of its best unit, if the cosine reaches ``min_cosine``. A licence file gives its
licence to its directory, and a file without one of its own takes that of the nearest ancestor directory that
has one.

Only documents are cut into units that have a word without which no text can be reached (see ``_needed``).

Term weights: count in the unit times ln((1 + units) / (1 + units with the term)) + 1. For lines the units that
are counted are the lines that speak of a licence (``MARKER``) and the notices; for blocks and files all blocks,
licence files and texts. A term that none of them has is in 0 units. Units and documents are left out only where
the cosine provably cannot reach ``min_cosine`` (see ``_needed`` and ``_may_reach``).

Defined cases: a null or empty text has no unit; a null path has no directory and inherits nothing;
of units with one score, and of texts with one score, the greater name in alphabetical order counts; texts of any
length are taken whole; rows that share an id share the best of their units, repeated rows each give a row; a null id
has no unit; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from importlib import resources
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, kept, scratch, table

#: Short notices by which these licences are announced.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Use of this source code is governed by a BSD style license. Redistribution and use in source and binary forms are permitted",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, v. 2.0",
    "Proprietary": "All rights reserved",
}
MARKER = "licen[cs]|copyright|rights reserved|spdx|warrant|redistribut|public domain"
#: The same, quicker: a place is passed over by its first letter.
QUICK_MARKER = f"(?=[{''.join(sorted({x[0] for x in MARKER.split('|')}))}])(?:{MARKER})"
WORD = "[a-z0-9]+"
MIN_COSINE = 0.6
#: A line that starts like this is a comment; blocks hold comment lines or other lines, not both.
COMMENT = r"[ \t]*+(?:#|//|/\*|\*|--|;|%|<!--)"
BLOCK = rf"(?md)((?:^{COMMENT}[^\n]*+(?:\n|\z))++|(?:^(?!{COMMENT})[^\n]*\S[^\n]*+(?:\n|\z))++)"
SEVERAL_LINES = r"\A\s*\S[^\n]*\n\s*\S"
#: Words that are no terms of the texts are counted by so many hash buckets at first. Plans hold these tables, so they are short.
BUCKETS = 1 << 13
#: Buckets of the texts' terms in the bounds.
PLACES = 1 << 12
#: Bits of the table of words that are counted exactly, later: 16 for each, but so many at least and at most.
LEAST_BITS, MOST_BITS = 1 << 14, 1 << 22
LICENSE_FILE = r"(^|/)(LICEN[CS]E|COPYING)(\.[a-z]+)?$"


def _terms(line: F.Column) -> F.Column:
    return F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0))


def license_texts() -> list[tuple[str, str]]:
    """(license, text) of the headers and bodies of the standard licences that the package holds."""
    found = sorted((f.name, f.read_text(encoding="utf-8")) for f in resources.files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt"))
    return [(name.rsplit(".", 2)[0], text) for name, text in found]


def _weight(tf, total, df, log):
    return tf * (log((1.0 + total) / (1.0 + df)) + 1.0)


def _bucket(term: F.Column, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _up(value: float) -> float:
    """value or a little more, in few digits."""
    return float(f"{value * 1.0006:.4g}") if value else 0.0


def _constant(values: list, kind: str) -> F.Column:
    return F.from_json(F.lit(json.dumps(values)), kind)


def _frequencies(counted: DataFrame, in_texts: DataFrame) -> tuple[int, dict[str, int], dict[int, int]]:
    """How many units there are, in how many of them each of the texts' terms stands, and by bucket in how many all others stand together, which is as many
    as any of them at least. Words are counted where they are read: a task sends a row for each bucket and term of the texts at most."""
    words = counted.select(F.explode(F.array_append(F.array_distinct(_terms(F.col("unit"))), F.lit(""))).alias("term"))
    mark = words.join(F.broadcast(in_texts.withColumn("known", F.col("term"))), "term", "left")  # the texts' terms, a fixed and small table
    keys = [F.when(F.col("term") == "", "").otherwise(F.col("known")).alias("known"), F.when(F.col("known").isNull() & (F.col("term") != ""), _bucket(F.col("term"), BUCKETS)).alias("bucket")]
    rows = mark.select(*keys).groupBy("known", "bucket").agg(F.count("*").alias("n")).collect()
    by_term = {r.known: r.n for r in rows if r.known is not None}
    return by_term.pop("", 0), by_term, {r.bucket: r.n for r in rows if r.bucket is not None}


class Weighed(NamedTuple):
    """The texts' term weights: how many units there are, texts among them; in how many each of the texts' terms stands, with the texts and without; its idf; the
    weights of each text as (number, license, by term); the least idf by bucket; the place of each term in the bounds."""

    total: int
    df: dict[str, int]
    in_units: dict[str, int]
    idf: dict[str, float]
    weights: list[tuple[int, str, dict[str, float]]]
    low: list[float]
    place_of: dict[str, int]


def weigh(counted: DataFrame, texts: list[tuple[str, str]]) -> Weighed:
    """The weights of the texts' terms among the units of counted (unit)."""
    of_texts = [(k, name, Counter(re.findall(WORD, text.lower()))) for k, (name, text) in enumerate(texts)]
    in_texts = counted.sparkSession.createDataFrame(sorted({(term,) for _, _, tf in of_texts for term in tf}), "term string")
    n_units, of_term, of_bucket = _frequencies(counted, in_texts)
    total = n_units + len(texts)
    df = Counter(of_term) + Counter(term for _, _, tf in of_texts for term in tf)
    idf = {t: _weight(1, total, n, math.log) for t, n in df.items()}
    weights = [(k, name, {term: n * idf[term] for term, n in tf.items()}) for k, name, tf in of_texts]
    where = in_texts.select("term", _bucket(F.col("term"), BUCKETS).alias("bucket"), _bucket(F.col("term"), PLACES).alias("place")).collect()
    low = [_weight(1, total, of_bucket.get(b, 0), math.log) for b in range(BUCKETS)]
    for r in where:
        low[r.bucket] = min(low[r.bucket], idf[r.term])
    return Weighed(total, dict(df), of_term, idf, weights, low, {r.term: r.place for r in where})


def _needed(of: Weighed, usual: dict[str, int], n_usual: int, min_cosine: float) -> set[str]:
    """Words of which a unit has one at least if it reaches min_cosine with a text.

    By Cauchy and Schwarz a cosine is at most the norm of the text's terms that the unit has, over the norm of all. So of each text terms are taken until those
    that are left are too few; first those that give much of the norm and are seldom in the n_usual units that are read, in each of which usual tells how often."""
    found = set()
    too_few = max(0.0, min_cosine - 1e-4) ** 2 * (1 - 1e-9)
    for _, _, w in of.weights:
        norm = left = math.fsum(v * v for v in w.values())
        # A word more is as dear as a thousandth of the units, so that there are not many.
        for t in sorted(w, key=lambda t: ((usual.get(t, 0) + n_usual * 1e-3 + 1) / w[t] ** 2, t)):
            if left <= too_few * norm and too_few:
                break
            found.add(t)
            left -= w[t] ** 2
    return found


def _may_reach(unit: F.Column, weights: list[tuple[int, str, dict[str, float]]], idf: dict[str, float], low: list[float], place_of: dict[str, int], min_cosine: float) -> F.Column:
    """Whether the cosine of a unit with some text may reach min_cosine, by two bounds. Scores are rounded to four digits, so a little less counts.

    Cauchy and Schwarz: a cosine is at most the norm of the text's terms that the unit has, over the norm of all. And it is the dot product over both norms,
    where the unit's norm is bounded at first by its square, which is at least the square of the sum of its words' idf over the count of distinct words, then by its counts. Values are looked up
    by bucket: for a dot product the greatest of the bucket's terms, for an idf the least, so all are bounds on the safe side."""
    norms = [math.fsum(v * v for v in w.values()) for _, _, w in weights]
    shares: list[list[float] | None] = [None] * PLACES
    dots: list[list[float] | None] = [None] * PLACES
    for t in sorted(set().union(*[w for _, _, w in weights])):
        b = place_of[t]
        for table, values in (
            (shares, [w.get(t, 0.0) ** 2 / n for (_, _, w), n in zip(weights, norms, strict=True)]),
            (dots, [idf[t] * w.get(t, 0.0) / math.sqrt(n) for (_, _, w), n in zip(weights, norms, strict=True)]),
        ):
            values = list(map(_up, values))
            table[b] = values if table[b] is None else list(map(max, table[b], values))
    zero = F.array(*[F.lit(0.0)] * len(weights))
    sums = lambda buckets, table: F.aggregate(F.filter(F.transform(buckets, lambda b: F.get(table, b)), lambda x: x.isNotNull()), zero, lambda acc, x: F.zip_with(acc, x, lambda p, q: p + q))
    least, slack = max(0.0, min_cosine - 1e-4), 1 - 1e-9
    of_shares, of_dots, of_low = _constant(shares, "array<array<double>>"), _constant(dots, "array<array<double>>"), _constant([math.floor(x * 100) / 100 for x in low], "array<double>")

    # The same with the greatest value of any text in place of one for each: less sharp and quick, so it comes first.
    greatest = lambda table: _constant([max(x) if x else 0.0 for x in table], "array<double>")
    any_share, any_dot = greatest(shares), greatest(dots)
    total = lambda words, table, n: F.aggregate(words, F.lit(0.0), lambda acc, t: acc + F.get(table, _bucket(t, n)))

    def test(words: F.Column) -> F.Column:
        kinds = F.array_distinct(words)
        places = lambda x: F.transform(x, lambda t: _bucket(t, PLACES))
        norm = total(words, of_low, BUCKETS) / F.sqrt(F.size(kinds))
        quick = (total(words, any_dot, PLACES) >= least * slack * norm) & (total(kinds, any_share, PLACES) >= least**2 * slack)
        # Of the words in order, the k-th of a kind adds k^2 - (k - 1)^2 to the square of its count.
        start = F.struct(F.lit("").alias("word"), F.lit(0).alias("k"), F.lit(0.0).alias("square"))

        def counted(acc: F.Column, t: F.Column) -> F.Column:
            k, idf_of_t = F.when(acc["word"] == t, acc["k"] + 1).otherwise(1), F.get(of_low, _bucket(t, BUCKETS))
            return F.struct(t.alias("word"), k.alias("k"), (acc["square"] + (2 * k - 1) * idf_of_t * idf_of_t).alias("square"))

        sharp = F.sqrt(F.aggregate(F.array_sort(words), start, counted, lambda acc: acc["square"]))
        dot = F.array_max(sums(places(words), of_dots))
        return quick & (dot >= least * slack * norm) & (F.array_max(sums(places(kinds), of_shares)) >= least**2 * slack) & (dot >= least * slack * sharp)

    # An array of one array names the words, so that they are found once. A unit without words has no cosine.
    return F.get(F.transform(F.array(_terms(unit)), lambda words: (F.size(words) > 0) & test(words)), F.lit(0))


def _exact(counted: DataFrame, wanted: DataFrame) -> DataFrame:
    """term and df of the terms of wanted. A table of bits says where words are read which of them can be among these."""
    n, most = LEAST_BITS, 16 * wanted.count()
    while n < min(most, MOST_BITS):
        n *= 2
    place = lambda t: F.pmod(F.xxhash64(t), F.lit(n))
    set_bits = wanted.select((place(F.col("term")) / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(term), {n}) % 64 AS INT))").alias("bit"))
    bits = [0] * (n // 64)
    for r in set_bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        bits[r.word] = r.bits
    held = _constant(bits, "array<bigint>")
    may = lambda t: F.getbit(F.get(held, (place(t) / 64).cast("int")), (place(t) % 64).cast("int")) == 1
    words = counted.select(F.explode(F.filter(F.array_distinct(_terms(F.col("unit"))), may)).alias("term"))
    # wanted is distinct. A semi-join would be moved below the aggregation, to all words.
    return words.groupBy("term").agg(F.count("*").alias("df")).join(wanted, "term")


def best_matches(units: DataFrame, counted: DataFrame, texts: list[tuple[str, str]], min_cosine: float, *, n_notices: int = 0, weighed: Weighed | None = None) -> DataFrame:
    """_id and best (score, license) of units (_id, unit) that reach min_cosine; term weights are from counted (unit) and the texts, and are worked out unless given.
    The first n_notices texts are not compared with units of one line.

    Units that cannot reach min_cosine are dropped where they are read, and words are counted of those that are left. Only these are written and compared."""
    spark = units.sparkSession
    of = weighed or weigh(counted, texts)
    total, df, weights = of.total, of.df, of.weights

    near = units.where(_may_reach(F.col("unit"), weights, of.idf, of.low, of.place_of, min_cosine))
    near = cut(near.select("_id", F.concat(F.md5("unit"), F.when(F.col("unit").rlike(SEVERAL_LINES), "+").otherwise("")).alias("key"), "unit"))
    terms = cut(near.groupBy("key").agg(F.first("unit").alias("unit")).select("key", F.explode(_terms(F.col("unit"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf")))
    known = spark.createDataFrame(sorted(df.items()), "term string, df long")
    others = cut(terms.select("term").distinct().join(F.broadcast(known.select("term")), "term", "left_anti"))
    seen = known if others.isEmpty() else cut(_exact(counted, others).unionByName(known))
    weighted = terms.join(seen, "term", "left").select("key", "term", _weight(F.col("tf"), total, F.coalesce("df", F.lit(0)), F.log).alias("w"))
    norms = weighted.groupBy("key").agg(F.sum(F.col("w") * F.col("w")).alias("norm"))
    rows = [(k, name, math.fsum(v * v for v in w.values()), term, v) for k, name, w in weights for term, v in w.items()]
    by_text = spark.createDataFrame(rows, "k int, license string, t_norm double, term string, v double")
    # The texts' terms are a fixed, small table.
    dots = weighted.join(F.broadcast(by_text), "term").where((F.col("k") >= n_notices) | F.col("key").endswith("+")).groupBy("key", "k", "license", "t_norm").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(norms, "key").select("key", "license", F.round(F.col("dot") / F.sqrt(F.col("norm") * F.col("t_norm")), 4).alias("score"))
    best = scored.where(F.col("score") >= min_cosine).groupBy("key").agg(F.max(F.struct("score", "license")).alias("best"))
    return near.select("_id", "key").join(best, "key").groupBy("_id").agg(F.max("best").alias("best"))


def _lines(files: DataFrame) -> DataFrame:
    """_id and unit of the lines of files (_id, text)."""
    return files.select("_id", F.explode(F.split("text", "\n")).alias("unit")).select("_id", F.trim("unit").alias("unit"))


def _blocks(files: DataFrame) -> DataFrame:
    """_id and unit of the blocks and of the whole licence files of files (_id, path, text)."""
    text = F.when(F.contains("text", F.lit("\r")), F.regexp_replace("text", "\r\n?", "\n")).otherwise(F.col("text"))
    whole = F.when(F.col("path").rlike(LICENSE_FILE), F.array(text)).otherwise(F.array().cast("array<string>"))
    return files.select("_id", F.explode(F.concat(F.regexp_extract_all(text, F.lit(BLOCK), F.lit(1)), whole)).alias("unit"))


def scan(files: DataFrame, *, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: dict[str, str] | None = None, texts: list[tuple[str, str]] | None = None, min_cosine: float = MIN_COSINE) -> DataFrame:
    """id_col, path, own_license, own_score, inherited_license, inherited_from, license."""
    notices = sorted((templates or TEMPLATES).items())
    all_texts = notices + (license_texts() if texts is None else texts)
    named = files.select(F.col(id_col).alias("_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    placed = named.select("_id", "path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("_dir"))
    with scratch():
        # Most texts have no marker, so they are not cut into lines.
        marked = cut(_lines(named.where(F.lower("text").rlike(QUICK_MARKER))).where(F.lower("unit").rlike(QUICK_MARKER)).select("unit"))
        of_lines, of_blocks = weigh(marked, notices), weigh(_blocks(named), all_texts)
        # How usual a word is in any line is told by the blocks; marked lines are none too many and full of the notices' words.
        needed = set().union(*[_needed(of, of_blocks.in_units, of_blocks.total, min_cosine) for of in (of_lines, of_blocks)])
        near = cut(named.where(F.arrays_overlap(_terms(F.col("text")), F.array(*map(F.lit, sorted(needed))).cast("array<string>"))))
        found = best_matches(_lines(near), marked, notices, min_cosine, weighed=of_lines)
        found = found.union(best_matches(_blocks(near), _blocks(named), all_texts, min_cosine, n_notices=len(notices), weighed=of_blocks))
        own = found.groupBy("_id").agg(F.max("best").alias("_own"))
        placed = kept(cut(placed.join(own, "_id", "left")))
    given = placed.where(F.col("path").rlike(LICENSE_FILE) & F.col("_own").isNotNull()).groupBy(F.col("_dir").alias("_from")).agg(F.max("_own").alias("_given"))
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    dirs = placed.where("path IS NOT NULL").select("_dir").distinct().select("_dir", F.posexplode(above).alias("_steps", "_from"))
    near = dirs.join(given, "_from").groupBy("_dir").agg(F.min_by(F.struct("_given", "_from"), "_steps").alias("_near"))
    inherited = F.when(F.col("_own").isNull(), F.col("_near"))
    return placed.join(near, "_dir", "left").select(
        F.col("_id").alias(id_col),
        "path",
        F.col("_own.license").alias("own_license"),
        F.col("_own.score").alias("own_score"),
        inherited["_given"]["license"].alias("inherited_license"),
        inherited["_from"].alias("inherited_from"),
        F.coalesce(F.col("_own.license"), F.col("_near._given.license")).alias("license"),
    )


#: Where the registered query sees a document: short ones stand for the licence files of their directory.
PATH_SQL = "concat(source, '/', CAST(doc_id % 97 AS STRING), '/', CAST(doc_id % 7 AS STRING), '/', CASE WHEN length(text) <= 200 THEN 'LICENSE' ELSE concat(CAST(doc_id AS STRING), '.txt') END)"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs.select("doc_id", "text", F.expr(PATH_SQL).alias("path")))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _scored(p: str, units: str, counted: str, texts: list[tuple[str, str]], n_notices: int) -> str:
    """Tables that end in {p}_best (unit, best) for distinct units (unit, several) of a table; counted (unit) gives the term weights."""
    rows = ", ".join(f"({k}, {_quoted(name)}, {_quoted(text)})" for k, (name, text) in enumerate(texts))
    weight = "tf * (ln((1.0 + total) / (1.0 + coalesce(df, 0))) + 1.0)"
    return f"""
{p}_texts(k, license, text) AS (VALUES {rows}),
{p}_ut AS (SELECT unit, several, term, count(*) AS tf FROM (SELECT unit, several, unnest(regexp_extract_all(lower(unit), '{WORD}')) AS term FROM (SELECT DISTINCT unit, several FROM {units})) GROUP BY ALL),
{p}_nt AS (SELECT k, license, term, count(*) AS tf FROM (SELECT k, license, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM {p}_texts) GROUP BY ALL),
{p}_total AS (SELECT (SELECT count(*) FROM {counted}) + {len(texts)} AS total),
{p}_seen AS (SELECT term, sum(n) AS df FROM (SELECT term, n FROM (SELECT unit, count(*) AS n FROM {counted} GROUP BY unit) JOIN (SELECT DISTINCT unit, term FROM {p}_ut) USING (unit) UNION ALL SELECT term, 1 FROM {p}_nt) GROUP BY term),
{p}_w AS (SELECT unit, several, term, {weight} AS w FROM {p}_ut LEFT JOIN {p}_seen USING (term), {p}_total),
{p}_v AS (SELECT k, license, term, {weight} AS v FROM {p}_nt JOIN {p}_seen USING (term), {p}_total),
{p}_vn AS (SELECT k, sum(v * v) AS t_norm FROM {p}_v GROUP BY k),
{p}_wn AS (SELECT unit, sum(w * w) AS norm FROM {p}_w GROUP BY unit),
{p}_score AS (SELECT unit, k, license, round(sum(w * v) / sqrt(any_value(norm) * any_value(t_norm)), 4) AS score
  FROM {p}_w JOIN {p}_v USING (term) JOIN {p}_vn USING (k) JOIN {p}_wn USING (unit) WHERE k >= {n_notices} OR several GROUP BY unit, k, license),
{p}_best AS (SELECT unit, max(struct_pack(score := score, license := license)) AS best FROM {p}_score WHERE score >= {MIN_COSINE} GROUP BY unit)"""


_NOTICES = sorted(TEMPLATES.items())
SQL = rf"""
WITH files AS (SELECT doc_id, text, {PATH_SQL} AS path FROM documents),
lines AS (SELECT doc_id, trim(line) AS unit, false AS several FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM files)),
marked AS (SELECT unit FROM lines WHERE regexp_matches(lower(unit), '{MARKER}')),
plain AS (SELECT doc_id, path, regexp_replace(text, '\r\n?', chr(10), 'g') AS text FROM files),
parts AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM plain)),
kinds AS (SELECT *, CASE WHEN regexp_matches(line, '^[ \t]*(#|//|/\*|\*|--|;|%|<!--)') THEN 1 WHEN regexp_matches(line, '\S') THEN 2 ELSE 0 END AS kind FROM parts),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, kind ORDER BY i) AS island FROM kinds WHERE kind > 0),
pieces AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS unit FROM islands GROUP BY doc_id, kind, island UNION ALL SELECT doc_id, text FROM plain WHERE regexp_matches(path, '{LICENSE_FILE}') AND text IS NOT NULL),
blocks AS (SELECT doc_id, unit, regexp_matches(unit, '^\s*\S[^\n]*\n\s*\S') AS several FROM pieces),{_scored("line", "lines", "marked", _NOTICES, 0)},{_scored("block", "blocks", "blocks", _NOTICES + license_texts(), len(_NOTICES))},
own AS (SELECT doc_id, max(best) AS own FROM (SELECT doc_id, best FROM lines JOIN line_best USING (unit) UNION ALL SELECT doc_id, best FROM blocks JOIN block_best USING (unit)) GROUP BY doc_id),
placed AS (SELECT doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, own FROM files LEFT JOIN own USING (doc_id)),
given AS (SELECT dir AS given_dir, max(own) AS given FROM placed WHERE regexp_matches(path, '{LICENSE_FILE}') AND own IS NOT NULL GROUP BY dir),
near AS (SELECT dir, arg_max(struct_pack(given := given, given_dir := given_dir), length(given_dir)) AS near
  FROM (SELECT DISTINCT dir FROM placed) JOIN given ON dir = given_dir OR starts_with(dir, given_dir || '/') GROUP BY dir)
SELECT doc_id, path, own.license AS own_license, own.score AS own_score, CASE WHEN own IS NULL THEN near.given.license END AS inherited_license,
  CASE WHEN own IS NULL THEN near.given_dir END AS inherited_from, coalesce(own.license, near.given.license) AS license
FROM placed LEFT JOIN near USING (dir)
"""

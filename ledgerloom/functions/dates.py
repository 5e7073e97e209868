"""Dates: reading one, finding all of a text, and choosing the date of the transaction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.fixed import DATE_CONFIRM, DATE_REJECT, ENGLISH_MONTHS, FRENCH_MONTHS, LATE_DATE_PATTERNS, LATE_DATE_PREFER, LATE_DATE_REJECT, LATE_MONTHS
from ledgerloom.functions.text import constant, has, is_ascii, let, strip, strip_accents

_EARLY_MONTHS = FRENCH_MONTHS | ENGLISH_MONTHS
_MONTH, _FRENCH, _ENGLISH = ("|".join(m) for m in (_EARLY_MONTHS, FRENCH_MONTHS, ENGLISH_MONTHS))
DATE_PATTERNS = [
    r"(?U)\b([0-9]{4}[-/][0-9]{2}[-/][0-9]{2})\b",
    r"(?U)\b([0-9]{1,2}[-/\.][0-9]{1,2}[-/\.][0-9]{4})\b",
    rf"(?iU)\b([0-9]{{1,2}}\s+(?:{_MONTH})\w*\.?\s*,?\s*[0-9]{{4}})\b",
    rf"(?iU)\b((?:{_ENGLISH})\w*\.?\s+[0-9]{{1,2}}\s*,?\s*[0-9]{{4}})\b",
    rf"(?iU)\b((?:le\s+)?[0-9]{{1,2}}\s+(?:{_FRENCH})\w*\.?\s*,?\s*[0-9]{{4}})\b",
]

#: What a line has that holds a date: figures, or the first letters of a month's name (with what Unicode folds to them). It is tested before the patterns, of which each is dearer.
_NAMED = r"(?i)j(?:an|u[iıİln])|f[eéÉ][vb]|ma[riyıİ]|a(?:[vp]r|o[uûÛ]|ug)|[sſ]ep|oct|nov|d[eéÉ]c"
_FIGURES = r"[0-9][-/\.][0-9]{1,2}[-/\.][0-9]"
_MAY_BE_DATED = f"{_NAMED}|{_FIGURES}"
#: Three letters in a row of which the names' first letters in ASCII are some: quick to test.
_LETTERS = "[jJfFmMaAsSoOnNdD][aAuUeEpPvVoOcC][nNlLbBvVrRyYiIuUgGpPtTcC]"


def _named(line: Column) -> Column:
    return F.when(is_ascii(line), line.rlike(_LETTERS) & line.rlike(_NAMED)).otherwise(line.rlike(_NAMED))


def _may_be_dated(line: Column) -> Column:
    """Whether a line has a year and what _MAY_BE_DATED says."""
    return line.rlike("[0-9]{4}") & (line.rlike(_FIGURES) | _named(line))


def _joined(year: Column, month: Column, day: Column) -> Column:
    return F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))


def _numeric(s: Column, pattern: str, parts: tuple[int, int, int]) -> Column:
    return F.when(s.rlike(pattern), _joined(*[F.regexp_extract(s, pattern, k) for k in parts]))


def _either_order(s: Column) -> Column:
    pattern = r"^([0-9]{1,2})[-/\.]([0-9]{1,2})[-/\.]([0-9]{4})$"
    first = F.regexp_extract(s, pattern, 1).try_cast("int") > 12
    return F.when(first, _numeric(s, pattern, (3, 2, 1))).otherwise(_numeric(s, pattern, (3, 1, 2)))


def _written(text: Column, months: dict[str, int]) -> Column:
    return let(text, lambda s: _written_in(s, months))


def _written_in(s: Column, months: dict[str, int]) -> Column:
    """A month's name, the first number of four digits and the first other number up to 31."""
    table = constant({k: f"{v:02d}" for k, v in months.items()}, "name", "month")
    month = F.get(F.filter(table, lambda m: F.contains(s, m["name"])), F.lit(0))["month"]
    numbers = F.regexp_extract_all(s, F.lit("([0-9]+)"), F.lit(1))
    year = F.get(F.filter(numbers, lambda n: F.length(n) == 4), F.lit(0))
    day = F.get(F.filter(numbers, lambda n: (n != year) & n.try_cast("long").between(1, 31)), F.lit(0))
    return F.when(month.isNotNull() & year.isNotNull() & day.isNotNull(), _joined(year, month, day.try_cast("int").cast("string")))


def _real(iso: Column, first_year: int, last_year: Column | int) -> Column:
    in_years = lambda i: let(i.try_cast("date"), lambda day: F.when(day.isNotNull() & F.year(day).between(first_year, last_year), i))
    return let(iso, in_years)


def parse_early(text: Column) -> Column:
    """A date as the first parser reads it: years 2000 to 2035."""
    return let(F.regexp_replace(F.lower(strip(text)), r"(?U)^le\s+", ""), _parsed_early)


def _parsed_early(s: Column) -> Column:
    iso = F.coalesce(F.when(s.rlike(r"^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}$"), F.translate(s, "/", "-")), _either_order(s), _written(s, _EARLY_MONTHS))
    return _real(iso, 2000, 2035)


def parse_late(text: Column, as_of_year: int) -> Column:
    """A date as the post-processor reads it: from 2000 to the end of the year after as_of_year."""
    return let(strip(text), lambda s: _parsed_late(s, as_of_year))


def _parsed_late(s: Column, as_of_year: int) -> Column:
    numeric = [F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), s), _either_order(s), _numeric(s, r"^([0-9]{4})[/\-]([0-9]{2})[/\-]([0-9]{2})$", (1, 2, 3)), _numeric(s, r"^([0-9]{4})([0-9]{2})([0-9]{2})$", (1, 2, 3))]
    written = _written(F.regexp_replace(F.lower(s), r"(?U)^le\s+", ""), LATE_MONTHS)
    return _real(F.coalesce(*numeric, written), 2000, as_of_year + 1)


def _candidates(line: Column, patterns: list[str], parse: Callable[[Column], Column], order: Callable[[Column], list[Column]]) -> Column:
    """Structs (order..., iso) of all dates in a line, for array_max. Matches of all patterns are gathered as structs of k (pattern), i (match) and m (text)
    before any is read, so that the reading stands in the plan once."""

    def matches(k: int, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), lambda m, i: F.struct(F.lit(k).alias("k"), i.alias("i"), m.alias("m")))

    # Without a month's name only figures can be a date. In ASCII the patterns need no Unicode classes.
    plain = [p.replace("(?iU)", "(?i)").replace("(?U)", "") for p in patterns]
    every, quick = (F.concat(*[matches(k, p) for k, p in enumerate(of)]) for of in (patterns, plain))
    figures = F.concat(*[matches(k, p) for k, p in enumerate(plain) if "jan" not in p.lower()])
    found = F.when(~is_ascii(line), every).when(_named(line), quick).otherwise(figures)
    ranked = F.transform(found, lambda x: F.struct(*[c.alias(f"o{n}") for n, c in enumerate(order(x))], parse(x["m"]).alias("iso")))
    return F.filter(ranked, lambda x: x["iso"].isNotNull())


def transaction_date(lines: Column) -> Column:
    """Of the dates on lines that no label rejects: confirmed +10, with a time +5, in the first 40 % +2; ties: line, pattern, match."""

    def of_line(line: Column, at: Column) -> Column:
        dated = let(strip_accents(F.lower(line)), lambda clean: of_clean(line, clean, at))
        return F.when(_may_be_dated(line), dated)

    def of_clean(line: Column, clean: Column, at: Column) -> Column:
        score = F.when(has(clean, DATE_CONFIRM), 10).otherwise(0) + F.when(line.rlike(r"[0-9]{1,2}:[0-9]{2}"), 5).otherwise(0) + F.when(at < F.size(lines) * 0.4, 2).otherwise(0)
        dates = _candidates(line, DATE_PATTERNS, parse_early, lambda x: [score, -at, -x["k"], -x["i"]])
        return F.when(~has(clean, DATE_REJECT), dates)

    return F.array_max(F.flatten(F.array_compact(F.transform(lines, of_line))))["iso"]


def late_date(text: Column, as_of_year: int) -> Column:
    """The post-processor's choice: labels on the line or the one before decide; preferred +5, with a time +3, in the first half +1; ties: the earliest place. Dates do not run over line ends."""

    def of_line(lines: Column, line: Column, at: Column) -> Column:
        context = F.lower(F.concat(F.when(at > 0, F.get(lines, at - 1)).otherwise(""), F.lit(" "), line))
        return F.when(_may_be_dated(line), let(context, lambda c: of_context(lines, line, c, at)))

    def of_context(lines: Column, line: Column, context: Column, at: Column) -> Column:
        score = F.when(has(context, LATE_DATE_PREFER), 5).otherwise(0) + F.when(line.rlike(r"(?U)\b[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?\b"), 3).otherwise(0) + F.when(at < F.size(lines) * 0.5, 1).otherwise(0)
        dates = _candidates(line, [f"(?iU){p}" for p in LATE_DATE_PATTERNS], lambda m: parse_late(m, as_of_year), lambda x: [score, -at, -F.position(x["m"], line), -x["k"]])
        return F.when(~has(context, LATE_DATE_REJECT), dates)

    # The lines are named once: an expression in the lambda would split the text for every line.
    return let(F.split(text, "\n"), lambda lines: F.array_max(F.flatten(F.array_compact(F.transform(lines, lambda line, at: of_line(lines, line, at)))))["iso"])

"""Vendors: by domain, known name, marketplace signs, or the first fitting line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.fixed import BUYER_INLINE, BUYER_LINE, DOMAIN_VENDORS, KNOWN_VENDORS, LATE_DOMAIN_VENDORS, LOGO_VENDORS, MARKETPLACES, NOT_A_VENDOR
from ledgerloom.functions.text import bare, constant, contains_any, has, is_upper, let, strip, strip_accents, title


def first_contained(text: Column, table: dict[str, str], *, strip_keys: bool = False) -> Column:
    """The value of the first key, in the table's order, that text contains."""
    key = bare if strip_keys else str
    first = {}
    for k, v in table.items():
        first.setdefault(key(k), v)
    rows = constant(first, "key", "value")
    # Domains share their few endings, which tell most texts that hold none.
    signs = sorted({k[k.rindex(".") :] if "." in k else k for k in first})

    def pick(t: Column) -> Column:
        found = F.get(F.filter(rows, lambda r: F.contains(t, r["key"])), F.lit(0))["value"]
        return F.when(contains_any(t, signs), found) if 4 * len(signs) < len(first) else found

    return let(text, pick)


def by_domain(text: Column) -> Column:
    return first_contained(F.lower(text), DOMAIN_VENDORS)


def by_late_domain(text: Column) -> Column:
    return first_contained(F.lower(text), dict(sorted(LATE_DOMAIN_VENDORS.items(), key=lambda kv: -len(kv[0]))))


def by_known_name(lines: Column) -> Column:
    top = strip_accents(F.lower(F.array_join(F.slice(lines, 1, 10), " ")))
    return first_contained(top, KNOWN_VENDORS, strip_keys=True)


def by_marketplace(text: Column) -> Column:
    # Every sign of a marketplace holds its name.
    return let(strip_accents(F.lower(text)), lambda clean: F.coalesce(*[F.when(F.contains(clean, F.lit(v.lower())) & clean.rlike("(?U)" + p), F.lit(v)) for p, v in MARKETPLACES]))


def by_first_line(lines: Column) -> Column:
    """The first of eight lines that can be a name. A line after a buyer's label is passed over unread."""

    def judged(line: Column) -> Column:
        """Of a line that may be the name: whether the next is passed over, and the name, if it is one."""
        label, unfit = has(line, BUYER_LINE), (F.length(line) < 3) | line.rlike(r"(?U)^[0-9\s\-\(\)\+\.]+$") | line.rlike(r"(?U)^[0-9]+\s+\w") | has(line, BUYER_INLINE) | has(line, NOT_A_VENDOR)
        named = F.struct(F.lit(False).alias("skip"), F.when(~unfit, F.when(is_upper(line), title(line)).otherwise(line)).alias("found"))
        return F.when(label, F.struct(F.lit(True).alias("skip"), F.lit(None).cast("string").alias("found"))).otherwise(named)

    def step(state: Column, line: Column) -> Column:
        # Lines are folded and judged only until one is taken.
        return F.when(state["found"].isNotNull(), state).when(state["skip"], start).otherwise(let(strip_accents(strip(line)), judged))

    start = F.struct(F.lit(False).alias("skip"), F.lit(None).cast("string").alias("found"))
    return F.aggregate(F.slice(lines, 1, 8), start, step, lambda s: s["found"])


def find_vendor(text: Column, lines: Column) -> Column:
    return F.coalesce(by_domain(text), by_known_name(lines), by_marketplace(text), by_first_line(lines))


def logo_vendor(said: Column) -> Column:
    """What a logo reader said, by the table; else a short answer capitalised; else unknown."""
    raw = strip(said)
    answer = F.lower(F.regexp_replace(F.regexp_replace(raw, '^"+|"+$', ""), "^'+|'+$", ""))
    short = (answer != "") & (answer != "unknown") & (F.length(answer) < 60) & ~F.contains(answer, F.lit("\n"))
    return F.coalesce(first_contained(answer, LOGO_VENDORS), F.when(short, title(raw)), F.lit("unknown"))

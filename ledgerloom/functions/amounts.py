"""Amounts: finding them in lines, labels and priorities, repairs and checks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.fixed import AMOUNT, AMOUNT_AT_END, LABEL_PATTERNS, MATH_ADJUSTABLE, MATH_TOLERANCE, MAX_TAX_RATIO, OCR_LOOKALIKES, PENALTIES, TAXES
from ledgerloom.functions.text import contains_any, is_ascii, let, strip, strip_accents

FIELDS = ["total", "pre_tax", *TAXES]


def parse_amount(line: Column) -> Column:
    """The first amount of a line, else one at its end; a comma may be the decimal point, a sign is dropped."""
    # Each step is worked out once and only where it can give something: a line without a point or comma has no amount, and casts of what is no number are dear.
    def number(flags: str) -> Column:
        found = let(F.regexp_extract(line, f"(?i{flags}){AMOUNT}", 1), lambda x: F.when(x != "", x).otherwise(F.regexp_extract(line, f"(?i{flags}){AMOUNT_AT_END}", 1)))
        return let(found, lambda x: F.when(x != "", F.replace(x, F.lit(","), F.lit(".")).try_cast("double")))

    quick = F.when(line.rlike("[0-9][.,][0-9][0-9]"), number(""))
    return F.when(F.contains(line, F.lit(".")) | F.contains(line, F.lit(",")), F.when(is_ascii(line), quick).otherwise(number("U")))


def first_words(pattern: str) -> list[str]:
    """The letters that a match of a label's pattern begins with: one of these."""
    found = re.match(r"\(([a-z|]+)\)(?![?*{])|([a-z]+)(?![?*{])", pattern)
    return (found[1] or found[2]).split("|")


def priority(clean: Column, field: str) -> Column:
    """The greatest priority of the field's labels found in a clean line; null for none."""
    labels = sorted([(pattern, p) for name, pattern, p in LABEL_PATTERNS if name == field], key=lambda x: -x[1])
    # An ASCII line in lower case needs no flags, and the words that a pattern begins with tell most lines without it.
    quick = F.coalesce(*[F.when(contains_any(clean, first_words(pattern)) & clean.rlike(pattern), F.lit(p)) for pattern, p in labels])
    found = F.coalesce(*[F.when(clean.rlike("(?iU)" + pattern), F.lit(p)) for pattern, p in labels])
    # Most lines have no label of a field, which one test of all its patterns tells.
    return F.when(is_ascii(clean), quick).when(clean.rlike("(?iU)" + "|".join(f"(?:{pattern})" for pattern, _ in labels)), found)


def amount_lines(lines: Column) -> Column:
    """Structs (at, amount, clean) of the lines with an amount above 0."""
    at = F.transform(lines, lambda line, k: F.struct(k.alias("at"), parse_amount(line).alias("amount"), line.alias("line")))
    found = F.filter(at, lambda x: x["amount"] > 0)
    return F.transform(found, lambda x: F.struct(x["at"].alias("at"), x["amount"].alias("amount"), F.lower(strip_accents(F.lower(x["line"]))).alias("clean")))


def ranked_lines(found: Column) -> Column:
    """Structs (at, amount and the priority of each field) of what amount_lines gives."""
    return F.transform(found, lambda x: F.struct(x["at"].alias("at"), x["amount"].alias("amount"), *[priority(x["clean"], f).alias(f) for f in FIELDS]))


def labelled_amounts(ranked: Column) -> Column:
    """Struct of FIELDS: of the lines whose label fits, the one of greatest priority; ties: the lowest for the total, else the top."""

    def best(field: str) -> Column:
        order = (lambda x: x["at"]) if field == "total" else (lambda x: -x["at"])
        fit = F.filter(ranked, lambda x: x[field].isNotNull())
        return F.array_max(F.transform(fit, lambda x: F.struct(x[field].alias("p"), order(x).alias("o"), x["amount"].alias("amount"))))["amount"]

    return F.struct(*[best(f).alias(f) for f in FIELDS])


def drop_impossible_taxes(amounts: Column) -> Column:
    """A tax that reaches the total is not one."""
    total = amounts["total"]
    kept = {t: F.when((total != 0) & (amounts[t] >= total), None).otherwise(amounts[t]) for t in TAXES}
    return F.struct(*[kept.get(f, amounts[f]).alias(f) for f in FIELDS])


def fix_ocr_number(text: Column) -> Column:
    """A number from text with characters that look like digits; of several points the first and last part count."""
    bare = F.regexp_replace(F.translate(F.regexp_replace(text, r"(?U)[$€£¥\s,]", ""), *OCR_LOOKALIKES), r"[^0-9.\-]", "")
    parts = F.split(bare, r"\.")
    joined = F.when(F.size(parts) > 2, F.concat(F.get(parts, F.lit(0)), F.lit("."), F.element_at(parts, -1))).otherwise(bare)
    return F.round(joined.try_cast("double"), 2)


def french_decimals(text: Column) -> Column:
    """20,50 becomes 20.50: of digits, comma and digits only where exactly two follow; what was read is not read again."""
    pieces = F.regexp_extract_all(text, F.lit(r"(\b[0-9]+,[0-9]+\b|(?s:.)(?:(?!\b[0-9]+,[0-9]+\b)(?s:.))*)"), F.lit(1))
    fixed = F.transform(pieces, lambda p: F.when(p.rlike(r"^[0-9]+,[0-9]{2}$"), F.replace(p, F.lit(","), F.lit("."))).otherwise(p))
    return F.array_join(fixed, "")


def to_amount(value: Column) -> Column:
    """A number that is not negative; 0 for anything else."""
    return F.greatest(F.lit(0.0), F.coalesce(value.try_cast("double"), F.lit(0.0)))


def money(value: Column) -> Column:
    return F.format_string("%.2f", value)


def shown(value: Column) -> Column:
    """As a float is shown: without a second decimal 0."""
    return F.regexp_replace(F.format_string("%.2f", value), "0$", "")


def sanitize_taxes(values: dict[str, Column]) -> tuple[dict[str, Column], Column]:
    """values with impossible taxes set to 0.0, and the warnings; null amounts stay null."""
    total, out, warnings = to_amount(values["total"]), dict(values), []
    for t in ("gst", "pst", "hst", "qst"):
        tax = to_amount(values[t])
        checked = (tax > 0) & (total > 0)
        zeroed, capped = checked & (tax >= total), checked & (tax < total) & (tax > MAX_TAX_RATIO * total)
        out[t] = F.when(zeroed | capped, 0.0).otherwise(values[t])
        warnings.append(
            F.when(zeroed, F.concat(F.lit(f"TAX_SANITY_ZEROED:{t}="), money(tax), F.lit("≥total="), money(total))).when(
                capped, F.concat(F.lit(f"TAX_SANITY_CAPPED:{t}="), money(tax), F.lit(">50%_of_"), money(total))
            )
        )
    return out, F.array_compact(F.array(*warnings))


def validate_math(values: dict[str, Column]) -> tuple[dict[str, Column], Column]:
    """values with pre_tax or total corrected or inferred, and the warnings."""
    total, pre = to_amount(values["total"]), to_amount(values["pre_tax"])
    taxes = F.round(sum((to_amount(values[t]) for t in TAXES), F.lit(0.0)), 2)
    gap = F.abs(F.round(pre + taxes, 2) - total)
    both = (total > 0) & (pre > 0)
    adjust, mismatch = both & (gap > MATH_TOLERANCE) & (gap <= MATH_ADJUSTABLE), both & (gap > MATH_ADJUSTABLE)
    rest = F.round(total - taxes, 2)
    infer_pre = (total > 0) & (pre == 0) & (taxes > 0) & (rest > 0) & (rest < total)
    infer_total = (pre > 0) & (total == 0)
    sum_ = F.round(pre + taxes, 2)
    out = dict(values)
    out["pre_tax"] = F.when(adjust | infer_pre, rest).otherwise(values["pre_tax"])
    out["total"] = F.when(infer_total, sum_).otherwise(values["total"])
    warnings = F.array_compact(
        F.array(
            F.when(adjust, F.concat(F.lit("MATH_ADJUSTED_PRETAX:"), shown(pre), F.lit("→"), shown(rest)))
            .when(
                mismatch,
                F.concat(F.lit("MATH_MISMATCH:pre_tax="), shown(pre), F.lit("+tax="), money(taxes), F.lit("≠total="), shown(total), F.lit(" (diff="), money(gap), F.lit(")")),
            )
            .when(infer_pre, F.concat(F.lit("MATH_INFERRED_PRETAX:"), shown(rest)))
            .when(infer_total, F.concat(F.lit("MATH_INFERRED_TOTAL:"), shown(sum_))),
            F.when(to_amount(out["total"]) <= 0, F.lit("MATH_MISSING_TOTAL")),
        )
    )
    return out, warnings


def adjust_confidence(base: Column, warnings: Column, values: dict[str, Column], vendor: Column, date: Column) -> Column:
    """Penalties for warnings and bonuses for what is there, within 0 and 1; pst gives no bonus."""
    penalty = F.lit(0.0)
    of = lambda w: F.coalesce(*[F.when(w.startswith(key), F.lit(p)) for key, p in PENALTIES], penalty)
    lost = F.aggregate(warnings, F.lit(0.0), lambda acc, w: acc + of(w))
    bonus = lambda c: F.when(c, 0.05).otherwise(0.0)
    gained = bonus(vendor != "") + bonus(date != "") + bonus(to_amount(values["total"]) > 0) + bonus(F.greatest(*[to_amount(values[t]) for t in ("gst", "hst", "qst")]) > 0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(base, F.lit(0.5)) - lost + gained)), 3)


def field_value(data_type: Column, value: Column) -> Column:
    """A custom field's value by its type, as text: numbers lose all but digits and points (and so their sign)."""
    number = F.coalesce(F.regexp_replace(value, r"[^0-9.]", "").try_cast("double"), F.lit(0.0))
    return F.when(data_type == "monetary", strip(value)).when(data_type.isin("integer", "float", "number"), number.cast("string")).otherwise(value)

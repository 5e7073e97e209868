"""Substring search over vendors by trigrams: a table of postings says which names can match before any is compared.

Names repeat from receipt to receipt, so postings are kept for distinct names: a row for each three neighbouring characters of the name in lower case, stored
by trigram, so that a search reads the row groups of its own trigrams. A name matches a pattern only if it holds every trigram of the
pattern's literal parts; those that do are compared by ``ilike``, so % and _ keep their meaning and nothing wrong is found. Names that match are
joined with the receipts. A pattern without three literal characters in a row has no trigram: then all names, still not all receipts, are compared.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 3


def _grams(name: Column) -> Column:
    low = F.lower(name)
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - (SIZE - 1)))
    return F.array_distinct(F.filter(F.transform(at, lambda i: F.substr(low, i, F.lit(SIZE))), lambda g: F.length(g) == SIZE))


def names_of(receipts: DataFrame) -> DataFrame:
    """vendor and grams (how many trigrams it has) of the distinct names."""
    return receipts.where("vendor IS NOT NULL").select("vendor").distinct().withColumn("grams", F.size(_grams(F.col("vendor"))))


def postings(receipts: DataFrame) -> DataFrame:
    """trigram and vendor of the distinct names."""
    return receipts.where("vendor IS NOT NULL").select("vendor").distinct().select(F.explode(_grams(F.col("vendor"))).alias("trigram"), "vendor")


def write_postings(receipts: DataFrame, path: str, files: int = 16) -> None:
    """The postings in files that follow one another by trigram."""
    postings(receipts).repartitionByRange(files, "trigram", "vendor").sortWithinPartitions("trigram", "vendor").write.parquet(path)


def trigrams(pattern: str) -> list[str]:
    """Those that every match of the pattern between two % holds. Backslashes take the next character as it is."""
    parts, part = [], ""
    for token in re.findall(r"\\.|.", pattern, re.S):
        if token in ("%", "_"):
            parts.append(part)
            part = ""
        else:
            part += token[-1]
    # Characters whose lower case depends on what stands beside them, or is longer than they are, say nothing.
    plain = [p for whole in [*parts, part] for p in re.split(r"[^\x00-\x7f]+", whole)]
    return sorted({p.lower()[i : i + SIZE] for p in plain for i in range(len(p) - SIZE + 1)})


def matching(post: DataFrame, names: DataFrame, pattern: str) -> DataFrame:
    """vendor: the names that hold the pattern, in any case."""
    wanted = trigrams(pattern)
    if wanted:
        held = post.where(F.col("trigram").isin(wanted)).groupBy("vendor").agg(F.count("*").alias("n"))
        names = held.where(F.col("n") == len(wanted))
    return names.where(F.col("vendor").ilike(f"%{pattern}%")).select("vendor")


def find(receipts: DataFrame, post: DataFrame, names: DataFrame, pattern: str) -> DataFrame:
    """The receipts whose vendor holds the pattern, as with ilike."""
    return receipts.join(matching(post, names, pattern), "vendor", "left_semi")

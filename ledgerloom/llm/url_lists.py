"""Operator 6: URL filters by a temporal join with dated lists. DataFrame functions only.

Dated entries (a domain is added to or removed from the list) become validity intervals. Every capture is
evaluated against the entries of its host and of the host's parent domains that are active when it was
fetched. Captures are first reduced to distinct pairs of host and day, so a host with a third of all
captures brings at most one row a day into the join; the verdicts are joined back by host and day. Domains of one
label, such as com, are above a large share of all hosts, so in the join they are split by ``SALTS``.

Defined cases: a null URL, or one without a host, is listed nowhere; a null fetch day likewise; entries with a
null domain, action or day are ignored; of entries for one domain on one day an addition counts after a
removal; an interval holds from its first day to the day before the removal; repeated captures each give
a row; URLs of any length are taken whole; empty tables give no listing; other columns of either table are not read,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import table

SALTS = 64
FIRST_DAY = "2023-01-01"


def host_of(url: F.Column) -> F.Column:
    """The host in lower case, without user, port or final dot; empty if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", ""))


def intervals(entries: DataFrame) -> DataFrame:
    """domain, valid_from, valid_to (null: still valid) from entries of domain, action (add, remove) and day."""
    known = entries.where("domain IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
    by_day = known.groupBy(F.lower("domain").alias("domain"), "day").agg(F.max(F.col("action") == "add").alias("added"))
    over = Window.partitionBy("domain").orderBy("day")
    changed = by_day.withColumn("before", F.lag("added").over(over)).where(~F.col("before").eqNullSafe(F.col("added")))
    return changed.withColumn("valid_to", F.lead("day").over(over)).where("added").select("domain", F.col("day").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, *, id_col: str, url_col: str = "url", day_col: str = "day") -> DataFrame:
    """id_col, host, day, n_active, listed, list_domain (the longest active) and listed_since."""
    seen = captures.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), F.col(day_col).alias("day"))
    pairs = seen.where("host != '' AND day IS NOT NULL").select("host", "day").distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    above = F.instr("domain", ".") == 0
    valid = intervals(entries).withColumn("salt", F.explode(F.when(above, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    salt = F.when(above, F.pmod(F.xxhash64("host", "day"), F.lit(SALTS)).cast("int")).otherwise(0)
    active = (
        pairs.select("host", "day", F.explode(parents).alias("domain"))
        .withColumn("salt", salt)
        .join(valid, ["domain", "salt"])
        .where("valid_from <= day AND (valid_to IS NULL OR day < valid_to)")
        .groupBy("host", "day")
        .agg(F.count("*").alias("n_active"), F.max(F.struct(F.length("domain").alias("length"), "domain", "valid_from")).alias("best"))
    )
    return seen.join(active, ["host", "day"], "left").select(
        id_col,
        "host",
        "day",
        F.coalesce("n_active", F.lit(0)).alias("n_active"),
        F.col("n_active").isNotNull().alias("listed"),
        F.col("best.domain").alias("list_domain"),
        F.col("best.valid_from").alias("listed_since"),
    )


#: The list of the registered query: its entries are derived from the hosts of ``pages`` by this rule, in either SQL dialect.
ENTRIES_SQL = """
SELECT domain, 'add' AS action, DATE '2023-01-01' + CAST(key % 300 AS INT) AS day FROM keyed WHERE key % 3 < 2
UNION ALL SELECT domain, 'remove', DATE '2023-01-01' + CAST(key % 300 + 100 + key % 50 AS INT) FROM keyed WHERE key % 3 = 0
UNION ALL SELECT domain, 'add', DATE '2023-01-01' + CAST(key % 300 + 250 AS INT) FROM keyed WHERE key % 6 = 0
UNION ALL SELECT 'example.org', 'add', DATE '2024-03-01'
UNION ALL SELECT 'example.org', 'remove', DATE '2024-05-15'
UNION ALL SELECT 'ththth.example.net', 'remove', DATE '2023-02-01'
"""
KEY_SQL = "ascii(host) * 131 + ascii(substr(host, 4, 1)) * 17 + length(host) * 29"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture, fetched on a day derived from its id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(f"date_add(DATE '{FIRST_DAY}', CAST(page_id * 37 % 730 AS INT))").alias("day"))
    keyed = pages.select(host_of(F.col("url")).alias("host")).distinct().where("host != ''").select(F.col("host").alias("domain"), F.expr(KEY_SQL).alias("key"))
    return evaluate(pages, spark.sql(ENTRIES_SQL.replace("keyed", "{keyed}"), keyed=keyed), id_col="page_id")


SQL = f"""
WITH captures AS (SELECT page_id, DATE '{FIRST_DAY}' + CAST(page_id * 37 % 730 AS INT) AS day,
  lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '\\.?(:[0-9]*)?$', '')) AS host FROM pages),
keyed AS (SELECT host AS domain, {KEY_SQL} AS key FROM (SELECT DISTINCT host FROM captures WHERE host != '')),
entries AS ({ENTRIES_SQL}),
by_day AS (SELECT domain, day, max(action = 'add') AS added FROM entries GROUP BY ALL),
changed AS (SELECT * FROM (SELECT *, lag(added) OVER (PARTITION BY domain ORDER BY day) AS before FROM by_day) WHERE before IS DISTINCT FROM added),
valid AS (SELECT * FROM (SELECT domain, added, day AS valid_from, lead(day) OVER (PARTITION BY domain ORDER BY day) AS valid_to FROM changed) WHERE added),
active AS (SELECT page_id, count(*) AS n_active, max(struct_pack(length := length(domain), domain := domain, valid_from := valid_from)) AS best
  FROM captures JOIN valid ON (host = domain OR ends_with(host, '.' || domain)) AND valid_from <= day AND (valid_to IS NULL OR day < valid_to) GROUP BY page_id)
SELECT page_id, host, day, coalesce(n_active, 0) AS n_active, n_active IS NOT NULL AS listed, best.domain AS list_domain, best.valid_from AS listed_since
FROM captures LEFT JOIN active USING (page_id)
"""

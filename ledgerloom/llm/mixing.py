"""Operator 8: mixing sources to target weights by iterative proportional fitting.

Token counts of the cells (source, language, topic) are raked to target marginals: each sweep scales every
value of one dimension so that its cells' weight meets the target, dimension after dimension, until no
ratio changes by ``tolerance`` or more. A cell's ratio is the product of its three factors, ``max_ratio`` at most: within the
bound the sweeps find the weights that meet the targets, and where the bound does not allow that, ``Mixture.missed`` says by how much.

``copies`` draws documents by calibrated probabilities: each comes floor(scale * ratio) times and once more with the probability of the
rest, so the rows meet the targets without weights and hold as many tokens as there were (scale 1), however rare a cell is.
``sample`` draws without copies: all ratios times one factor, by which the greatest is 1; it holds mean over greatest ratio
of all tokens (``sampled_share``). All draw by a number in [0, 1) from the md5 of seed, id and text, so the same document is always decided alike.

The topic is a column of the caller's choice (``topics.topic_of`` gives one); without one, a document's kind of content stands for it (``kind_of``).
``prepare`` works out the cells' columns and the drawn number once; where its result is written, all other steps read these narrow columns only.

Up to ``max_cells`` cells are raked on the driver and their ratios are broadcast, so a hot source is never shuffled. More cells stay a table: they are raked by
aggregations, a sweep at a time, and joined with the documents.

Defined cases: a null source, language or topic counts as the empty value; a null or empty text has no tokens and the
kind none; a value whose cells have no tokens keeps the factor 1; a value without a target is dropped
(ratio 0); repeated rows each count, are decided alike and give a row each; an empty table gives no rows; columns of
docs named like the added ones are replaced, all others pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import topics
from ledgerloom.llm.common import cut, drop

DIMENSIONS = ("source", "lang", "topic")
#: Target shares are natural shares to this power, so that large values give way to small ones.
TEMPER = 0.7
ADDED = ("topic", "n_tokens", "ratio", "probability")
#: No document is repeated more often, so that no rare cell is learnt by heart.
MAX_RATIO = 8.0
MAX_CELLS = 100_000


def kind_of(text: F.Column) -> F.Column:
    """The kind of content of a text, by marks that need no model: none, legal, tabular, contact, numeric or prose."""
    return (
        F.when(text.isNull() | (text == ""), "none")
        .when(text.rlike("[Ll]icensed under|[Rr]ights reserved"), "legal")
        .when(text.contains(" | "), "tabular")
        .when(text.contains("@") | text.contains("://"), "contact")
        .when(text.rlike("[0-9]"), "numeric")
        .otherwise("prose")
    )


@dataclass
class Mixture:
    factors: dict[str, dict[str, float]]  # by dimension and value; empty for a table
    cells: list[tuple[str, str, str, int, float]]  # source, language, topic, tokens and ratio; empty for a table
    sweeps: int
    change: float
    #: By dimension, the share of all tokens that is with other values than wanted.
    missed: dict[str, float] = field(default_factory=dict)
    #: source, lang, topic, n and ratio, if there are more cells than the driver takes.
    table: DataFrame | None = None

    def _sums(self) -> tuple[float, float, float]:
        """The greatest ratio of a cell with tokens, all tokens, and all tokens times their ratio."""
        if self.table is not None:
            found = self.table.where("n > 0").agg(F.max("ratio"), F.sum("n"), F.sum(F.col("n") * F.col("ratio"))).first()
            return found[0] or 1.0, found[1] or 0, found[2] or 0.0
        held = [(n, r) for *_, n, r in self.cells if n]
        return max((r for _, r in held if r), default=1.0), sum(n for n, _ in held), sum(n * r for n, r in held)

    def calibration(self) -> float:
        """The factor to all ratios by which the greatest of a cell with tokens is 1."""
        return 1 / self._sums()[0]

    def sampled_share(self) -> float:
        """The share of all tokens that sample() is expected to take."""
        greatest, total, weighted = self._sums()
        return weighted / greatest / total if total else 0.0


#: The struct with all columns of docs in a prepared table: no name of theirs can clash with one of ours.
ROW = "_mixing_row"


def prepare(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", topic: F.Column | None = None, seed: int = 17) -> DataFrame:
    """docs' rows with their dimensions, tokens (n) and drawn number; what is prepared already stays as it is."""
    if ROW in docs.columns:
        return docs
    text = F.col(text_col)
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    tokens = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    dimensions = [empty(F.col(d)).alias(d) for d in DIMENSIONS[:2]] + [empty(kind_of(text) if topic is None else topic).alias("topic")]
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.xxhash64(text).cast("string"))
    drawn = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias(ROW), *dimensions, tokens.alias("n"), drawn.alias("drawn"))


def with_topics(prepared: DataFrame) -> DataFrame:
    """A prepared table that has the column vector (topics.vector_of) with the topics of a fit to all of it."""
    model = topics.Topics(*topics.centroids_of(prepared.select("vector.*"), topics.TOPICS))
    return prepared.withColumn("topic", topics.topic_at(F.col("vector"), model)).drop("vector")


def _missed(reached: np.ndarray, wanted: np.ndarray) -> float:
    total = wanted.sum()
    return float(np.abs(reached - wanted).sum() / 2 / total) if total else 0.0


def rake(
    docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, *, text_col: str = "text", topic: F.Column | None = None, temper: float = TEMPER, sweeps: int = 200, tolerance: float = 1e-6,
    max_ratio: float = MAX_RATIO, max_cells: int = MAX_CELLS,
) -> Mixture:
    """Fits the factors; targets are shares by dimension and value, tempered natural shares where not given."""
    table = prepare(docs, id_col=docs.columns[0], text_col=text_col, topic=topic).groupBy(*DIMENSIONS).agg(F.sum("n").alias("n"))
    cells = table.limit(max_cells + 1).collect()
    if len(cells) > max_cells:
        return _rake_table(cut(table), targets or {}, temper, sweeps, tolerance, max_ratio)
    cells.sort()
    n = np.array([c.n for c in cells], float)
    values, at, wanted, factors = {}, {}, {}, {}
    for d in DIMENSIONS:
        values[d], at[d] = np.unique(np.array([c[d] for c in cells], dtype=object), return_inverse=True) if cells else (np.array([]), np.zeros(0, int))
        natural = np.bincount(at[d], n, minlength=len(values[d]))
        given = (targets or {}).get(d)
        shares = natural**temper if given is None else np.array([given.get(v, 0.0) for v in values[d]])
        shares = np.where(natural > 0, shares, 0.0)
        wanted[d] = shares / shares.sum() * n.sum() if len(shares) and shares.sum() > 0 else shares
        factors[d] = np.where((wanted[d] > 0) | (natural == 0), 1.0, 0.0)
    ratio = lambda: np.minimum(max_ratio, np.prod([factors[d][at[d]] for d in DIMENSIONS], axis=0)) if cells else np.zeros(0)
    reached = lambda d: np.bincount(at[d], n * ratio(), minlength=len(values[d])).astype(float)
    change, sweep = 0.0, 0
    for sweep in range(1, sweeps + 1):
        before = ratio()
        for d in DIMENSIONS:
            now = reached(d)
            step = np.divide(wanted[d], now, out=np.ones_like(now), where=(now > 0) & (wanted[d] > 0))
            # What the bound keeps from its target is not pressed on for ever.
            factors[d] = np.minimum(factors[d] * step, 1e9)
        some = (n > 0) & (before > 0)
        change = float(np.abs(ratio()[some] / before[some] - 1).max(initial=0.0))
        if change < tolerance:
            break
    found = {d: dict(zip(values[d].tolist(), factors[d].tolist(), strict=True)) for d in DIMENSIONS}
    rows = [(*(c[d] for d in DIMENSIONS), c.n, r) for c, r in zip(cells, ratio().tolist(), strict=True)]
    return Mixture(found, rows, sweep, change, {d: _missed(reached(d), wanted[d]) for d in DIMENSIONS})


def _rake_table(cells: DataFrame, targets: dict[str, dict[str, float]], temper: float, sweeps: int, tolerance: float, max_ratio: float) -> Mixture:
    """The same over a table of cells: each step sums the cells by one dimension and joins the values' steps back."""
    spark, total, wanted = cells.sparkSession, cells.agg(F.sum("n")).first()[0] or 0, {}
    for d in DIMENSIONS:
        shares = cells.groupBy(d).agg(F.sum("n").alias("natural"))
        if d in targets:
            given = spark.createDataFrame(sorted(targets[d].items()), f"{d} string, share double")
            shares = shares.join(given, d, "left").withColumn("share", F.when(F.col("natural") > 0, F.coalesce("share", F.lit(0.0))).otherwise(0.0))
        else:
            shares = shares.withColumn("share", F.pow(F.col("natural").cast("double"), F.lit(temper)))
        shares = cut(shares)
        all_shares = shares.agg(F.sum("share")).first()[0] or 0.0
        wanted[d] = shares.select(d, (F.col("share") * (total / all_shares if all_shares else 0.0)).alias("want"), (F.col("natural") == 0).alias("bare"))
    weight = lambda: F.col("n") * F.least(F.lit(max_ratio), F.col("free"))
    state, last, change, sweep, missed = cells.withColumn("free", F.lit(1.0)), None, 0.0, 0, {}
    for sweep in range(1, sweeps + 1):
        bounded = F.least(F.lit(max_ratio), F.col("free"))
        state = state.withColumn("before", bounded)
        for d in DIMENSIONS:
            now = state.groupBy(d).agg(F.sum(weight()).alias("now")).join(wanted[d], d)
            step = F.when((F.col("now") > 0) & (F.col("want") > 0), F.col("want") / F.col("now")).when((F.col("want") > 0) | F.col("bare"), 1.0).otherwise(0.0)
            state = state.join(now.select(d, step.alias("step")), d).withColumn("free", F.least(F.col("free") * F.col("step"), F.lit(1e9))).drop("step")
        done = cut(state)
        change = done.where("n > 0 AND before > 0").agg(F.max(F.abs(bounded / F.col("before") - 1))).first()[0] or 0.0
        if last is not None:
            drop(last)
        last, state = done, done.drop("before")
        if change < tolerance:
            break
    for d in DIMENSIONS:
        gap = state.groupBy(d).agg(F.sum(weight()).alias("now")).join(wanted[d], d).agg(F.sum(F.abs(F.col("now") - F.col("want"))), F.sum("want")).first()
        missed[d] = float(gap[0] / 2 / gap[1]) if gap[1] else 0.0
    table = state.select(*DIMENSIONS, "n", F.least(F.lit(max_ratio), F.col("free")).alias("ratio"))
    return Mixture({}, [], sweep, change, missed, table)


def _with_ratio(rows: DataFrame, mixture: Mixture) -> DataFrame:
    if mixture.table is not None:
        known = mixture.table.select(*DIMENSIONS, "ratio")
    else:
        known = F.broadcast(rows.sparkSession.createDataFrame([(s, g, t, r) for s, g, t, _, r in mixture.cells], "source string, lang string, topic string, ratio double"))  # max_cells rows at most
    return rows.join(known, list(DIMENSIONS), "left").withColumn("ratio", F.coalesce("ratio", F.lit(0.0)))


def fitting_scale(docs: DataFrame, mixture: Mixture, *, id_col: str = "doc_id", text_col: str = "text", topic: F.Column | None = None) -> float:
    """The factor to all ratios, 1 at most, with which resample gives no more rows than docs has: expected rows and four
    standard deviations (each at most half the root of the count) fit. Shares do not depend on it."""
    n, ratios = _with_ratio(prepare(docs, id_col=id_col, text_col=text_col, topic=topic), mixture).agg(F.count("*"), F.sum("ratio")).first()
    return min(1.0, max(0.0, n - 2 * n**0.5) / ratios) if ratios and n > 4 else 1.0


def _columns(rows: DataFrame) -> list[str]:
    return rows.schema[ROW].dataType.names


def copies(docs: DataFrame, mixture: Mixture, *, scale: float = 1.0, id_col: str = "doc_id", text_col: str = "text", topic: F.Column | None = None, seed: int = 17) -> DataFrame:
    """docs with topic, n_tokens, ratio, probability (of one copy more than the whole ones) and copies."""
    rows = _with_ratio(prepare(docs, id_col=id_col, text_col=text_col, topic=topic, seed=seed), mixture)
    whole = F.floor(F.col("ratio") * scale)
    probability = F.col("ratio") * scale - whole
    kept = [F.col(ROW)[c].alias(c) for c in _columns(rows) if c not in (*ADDED, "copies")]
    return rows.select(*kept, "topic", F.col("n").alias("n_tokens"), "ratio", probability.alias("probability"), (whole + F.when(F.col("drawn") < probability, 1).otherwise(0)).cast("int").alias("copies"))


def resample(docs: DataFrame, mixture: Mixture, *, scale: float = 1.0, id_col: str = "doc_id", text_col: str = "text", topic: F.Column | None = None, seed: int = 17) -> DataFrame:
    """docs' rows, each as often as copies() says."""
    rows = _with_ratio(prepare(docs, id_col=id_col, text_col=text_col, topic=topic, seed=seed), mixture).withColumn("ratio", F.col("ratio") * scale)
    whole = F.floor("ratio")
    drawn = whole + F.when(F.col("drawn") < F.col("ratio") - whole, 1).otherwise(0)
    found = rows.select(ROW, drawn.cast("int").alias("copies")).where("copies > 0")
    return found.select(ROW, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(ROW)[c].alias(c) for c in _columns(rows)])


def sample(docs: DataFrame, mixture: Mixture, *, id_col: str = "doc_id", text_col: str = "text", topic: F.Column | None = None, seed: int = 17) -> DataFrame:
    """docs with topic, n_tokens, ratio, probability (calibrated) and sampled."""
    rows = _with_ratio(prepare(docs, id_col=id_col, text_col=text_col, topic=topic, seed=seed), mixture)
    probability = F.least(F.col("ratio") * mixture.calibration(), F.lit(1.0))
    return rows.select(
        *[F.col(ROW)[c].alias(c) for c in _columns(rows) if c not in (*ADDED, "sampled")],
        "topic",
        F.col("n").alias("n_tokens"),
        "ratio",
        probability.alias("probability"),
        (F.col("drawn") < probability).alias("sampled"),
    )

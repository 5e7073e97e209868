"""Operator 9: exact top-k by inner product with ball trees, branch and bound per shard.

1. Vectors are dealt to clusters around at most ``max_clusters`` of them, drawn by hash; a cluster of more than
   ``shard_rows`` vectors is dealt to several shards, so a third of all rows in one place hurts no task. Each cluster has
   a ball: its centre and the greatest distance from it. These are few, so they are broadcast.
2. A query orders the clusters by the greatest inner product that their ball allows
   (query . centre + |query| * radius) and visits their shards in rounds: the first, the second, the next two, the next
   four and so on. It is sent to a shard only while the bound reaches its kth score so far, which the
   rounds before have found and share.
3. One task holds one shard and one block of the queries that visit it. It builds a ball tree and goes through the leaves
   of each query in the order of their upper bound until that falls below the kth score. What
   leaves the task are scores that reach the shared kth score, k a query at most.

Scores are sums of products of integers below 2**53 and so exact in doubles; a bound is widened by its
rounding error, so equal scores are never cut and ties go to the smaller id.

The queries are a stated set, in blocks; no pair of vectors leaves a task unless it can be among the best. How many
clusters the bounds leave out depends on the data: of random directions in many dimensions hardly any.

Defined cases: vectors that are null or hold a null, NaN or infinite component take no part; vectors meet only
vectors of their own length; an empty vector scores 0 with other empty ones; every row counts, also those that share an
id or a vector, and a query leaves out its own row only; of equal scores and ids either row may come first; fewer
candidates than k give fewer rows; a null id takes no part; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, drop, kept, scratch

LEAF = 128


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    rows: np.ndarray | None
    below: tuple[Node, Node] | None


def build(x: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Node:
    part = x[rows]
    centre = part.mean(0) if part.size else np.zeros(x.shape[1])
    away = np.sqrt(((part - centre) ** 2).sum(1))
    radius = float(away.max())
    if len(rows) <= leaf or radius == 0:
        return Node(centre, radius, rows, None)
    a = part[away.argmax()]
    b = part[((part - a) ** 2).sum(1).argmax()]
    order = np.argsort(part @ (b - a), kind="stable")
    half = len(rows) // 2
    return Node(centre, radius, None, (build(x, rows[order[:half]], leaf), build(x, rows[order[half:]], leaf)))


def search(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of shape queries x k, padded with -inf; known: kth scores found elsewhere."""
    n = len(queries)
    scores, best = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)
    kth = known.copy()
    norms = np.sqrt((queries**2).sum(1))
    leaves: list[tuple[np.ndarray, np.ndarray]] = []

    def descend(node: Node, alive: np.ndarray) -> None:
        bound = queries[alive] @ node.centre + norms[alive] * node.radius
        bound = bound + 1e-9 * (np.abs(bound) + norms[alive] * (node.radius + np.sqrt((node.centre**2).sum())) + 1)
        fits = bound >= kth[alive]
        alive, bound = alive[fits], bound[fits]
        if not len(alive):
            return
        if node.below is None:
            all_bounds = np.full(n, -np.inf)
            all_bounds[alive] = bound
            leaves.append((node.rows, all_bounds))
        else:
            for child in node.below:
                descend(child, alive)

    descend(build(x, np.arange(len(x))), np.arange(n))
    if not leaves:
        return scores, best
    bounds = np.stack([b for _, b in leaves], axis=1)
    order = np.argsort(-bounds, axis=1, kind="stable")
    for step in range(len(leaves)):
        turn = order[:, step]
        bound = bounds[np.arange(n), turn]
        alive = np.flatnonzero((bound >= kth) & np.isfinite(bound))
        if not len(alive):
            break
        for leaf in np.unique(turn[alive]):
            at = alive[turn[alive] == leaf]
            rows = leaves[leaf][0]
            found = queries[at] @ x[rows].T
            found[query_ids[at][:, None] == ids[rows][None, :]] = -np.inf
            both = np.concatenate([scores[at], found], axis=1)
            both_ids = np.concatenate([best[at], np.broadcast_to(ids[rows], (len(at), len(rows)))], axis=1)
            top = np.lexsort((both_ids, -both), axis=-1)[:, :k]
            scores[at] = np.take_along_axis(both, top, 1)
            best[at] = np.take_along_axis(both_ids, top, 1)
            kth[at] = np.maximum(kth[at], scores[at, -1])
    return scores, best


def _matrix(t: pa.Table, column: str) -> np.ndarray:
    flat = t.column(column).combine_chunks().flatten()
    return np.asarray(flat, dtype=np.float64).reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 0))


@dataclass
class Balls:
    """The clusters of the vectors of one length: their numbers, centres (one a row) and radii."""

    numbers: np.ndarray
    centres: np.ndarray
    radii: np.ndarray


#: The cluster of vectors of a length that no centre has.
NONE = -1


def _lengths(batch: pa.RecordBatch) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors as a matrix) of each length in a batch of vectors in column v."""
    column = batch.column(batch.schema.get_field_index("v"))
    sizes = np.asarray(column.value_lengths())
    out = []
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        flat = column.take(pa.array(rows)).flatten()
        out.append((d, rows, np.asarray(flat, dtype=np.float64).reshape(len(rows), d)))
    return out


def top_k(vectors: DataFrame, *, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", query_mod: int = 20, shard_rows: int = 4096, block_rows: int = 1024, max_clusters: int = 1024, made: list[int] | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score; queries are the rows whose id is divisible by query_mod. made takes the rows that left the tasks of each round."""
    with scratch():
        best = kept(_search(vectors, k, scale, id_col, vec_col, query_mod, shard_rows, block_rows, max_clusters, made))
    return best.select("query_id", "rank", "vec_id", "score")


def _search(vectors: DataFrame, k: int, scale: int, id_col: str, vec_col: str, query_mod: int, shard_rows: int, block_rows: int, max_clusters: int, made: list[int] | None) -> DataFrame:
    x = F.col(vec_col)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & whole).select(F.col(id_col).cast("long").alias("id"), ints.alias("v"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    n_clusters = max(1, min(max_clusters, -(-rows.count() // shard_rows)))
    centres: dict[int, list] = {}
    for number, r in enumerate(rows.orderBy(F.xxhash64("row"), "row").select("v").limit(n_clusters).collect()):
        centres.setdefault(len(r.v), []).append((number, r.v))
    balls = {d: Balls(np.array([c for c, _ in found]), np.array([v for _, v in found], float).reshape(len(found), d), np.zeros(len(found))) for d, found in centres.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector's nearest centre and its distance."""
        for batch in batches:
            number, away = np.full(batch.num_rows, NONE), np.zeros(batch.num_rows)
            for d, at, part in _lengths(batch):
                if d in balls:
                    b = balls[d]
                    near = ((b.centres**2).sum(1)[None, :] - 2 * part @ b.centres.T).argmin(1)
                    number[at], away[at] = b.numbers[near], np.sqrt(((part - b.centres[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number.astype(np.int32)), pa.array(away)], [*batch.schema.names, "c", "away"])

    dealt = cut(rows.mapInArrow(deal, "id long, v array<long>, row long, c int, away double"))
    drop(rows)
    shards = {}
    for r in dealt.groupBy("c").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect():  # max_clusters rows and one at most
        shards[r.c] = -(-r.n // shard_rows)
        for b in balls.values():
            b.radii[b.numbers == r.c] = r.radius
    parts = dealt.sparkSession.createDataFrame(sorted(shards.items()), "c int, shards long")
    dealt_to = dealt.join(F.broadcast(parts), "c").withColumn("s", F.pmod(F.xxhash64("row"), "shards"))

    def visits(first: int, last: int):
        """The shards first to last, in the order of their clusters' bounds, of each query (row, id, v, kth) that may still find something there: c and from low to high."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kth = np.asarray(batch.column(batch.schema.get_field_index("kth")))
                for d, at, q in _lengths(batch):
                    b = balls.get(d)
                    if b is None:
                        bound, numbers = np.full((len(at), 1), np.inf), np.array([NONE])
                    else:
                        norms, numbers = np.sqrt((q**2).sum(1))[:, None], b.numbers
                        bound = q @ b.centres.T + norms * b.radii
                        bound += 1e-9 * (np.abs(bound) + norms * (b.radii + np.sqrt((b.centres**2).sum(1))) + 1)
                    turn = np.argsort(-bound, axis=1, kind="stable")
                    size = np.array([shards.get(c, 0) for c in numbers.tolist()])[turn]
                    end = np.cumsum(size, axis=1)
                    low, high = np.maximum(first, end - size) - (end - size), np.minimum(last, end) - (end - size)
                    i, j = np.nonzero((high > low) & (np.take_along_axis(bound, turn, 1) >= kth[at][:, None]))
                    picked = batch.take(pa.array(at[i]))
                    added = [numbers[turn[i, j]].astype(np.int32), low[i, j], high[i, j] - 1]
                    yield pa.RecordBatch.from_arrays([*picked.columns, *map(pa.array, added)], [*batch.schema.names, "c", "low", "high"])

        return run

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return kind.empty_table()
        q, rows, ids = np.asarray(left.column("row")), np.asarray(right.column("right_row")), np.asarray(right.column("right_id"))
        order = np.lexsort((rows, ids))  # places in this order decide ties, so they go to the smaller id
        rows, ids = rows[order], ids[order]
        by_row = np.argsort(rows)
        own = by_row[np.minimum(np.searchsorted(rows[by_row], q), len(rows) - 1)]
        own = np.where(rows[own] == q, own, -1)
        known = np.asarray(left.column("kth"), dtype=np.float64)
        scores, best = search(_matrix(right, "right_v")[order], np.arange(len(rows)), _matrix(left, "v"), own, known, k)
        there = np.isfinite(scores) & (scores >= known[:, None])
        columns = [np.broadcast_to(q[:, None], there.shape)[there], np.broadcast_to(np.asarray(left.column("id"))[:, None], there.shape)[there], ids[best[there]], scores[there].astype(np.int64)]
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=kind)

    best_first = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    asked = dealt.where(F.col("id") % query_mod == 0).select("row", "id", "v")
    best: DataFrame | None = None
    first, last = 0, 1
    while first < sum(shards.values()):
        known = asked.withColumn("kth", F.lit(float("-inf")))
        if best is not None:
            kth = best.where(F.col("rank") == k).select("row", F.col("score").cast("double").alias("kth"))
            known = asked.join(kth, "row", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
        going = cut(known.mapInArrow(visits(first, last), "row long, id long, v array<long>, kth double, c int, low long, high long"))
        left = going.withColumn("s", F.explode(F.sequence("low", "high")))
        plan = left.groupBy("c", "s").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
        left = left.join(plan, ["c", "s"]).withColumn("b", F.pmod(F.xxhash64("row"), "blocks"))
        right = dealt_to.join(plan, ["c", "s"]).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        # Both sides come from one table, so one of them gets columns of its own.
        right = right.select(*[F.col(c).alias(f"right_{c}") for c in ("c", "s", "b", "id", "row", "v")], F.size("v").alias("right_d"))
        left = left.select("c", "s", "b", "id", "row", "v", "kth", F.size("v").alias("d"))
        found = left.groupBy("d", "c", "s", "b").cogroup(right.groupBy("right_d", "right_c", "right_s", "right_b")).applyInArrow(each, "row long, query_id long, vec_id long, score long")
        if made is not None:
            found = cut(found)
            made.append(found.count())
        both = found if best is None else found.union(best.drop("rank"))
        after = cut(both.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k))
        drop(going, *([best] if best is not None else []))
        best, first, last = after, last, 2 * last
    if best is None:  # no vectors at all
        best = cut(asked.select("row", F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.col("id").alias("score"), F.lit(0).alias("rank")))
    return best


SQL = """
WITH whole AS (SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.place, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.place != c.place AND len(q.v) = len(c.v)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

"""Operator 3: exact Jaccard join of word-shingle sets in metric space, and its connected components.

Distinct texts are almost all at distance 1 from one another, and with a radius of 0.2 the triangle inequality
separates only what is nearer than 0.6 to some pivot: pivots drawn from the whole corpus would leave every document
on every border. So the first division is by cells, and the metric takes over inside. All steps are exact.

1. Cells (see shingles.py): any linked pair shares some. Each cell with two sets or more has a pivot, its least set,
   and the cells of one pivot make its region. A set that shares s cells or more with all it is linked to leaves the
   largest of its regions while the cells they stand for are fewer than s: of what linked sets have in common, the
   smallest region stays, so texts that only share a common passage part here.
2. Contraction: every set is compared with the pivot of its largest region. What is within the radius is linked, and
   sets that links connect count as one from here on. A region whose sets are all connected is done.
3. The others are divided by Voronoi regions. Several pivots are drawn from the sets that are outside the region's
   largest connected part; each set goes to its nearest pivot and, as the distances of linked sets from a pivot differ
   by the radius at most, to every pivot within twice the radius of that (the triangle-inequality window). Sets that
   are far from all pivots are a region of their own, with the like window. What is near a pivot is linked to it and
   contracted. Regions are joined recursively: in one task while they hold at most
   ``leaf`` elements, else by a shuffle, in which members are dealt to shares and the pivots go to every share.
4. When few sets are left outside the largest part, they are sent to every share of the region and compared there,
   and nothing that is connected is compared with one another.

The smallest regions are compared in the order of rare elements first, by prefixes. Components are found by
alternating star contractions. Equal sets are one node throughout, so groups of exact copies cost no more than one.
Hashes of shingles and sets have 61 to 64 bits and are believed.

Only a family of different texts that no links connect, all within 0.4 of one another and too large for a task, keeps
windows from dividing it. It is dealt to pairs of chunks, whose number is quadratic in the family's size.

Defined cases: a null or empty text, or one without words, has the empty set and is its own component; fewer than
five words count as one shingle of the whole sequence; ties go to the smallest id; repeated rows each give a row;
rows that share an id are documents of their own; a null id is never the smallest, and a component of null ids
only has the component_id null; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, drop, grouped, kept, scratch, text_chunks
from ledgerloom.llm.shingles import SIMILAR, cells, linked, shingle_sets

RADIUS = 1 - SIMILAR / 100
#: Cells that a worker gathers before it sends them on.
FLUSH = 2_000_000
#: Elements of all the sets of a region that one task joins.
LEAF = 1_000_000
#: Shuffled divisions, one after the other, after which something must be wrong.
LEVELS = 64
#: Pivots of a division.
PIVOTS = 8
#: Sets that are compared without a further division.
FEW = 8
#: Elements of sets that are compared with one set at once.
AT_ONCE = 1_000_000
#: A division is worth it if its regions hold at most so many times what was divided and the largest so much of it.
WORTH = ((3, 0.5), (1.25, 0.9))
#: Sets at this distance from all pivots, or beyond, belong to no pivot.
FAR = 0.7
#: Stands for the pivot of what is far from all.
ELSEWHERE = np.int64(-(1 << 63))
ALONE, FOLLOWED, FOLLOWS, OF_ROW = range(4)


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _map_cells(rows: DataFrame) -> DataFrame:
    """cell, node and info: four times a mark and a role.

    One pass over row and text. Of the sets of a cell in one worker's flush the least stands for all (ALONE, or FOLLOWED
    by others); those FOLLOW it and learn the cell's pivot by a join, so a cell that a third of all sets share sends one
    row a flush to its task. OF_ROW tells a row's node and, as mark, its number of shingles.
    """

    def led(keys: np.ndarray, nodes: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((nodes, keys))
        keys, nodes, marks = keys[order], nodes[order], marks[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        role = np.where(first, ALONE, FOLLOWS)
        role[:-1][first[:-1] & ~first[1:]] = FOLLOWED
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(nodes), pa.array(marks * 4 + role)], ["cell", "node", "info"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for batch in batches:
            keys = np.asarray(batch.column(0))
            for first, last, data, offsets in text_chunks(batch.column(1)):
                sets = shingle_sets(data, offsets)
                nodes = [node_of(s) for s in sets]
                sizes = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[first:last]), pa.array(nodes, pa.int64()), pa.array(sizes * 4 + OF_ROW)], ["cell", "node", "info"])
                new = {n: s for n, s in zip(nodes, sets, strict=True) if len(s) and n not in seen}
                seen.update(new)
                if len(seen) > FLUSH:
                    seen.clear()
                key, owner, mark = cells(list(new.values()))
                held.append((key, np.array(list(new), np.int64)[owner], mark))
                count += len(key)
                if count > FLUSH:
                    yield led(*map(np.concatenate, zip(*held, strict=True)))
                    held, count = [], 0
        if count:
            yield led(*map(np.concatenate, zip(*held, strict=True)))

    return rows.select("row", "text").mapInArrow(run, "cell long, node long, info long")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by cell and node: (0, row, node, shingles), (1, node, pivot, mark) of shared cells, and of cells
    with followers (2, node, cell, mark) of these and (3, pivot, cell, 0)."""

    def out(kind: int, a: np.ndarray, b: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(mark)], ["kind", "a", "b", "mark"])

    def met(cell: np.ndarray, node: np.ndarray, info: np.ndarray) -> Iterator[pa.RecordBatch]:
        fresh = np.ones(len(cell), bool)  # one set may lead its cell in several flushes
        fresh[1:] = (cell[1:] != cell[:-1]) | (node[1:] != node[:-1])
        begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])[: len(cell)])
        kinds = np.add.reduceat(fresh, begins, dtype=np.int64)
        followed = np.maximum.reduceat(info & 3, begins) == FOLLOWED
        sizes = np.diff(np.append(begins, len(cell)))
        shared = np.repeat((kinds > 1) | followed, sizes) & fresh
        yield out(1, node[shared], np.repeat(node[begins], sizes)[shared], info[shared] >> 2)
        yield out(3, node[begins[followed]], cell[begins[followed]], np.zeros(followed.sum(), np.int64))

    tail = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        x = [np.asarray(batch.column(k)) for k in range(3)]
        role = x[2] & 3
        own = role == OF_ROW
        yield out(0, x[0][own], x[1][own], x[2][own] >> 2)
        follows = role == FOLLOWS
        yield out(2, x[1][follows], x[0][follows], x[2][follows] >> 2)
        lead = ~own & ~follows
        x = [np.concatenate([a, b[lead]]) for a, b in zip(tail, x, strict=True)]
        if len(x[0]):
            whole = int(np.searchsorted(x[0], x[0][-1]))  # the last cell may go on
            tail = [a[whole:] for a in x]
            if whole:
                yield from met(*(a[:whole] for a in x))
    if len(tail[0]):
        yield from met(*tail)


def compare(sets: list[np.ndarray], find, join) -> None:
    """Links among sets that are not connected yet, by prefixes of their rarest elements first; find and join are of a union-find."""
    if len(sets) == 2:
        x, y = sets
        if find(0) != find(1) and 100 * min(len(x), len(y)) >= SIMILAR * max(len(x), len(y)) and linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
            join(0, 1)
        return
    flat = np.concatenate(sets)
    tokens, back, often = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, often))] = np.arange(len(tokens))
    common = np.sort(often)
    ranks = np.split(rank[back], np.cumsum([len(s) for s in sets])[:-1])
    index: dict[int, list[int]] = {}
    mark = np.zeros(len(tokens), np.int8)
    for k in sorted(range(len(sets)), key=lambda k: len(sets[k])):
        mine = np.sort(ranks[k])
        n = len(mine)
        prefix = mine[: n - -(-n * SIMILAR // 100) + 1]
        prefix = prefix[common[prefix] > 1].tolist()
        met = dict.fromkeys(j for t in prefix for j in index.get(t, ()))
        own = find(k)
        rivals = [j for j in met if 100 * len(sets[j]) >= SIMILAR * n and find(j) != own]
        mark[mine] = 1
        step = max(1, AT_ONCE // n)
        for first in range(0, len(rivals), step):
            part = rivals[first : first + step]
            ends = np.cumsum([len(ranks[j]) for j in part])
            counts = np.add.reduceat(mark[np.concatenate([ranks[j] for j in part])], np.concatenate([[0], ends[:-1]]), dtype=np.int64)
            for j, shared in zip(part, counts.tolist(), strict=True):
                if linked(shared, n, len(sets[j])) and find(j) != find(k):
                    join(j, k)
        mark[mine] = 0
        for t in prefix:
            index.setdefault(t, []).append(k)


def distances(sets: list[np.ndarray], pivots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distance, whether linked) of each set, none of them empty, and each pivot."""
    tokens, back = np.unique(np.concatenate(pivots), return_inverse=True)
    holds = np.zeros((len(tokens) + 1, len(pivots)), np.int32)
    holds[back, np.repeat(np.arange(len(pivots)), [len(p) for p in pivots])] = 1
    sizes = np.array([len(s) for s in sets], np.int64)
    shared = np.zeros((len(sets), len(pivots)), np.int64)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sets):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + AT_ONCE // len(pivots), "right")))
        flat = np.concatenate(sets[first:last])
        at = np.minimum(np.searchsorted(tokens, flat), len(tokens) - 1)
        at = np.where(tokens[at] == flat, at, len(tokens))
        shared[first:last] = np.add.reduceat(holds[at], np.concatenate([[0], np.cumsum(sizes[first:last])[:-1]]), axis=0)
        first = last
    union = sizes[:, None] + np.array([len(p) for p in pivots])[None, :] - shared
    return 1 - shared / union, (100 * shared >= SIMILAR * union) & (shared > 0)


def windows(d: np.ndarray) -> np.ndarray:
    """Which pivots' regions each set goes to, and (last column) whether to the region of what is FAR from all pivots.

    A set goes to its nearest pivot or is far, and also wherever a set that is linked to it may belong."""
    least = d.min(axis=1, keepdims=True)
    return np.concatenate([d <= np.minimum(least + 2 * RADIUS, FAR + RADIUS) + 1e-9, least >= FAR - RADIUS - 1e-9], axis=1)


def join_region(sets: list[np.ndarray], parts: list[int] | None = None) -> tuple[list[tuple[int, int]], int]:
    """Links that connect what is linked among the sets of one region, as positions, and how deep it was divided; sets of one part are connected already."""
    parent = list(range(len(sets)))
    out: list[tuple[int, int]] = []

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def join(a: int, b: int) -> None:
        parent[find(a)] = find(b)
        out.append((a, b))

    if parts:
        first: dict[int, int] = {}
        for k, p in enumerate(parts):
            parent[k] = first.setdefault(p, k)
    deepest = 0
    waiting = [(list(range(len(sets))), 0)]
    while waiting:
        some, depth = waiting.pop()
        roots = [find(k) for k in some]
        if len(set(roots)) < 2:
            continue
        deepest = max(deepest, depth)
        divided = []
        if len(some) > FEW:
            core = max(set(roots), key=roots.count)
            outside = [k for k, r in zip(some, roots, strict=True) if r != core]
            pivots = outside[:: -(-len(outside) // PIVOTS)]
            d, near = distances([sets[k] for k in some], [sets[k] for k in pivots])
            for k, q in zip(*np.nonzero(near), strict=True):
                if find(some[k]) != find(pivots[q]):
                    join(some[k], pivots[q])
            if len({find(k) for k in some}) < 2:
                continue
            goes = windows(d)
            divided = [[some[k] for k in np.flatnonzero(w)] for w in goes.T]
        if divided and any(sum(map(len, divided)) <= much * len(some) and max(map(len, divided)) <= wide * len(some) for much, wide in WORTH):
            waiting += [(x, depth + 1) for x in divided]
        else:
            compare([sets[k] for k in some], lambda i, at=some: find(at[i]), lambda i, j, at=some: join(at[i], at[j]))
    return out, deepest


def _contents(t: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("content")]


def _join_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) from region, node, part and content, sorted by region."""
    for t in grouped(batches, "region"):
        nodes = t.column("node").to_pylist()
        found, _ = join_region(_contents(t), t.column("part").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], ["a", "b"])


def _near_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """region, node, pivot and linked for each window of each member, from region, share, node, pivot (1 or 0) and content, sorted so that pivots come first."""
    names = ["region", "node", "pivot", "linked"]
    pivots: list[np.ndarray] = []
    pivot_nodes = np.zeros(0, np.int64)
    at = None
    for t in grouped(batches, "region", "share", "pivot"):
        here = (t.column("region")[0].as_py(), t.column("share")[0].as_py())
        if here != at:
            at, pivots, pivot_nodes = here, [], np.zeros(0, np.int64)
        nodes = np.asarray(t.column("node"))
        if t.column("pivot")[0].as_py():
            pivots, pivot_nodes = _contents(t), nodes
        elif pivots:
            d, near = distances(_contents(t), pivots)
            k, q = np.nonzero(windows(d))
            to, near = np.append(pivot_nodes, ELSEWHERE), np.concatenate([near, np.zeros((len(near), 1), bool)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), here[0])), pa.array(nodes[k]), pa.array(to[q]), pa.array(near[k, q])], names)


def _compared(members: DataFrame, pivots: DataFrame, sets: DataFrame, leaf: int) -> DataFrame:
    """region, node, pivot and linked: members (region, node, n) against the pivots (region, node) of their region."""
    shares = members.groupBy("region").agg(F.ceil(F.sum("n") / leaf).cast("int").alias("shares"))
    dealt = members.join(shares, "region").select("region", F.pmod(F.xxhash64("node"), "shares").cast("int").alias("share"), "node", F.lit(0).alias("pivot"))
    everywhere = pivots.join(shares, "region").select("region", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "node", F.lit(1).alias("pivot"))
    rows = dealt.union(everywhere).join(sets, "node").repartition("region", "share").sortWithinPartitions("region", "share", F.desc("pivot"))
    return rows.select("region", "share", "node", "pivot", "content").mapInArrow(_near_pivots, "region long, node long, pivot long, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """node and root (its component's least node) from links (a, b), by alternating stars."""
    state = (F.count("*"), F.bit_xor(F.xxhash64("a", "b")))
    links = cut(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = links.agg(*state).first()
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x")).select("x.a", F.col("x.m").alias("b")).where("a != b").distinct()
        after = cut(small)
        drop(links)
        now, links = after.agg(*state).first(), after
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def regions(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """region (its pivot), node and n, for all regions that are left with two sets or more: any linked sets are together in one."""
    edges = found.where("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("region"), "mark")
    pivots = found.where("kind = 3").select(F.col("a").alias("region"), F.col("b").alias("cell"))
    late = found.where("kind = 2").select(F.col("a").alias("node"), F.col("b").alias("cell"), "mark").join(pivots, "cell").select("node", "region", "mark")
    edges = cut(edges.union(late).groupBy("node", "region", "mark").agg(F.count("*").alias("cells")))
    sizes = edges.groupBy("region").agg(F.count("*").alias("size"))
    up = F.col("mark") % 2
    falling = Window.partitionBy("node", up).orderBy(F.desc("size"), "region").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = edges.join(sizes, "region").withColumn("so_far", F.sum("cells").over(falling)).where("so_far >= mark DIV 2").select("region", "node").distinct()
    kept = cut(kept.join(nodes.select("node", "n"), "node"))
    drop(edges)
    return kept.join(kept.groupBy("region").agg(F.count("*").alias("size")).where("size > 1").select("region"), "region", "left_semi")


def _shapes(parts: DataFrame) -> DataFrame:
    """Of each region (region, node, n, part) that is not all connected: its elements, the part with most of them, and what is outside that."""
    of_parts = parts.groupBy("region", "part").agg(F.sum("n").alias("n"), F.count("*").alias("sets"))
    largest = F.struct("n", "part")
    shapes = of_parts.groupBy("region").agg(F.sum("n").alias("total"), F.count("*").alias("parts"), F.max(largest).alias("core"), (F.sum("sets") - F.max_by("sets", largest)).alias("outside"))
    return shapes.where("parts > 1").select("region", "total", (F.col("total") - F.col("core.n")).alias("rest"), F.col("core.part").alias("core"), "outside")


def _tiles(rows: DataFrame, half: int) -> DataFrame:
    """Regions (region, node, part, total, rest, core) dealt to shares of all members, each with the sets outside the largest part: all of them if they fit, else chunk by chunk."""
    shares, chunks = F.ceil(F.col("total") / half), F.ceil(F.col("rest") / half)
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    members = rows.withColumn("i", F.pmod(F.xxhash64("node"), shares)).withColumn("j", numbers(chunks))
    outside = rows.where("part != core").withColumn("j", F.pmod(F.xxhash64("node", F.lit(1)), chunks)).withColumn("i", numbers(shares))
    return members.unionByName(outside).select(F.xxhash64("region", "i", "j").alias("region"), "node", "part").distinct()


def links_of(members: DataFrame, sets: DataFrame, *, leaf: int = LEAF, divided: list[int] | None = None) -> DataFrame:
    """Links (a, b) that connect what is linked among members (region, node, n); divided takes how many regions each shuffled division divides."""
    # The contraction: each set and the pivot of its largest region.
    sizes = members.groupBy("region").agg(F.count("*").alias("size"))
    largest = members.join(sizes, "region").groupBy("node").agg(F.max(F.struct("size", "region")).alias("x"), F.first("n").alias("n"))
    homes = cut(largest.select(F.col("x.region").alias("region"), F.col("x.size").alias("size"), "node", "n"))
    near = _compared(homes.where("region != node"), homes.select("region", F.col("region").alias("node")).distinct(), sets, leaf)
    links = cut(near.where("linked").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    of_two = homes.where("size = 2 AND region != node").select("region")  # these are done
    whole = F.lit(1 << 62)
    active = members.join(of_two, "region", "left_anti").select("region", "node", "n", F.col("region").alias("parent"), whole.alias("was"))
    for level in range(LEVELS):
        roots = cut(components(links))
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        parts = active.join(roots, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")
        shapes = _shapes(parts).join(parts.select("region", "parent", "was").distinct(), "region")
        if level:
            # A division is kept if its regions hold little more than what it divided. If not, what it has left unconnected is divided anew while that halves.
            own = shapes.where("region = parent").select("parent", "total", "rest")
            below = shapes.where("region != parent").groupBy("parent").agg(F.sum("total").alias("held"), F.max("total").alias("widest"))
            worth = [(F.col("held") <= much * F.col("total")) & (F.col("widest") <= wide * F.col("total")) for much, wide in WORTH]
            fate = own.join(below, "parent", "left").select("parent", F.when(F.col("held").isNull() | worth[0] | worth[1], "below").otherwise("own").alias("fate"))
            shapes = shapes.join(fate, "parent").where((F.col("fate") == "own") == (F.col("region") == F.col("parent")))
        now = cut(parts.drop("parent", "was").join(shapes.drop("parent"), "region"))
        stuck = (F.col("rest") <= leaf // 2) | (2 * F.col("rest") > F.col("was"))
        leaves = now.where(F.col("total") <= leaf).select("region", "node", "part").union(_tiles(now.where((F.col("total") > leaf) & stuck), max(1, leaf // 2)))
        rows = leaves.join(sets, "node").repartition("region").sortWithinPartitions("region").select("region", "node", "part", "content")
        links = cut(links.union(rows.mapInArrow(_join_leaves, "a long, b long")))
        large = now.where((F.col("total") > leaf) & ~stuck)
        if divided is not None:
            divided.append(large.select("region").distinct().count())
        if large.isEmpty():
            return links
        outside = large.where("part != core")
        drawn = outside.where(F.pmod(F.xxhash64("node", "region", F.lit(level)), "outside") < PIVOTS).select("region", "node")
        pivots = drawn.union(outside.groupBy("region").agg(F.min("node").alias("node"))).distinct()  # one at least
        near = cut(_compared(large, pivots, sets, leaf))
        links = cut(links.union(near.where("linked").select(F.col("node").alias("a"), F.col("pivot").alias("b"))))
        places = near.select(F.xxhash64("region", "pivot").alias("inner"), "node", "region").join(large.select("region", "node", "n"), ["region", "node"])
        again = large.select("region", "node", "n", F.col("region").alias("parent"), F.col("rest").alias("was"))
        active = places.select(F.col("inner").alias("region"), "node", "n", F.col("region").alias("parent"), whole.alias("was")).union(again)
    # What a division leaves unconnected is divided again only while it halves, so this takes more sets than there can be.
    raise RuntimeError(f"regions are left after {LEVELS} divisions")


def row_key(id_col: str, text_col: str) -> F.Column:
    """Tells rows apart that differ in id or text."""
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).isNull(), F.col(text_col))


def resolved(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, divided: list[int] | None = None) -> DataFrame:
    """id, row (its key), n (shingles) and root (the same for all that links connect; for empty sets the row's key) of each row."""
    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(1)):
                nodes = batch.column(0).slice(first, last - first)
                yield pa.RecordBatch.from_arrays([nodes, pa.array([s.tobytes() for s in shingle_sets(data, offsets)], pa.binary())], ["node", "content"])

    with scratch():
        meeting = F.when(F.col("info").bitwiseAND(3) < FOLLOWS, F.col("cell")).otherwise(F.xxhash64("cell", "node"))
        found = cut(_map_cells(rows).repartition(meeting).sortWithinPartitions("cell", "node").mapInArrow(_meet, "kind int, a long, b long, mark long"))
        of_rows = found.where("kind = 0").groupBy(F.col("a").alias("row")).agg(F.first("b").alias("node"), F.first("mark").alias("n"))
        nodes = cut(of_rows.where("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.min("row").alias("row")))
        members = cut(regions(found, nodes))
        wanted = members.select("node").distinct().join(nodes, "node").select("row", "node")
        texts = rows.select("row", "text").join(wanted.hint("shuffle_hash"), "row").select("node", "text")
        sets = cut(texts.mapInArrow(contents, "node long, content binary").dropDuplicates(["node"]))
        roots = components(links_of(members, sets, leaf=leaf, divided=divided))
        known = of_rows.join(roots, "node", "left").select("row", "n", F.when(F.col("n") > 0, F.coalesce("root", "node")).otherwise(F.col("row")).alias("root"))
        return kept(cut(rows.select("id", "row").join(known, "row")))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, divided: list[int] | None = None) -> DataFrame:
    """id_col, n_shingles and component_id (the smallest id that links reach)."""
    known = resolved(docs, id_col=id_col, text_col=text_col, leaf=leaf, divided=divided)
    full = F.when(F.col("n") > 0, F.col("root"))
    named = known.where("n > 0").groupBy("root").agg(F.min("id").alias("component_id"))
    out = known.withColumn("root", full).join(named, "root", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """The rows of docs, of each component only the one with the smallest id (nulls last, ties by a hash of the text); rows alike in id and text are one."""
    known = resolved(docs, id_col=id_col, text_col=text_col, leaf=leaf)
    first = known.groupBy(F.col("n") > 0, "root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("x")).select(F.col("x.row").alias("row"))
    rows = docs.select(row_key(id_col, text_col).alias("row"), F.struct(*[F.col(c) for c in docs.columns]).alias("doc"))
    rows = rows.join(first.hint("shuffle_hash"), "row", "left_semi").dropDuplicates(["row"])
    return rows.select(*[F.col("doc")[c].alias(c) for c in docs.columns])

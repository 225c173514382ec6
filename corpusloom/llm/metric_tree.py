"""Exact top-k search by inner product with M-trees.

With one more coordinate, the square root of what a vector's squared length lacks to the
largest one, all vectors have one length, and the largest inner product becomes the
smallest Euclidean distance, a metric. Vectors are dealt to cells around pivots, and a
cell to shards of bounded size. A shard is one M-tree: pages of entries with a routing
vector, a covering radius and the distance to the parent's vector. Search is best-first;
an entry whose stored distance to its parent already rules it out by the triangle
inequality costs no distance at all.

A query first visits its nearest cell. The score it finds there, and the cells' radii,
tell which other cells it has to visit.
"""

from __future__ import annotations

import heapq
import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut, ship

PAGE = 256
SHARD_ROWS = 16_384
CELLS = 16
#: Rows the pivots are chosen from; only speed depends on them.
PIVOT_SAMPLE = 1024
QUERY_BLOCK = 2048
#: Slack for rounding in distances, relative to the largest one.
SLACK = 1e-9


@dataclass
class Tree:
    """Pages of entries. ``child`` is -1 for an entry of a leaf; ``owner`` is its vector.

    Integer components are held as doubles, in which scores up to 2**53 are exact.
    """

    vectors: np.ndarray
    ids: np.ndarray
    first: np.ndarray
    page_at: np.ndarray
    owner: np.ndarray
    child: np.ndarray
    radius: np.ndarray
    parent: np.ndarray

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> Tree:
        with np.load(io.BytesIO(raw)) as z:
            return Tree(**{k: z[k] for k in z.files})


def _distances(scores: np.ndarray, base: float) -> np.ndarray:
    return np.sqrt(np.maximum(base - 2.0 * scores, 0.0))


def _choose(rows: np.ndarray, points: np.ndarray, n: int) -> np.ndarray:
    """``n`` routing rows, each far from the ones before."""
    picked = [int(rows[0])]
    gap = ((points[rows] - points[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < n:
        i = int(gap.argmax())
        if gap[i] <= 0:
            break
        picked.append(int(rows[i]))
        gap = np.minimum(gap, ((points[rows] - points[picked[-1]]) ** 2).sum(axis=1))
    return np.array(picked)


def build(vectors: np.ndarray, id_lists: list[list[int]], longest2: float) -> Tree:
    """Bulk-load a tree over distinct integer vectors, each with its few smallest ids."""
    plain = vectors.astype(np.float64)
    lift = np.sqrt(np.maximum(longest2 - (plain**2).sum(axis=1), 0.0))
    points = np.column_stack([plain, lift])
    pages: list[list[tuple[int, int, float, float]]] = []

    def load(rows: np.ndarray, parent: int) -> int:
        number = len(pages)
        pages.append([])
        gap = (lambda r: float(np.sqrt(((points[r] - points[parent]) ** 2).sum()))) if parent >= 0 else (lambda r: 0.0)
        if len(rows) <= PAGE:
            pages[number] = [(int(r), -1, 0.0, gap(r)) for r in rows]
            return number
        routing = _choose(rows, points, min(PAGE, -(-2 * len(rows) // PAGE)))  # pages about half full
        reach = ((points[rows] ** 2).sum(axis=1)[:, None] - 2 * points[rows] @ points[routing].T + (points[routing] ** 2).sum(axis=1))
        nearest = reach.argmin(axis=1)
        entries = []
        for k, r in enumerate(routing):
            own = rows[nearest == k]
            if not len(own):
                continue
            radius = float(np.sqrt(((points[own] - points[r]) ** 2).sum(axis=1).max()))
            entries.append((int(r), load(own, int(r)), radius, gap(r)))
        pages[number] = entries
        return number

    load(np.arange(len(vectors)), -1)
    flat = [e for p in pages for e in p]
    owner, child, radius, parent = (np.array(c) for c in zip(*flat))
    sizes = np.array([len(i) for i in id_lists])
    return Tree(
        plain, np.array([i for ids in id_lists for i in ids], np.int64), np.concatenate([[0], np.cumsum(sizes)]),
        np.concatenate([[0], np.cumsum([len(p) for p in pages])]), owner, child, radius, parent,
    )


def search(tree: Tree, query: np.ndarray, k: int, longest2: float, floor: float | None = None) -> list[tuple[int, int]]:
    """Best ``k`` of the tree as ``(score, vec_id)``, best first, ties to smaller ids.

    ``floor`` is a score that is already reached ``k`` times elsewhere: lower ones may be
    left out, equal ones not.
    """
    query = query.astype(np.float64)
    base = float((query**2).sum()) + longest2
    slack = SLACK * (1.0 + np.sqrt(base + longest2))
    best: list[tuple[int, int]] = []
    limit = np.inf if floor is None else float(np.sqrt(max(base - 2.0 * floor, 0.0))) + slack
    queue = [(0.0, 0, np.nan)]
    while queue:
        least, page, to_parent = heapq.heappop(queue)
        if least > limit:
            break
        a, b = tree.page_at[page], tree.page_at[page + 1]
        entry = np.arange(a, b)
        if to_parent == to_parent:
            entry = entry[np.abs(to_parent - tree.parent[a:b]) - tree.radius[a:b] <= limit]
        if not len(entry):
            continue
        owner = tree.owner[entry]
        scores = tree.vectors[owner] @ query
        far = _distances(scores, base)
        if tree.child[a] < 0:
            near = far <= limit
            if near.sum() > k:  # the k-th best vector of the page is a limit too
                near &= scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            if near.any():
                found = [(-int(s), int(i)) for o, s in zip(owner[near], scores[near]) for i in tree.ids[tree.first[o]:tree.first[o + 1]]]
                best = sorted(best + found)[:k]
                if len(best) == k:
                    limit = min(limit, float(np.sqrt(max(base + 2.0 * best[-1][0], 0.0))) + slack)
        else:
            bounds = np.maximum(far - tree.radius[entry], least)
            for i in np.flatnonzero(bounds <= limit).tolist():
                heapq.heappush(queue, (float(bounds[i]), int(tree.child[entry[i]]), float(far[i])))
    return [(-s, i) for s, i in best]


def quantized(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, q)`` with integer components floor(256 x).

    Rows without an id or vector, and vectors with a null or non-finite component, take
    no part. Shorter vectors count as followed by zeros.
    """
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & sound).select(
        F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(256 * v).cast("long")).alias("q")
    )


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    if len(flat) == len(column) * width and column.null_count == 0 and pa.compute.all(pa.compute.equal(pa.compute.list_value_length(column), width)).as_py():
        return flat.to_numpy().reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    for i, row in enumerate(column.to_pylist()):
        out[i, :len(row)] = row
    return out


def _pivots(distinct: DataFrame, width: int, longest2: float) -> np.ndarray:
    """Routing vectors of the cells, from a bounded sample by hash: at most ``CELLS``."""
    sample = distinct.select("q").orderBy(F.xxhash64("q"), "q").limit(PIVOT_SAMPLE).collect()
    rows = np.zeros((len(sample), width), np.int64)
    for i, r in enumerate(sample):
        rows[i, :len(r["q"])] = r["q"]
    if not len(rows):
        return rows
    points = rows.astype(np.float64)
    points = np.column_stack([points, np.sqrt(np.maximum(longest2 - (points**2).sum(axis=1), 0.0))])
    return rows[_choose(np.arange(len(rows)), points, CELLS)]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` highest inner products of each query with rows other than its own.

    Both inputs are ``(vec_id, q)``. Result: ``query_id, rank, vec_id, score``, ties to
    the smaller id. Equal vectors are one vector of the tree with their ``k + 1`` smallest
    ids, which is all that any query can return; equal queries are searched once. Fewer
    candidates give fewer ranks; no vectors or no queries give no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    keep = k + 1
    smallest = Window.partitionBy("q").orderBy("vec_id")
    ranked = vectors.withColumn("_r", F.dense_rank().over(smallest)).where(F.col("_r") <= keep)
    distinct = cut(ranked.groupBy("q").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")), "vectors")
    length2 = F.aggregate("q", F.lit(0.0), lambda s, v: s + v * v)
    shape = distinct.agg(F.max(length2).alias("l"), F.max(F.size("q")).alias("w")).first()
    width, longest2 = shape["w"] or 1, shape["l"] or 0.0
    pivots = _pivots(distinct, width, longest2)
    lifts = np.sqrt(np.maximum(longest2 - (pivots.astype(np.float64) ** 2).sum(axis=1), 0.0))

    def assign(batches):
        for batch in batches:
            rows = _matrix(batch.column("q"), width).astype(np.float64)
            lift = np.sqrt(np.maximum(longest2 - (rows**2).sum(axis=1), 0.0))
            far2 = 2 * longest2 - 2 * (rows @ pivots.T.astype(np.float64) + lift[:, None] * lifts)
            cell = far2.argmin(axis=1) if len(rows) else np.empty(0, np.int64)
            gap = np.sqrt(np.maximum(far2[np.arange(len(rows)), cell], 0.0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.astype(np.int32)), pa.array(gap), batch.column("q"), batch.column("ids")], ["cell", "gap", "q", "ids"]
            )

    dealt = cut(distinct.mapInArrow(assign, "cell int, gap double, q array<long>, ids array<long>"), "cells")
    cells = {r["cell"]: r for r in dealt.groupBy("cell").agg(
        F.max("gap").alias("radius"), F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("ids")).collect()}
    shards = {c: -(-r["n"] // SHARD_ROWS) for c, r in cells.items()}
    parts = F.element_at(F.create_map(*[F.lit(v) for c, n in shards.items() for v in (c, n)]), F.col("cell")) if shards else F.lit(1)

    def plant(table: pa.Table) -> pa.Table:
        tree = build(_matrix(table.column("q"), width), table.column("ids").to_pylist(), longest2)
        return pa.table({"cell": table.column("cell")[:1], "shard": table.column("shard")[:1], "tree": pa.array([tree.dump()], pa.binary())})

    index = cut(
        dealt.withColumn("shard", F.pmod(F.xxhash64("q"), parts).cast("int")).groupBy("cell", "shard").applyInArrow(plant, "cell int, shard int, tree binary"),
        "trees",
    )

    asked = cut(queries.groupBy("q").agg(F.min("vec_id").alias("ask")), "queries")
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    blocks = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            tree = Tree.load(left.column("tree")[0].as_py())
            wanted = _matrix(right.column("q"), width)
            for ask, query, floor in zip(right.column("ask").to_pylist(), wanted, right.column("floor").to_pylist()):
                out += [(ask, i, s) for s, i in search(tree, query, keep, longest2, floor)]
        columns = list(zip(*out)) or [[], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("ask", "vec_id", "score"), columns)})

    def visit(routed: DataFrame) -> DataFrame:
        """``routed(ask, q, floor, cell)`` against every shard of its cell."""
        keys = ["cell", "shard", "block"]
        sent = routed.withColumns({
            "shard": F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)), "block": F.pmod(F.xxhash64("ask"), F.lit(n_blocks)).cast("int"),
        })
        return blocks.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(find, "ask long, vec_id long, score long")

    full = np.array([c for c in sorted(cells) if cells[c]["ids"] >= keep] or sorted(cells), np.int64)
    every = np.array(sorted(cells), np.int64)
    radii = np.array([cells[c]["radius"] for c in every.tolist()])

    def route(batches, first: bool):
        for batch in batches:
            rows = _matrix(batch.column("q"), width).astype(np.float64)
            base = (rows**2).sum(axis=1) + longest2
            far = np.sqrt(np.maximum(base[:, None] - 2 * rows @ pivots.T.astype(np.float64), 0.0))
            home = full[far[:, full].argmin(axis=1)] if len(rows) else np.empty(0, np.int64)
            if first:
                pick, cell, floor = np.arange(len(rows)), home, pa.nulls(len(rows), pa.int64())
            else:
                floors = batch.column("floor")
                reach = np.array([np.inf if f is None else np.sqrt(max(b - 2.0 * f, 0.0)) for f, b in zip(floors.to_pylist(), base)])
                slack = SLACK * (1.0 + np.sqrt(base + longest2))
                open_ = (far[:, every] - radii <= (reach + slack)[:, None]) & (every[None, :] != home[:, None])
                pick, at = np.nonzero(open_)
                cell, floor = every[at], floors.take(pa.array(pick))
            yield pa.RecordBatch.from_arrays(
                [batch.column("ask").take(pa.array(pick)), batch.column("q").take(pa.array(pick)), floor, pa.array(cell.astype(np.int32))],
                ["ask", "q", "floor", "cell"],
            )

    if not cells:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    routed = "ask long, q array<long>, floor long, cell int"
    home = cut(visit(asked.mapInArrow(lambda b: route(b, True), routed)), "home")
    floors = home.groupBy("ask").agg(F.when(F.count(F.lit(1)) >= keep, F.min("score")).alias("floor"))
    # At most k + 1 rows a query and shard come back; the best k + 1 of all of them count.
    by_score = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    if any(n > 1 for n in shards.values()):
        floors = home.withColumn("_r", F.row_number().over(by_score)).where(F.col("_r") <= keep).groupBy("ask").agg(
            F.when(F.count(F.lit(1)) >= keep, F.min("score")).alias("floor"))
    rest = visit(asked.join(floors, "ask", "left").mapInArrow(lambda b: route(b, False), routed))
    found = home.unionByName(rest).withColumn("_r", F.row_number().over(by_score)).where(F.col("_r") <= keep).drop("_r")
    names = queries.select("q", F.col("vec_id").alias("query_id")).distinct().join(asked, "q").select("ask", "query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        names.join(found, "ask").where(F.col("query_id") != F.col("vec_id"))
        .withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )

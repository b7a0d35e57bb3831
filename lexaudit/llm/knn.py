"""Exact top-k by inner product: a KD-split table, a KD-tree per shard, best-first, with a propagated k-th score.

Method
------
Components become whole numbers floor(1024 * x). A sample of bounded size gives a global KD split: medians of the widest
dimension, until a cell has about ``SHARD_ROWS`` vectors. Every vector goes to its cell, and a cell gets a tight box over all
its vectors. A cell is one shard, or several by a hash of the id where it came out larger (many equal vectors can't be split). Each
shard builds a KD-tree by the same median splits, and keeps a tight box for every node. For a query the largest inner product that a
box allows is the sum of q * (q >= 0 ? high : low). Nodes are opened in the order of this bound and the search ends when
the best open bound is below the k-th score so far; equal bounds are still opened, since ties go to the smaller id.

The k-th score is propagated: every query meets the sample first, whose k-th score starts the search in the query's own cell; the
k-th score after that cell decides, by the boxes, which other cells the query is sent to at all. Queries are not broadcast:
they are dealt to the shards and stream past the tree, so a task holds one shard and a batch. The shards' best k are merged per query.

Pruning depends on the data: boxes of clustered vectors exclude nearly all of a table, those of vectors without structure in many dimensions
nothing (README has figures); results are exact either way.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without an
id. Only vectors of the same length meet. A vector's own row is every row with its id. Repeated rows count once; if
rows share an id but not a vector, the best score counts. Fewer than k candidates give fewer rows. An empty table
gives no rows. Extra columns are ignored. Inner products must fit 64 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import hash_share
from .storage import Workspace

SCALE, LEAF = 1024, 64
#: Vectors of a shard; and the fewest that are worth a shard of their own, if there are idle cores.
SHARD_ROWS, LEAST_SHARD_ROWS = 16_384, 1_024
#: Vectors of the sample, and of the sample for each leaf of the global split, and bytes of all boxes: they bound the number of cells.
PILOT_ROWS, SAMPLE_PER_CELL, BOX_BYTES = 8_192, 8, 64_000_000
#: Tasks of a search; beyond that a task takes several shards, one after the other.
MAX_TASKS = 20_000
_EXACT = 2.0**53


class KDTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.repeats = len(np.unique(ids)) < len(ids)
        self.opened = 0  # leaves, by all searches
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.parts: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        order = np.arange(len(ids))
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node = len(self.parts)
            if parent >= 0:
                self.children[parent] = (node, self.children[parent][1]) if side == 0 else (self.children[parent][0], node)
            own = vectors[order[a:b]]
            self.low.append(own.min(axis=0))
            self.high.append(own.max(axis=0))
            self.parts.append((a, b))
            spread = self.high[-1] - self.low[-1]
            if b - a <= LEAF or not spread.any():
                self.children.append(None)
                continue
            self.children.append((-1, -1))
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, spread.argmax()], middle)]
            todo += [(a + middle, b, node, 1), (a, a + middle, node, 0)]
        self.ids, self.vectors = ids[order], vectors[order]
        self.low, self.high = np.array(self.low), np.array(self.high)
        # exact in floating point as long as no sum of absolute products can pass 2^53
        self.reach = np.maximum(np.abs(self.low[0]), np.abs(self.high[0])).astype(np.float64)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of each query's best k ids here; ``floors``: scores that k other ids are known to reach."""
        exact = bool((np.abs(queries).astype(np.float64) @ self.reach < _EXACT).all())
        kind = np.float64 if exact else np.int64
        q, vectors = queries.astype(kind), self.vectors.astype(kind)
        bounds = np.maximum(q, 0) @ self.high.astype(kind).T + np.minimum(q, 0) @ self.low.astype(kind).T
        out = []
        for i in range(len(q)):
            ids, scores = np.empty(0, np.int64), np.empty(0, kind)
            kth = floors[i]
            heap = [(-bounds[i, 0], 0)]
            while heap and -heap[0][0] >= kth:
                _, node = heapq.heappop(heap)
                if self.children[node]:
                    for child in self.children[node]:
                        if bounds[i, child] >= kth:
                            heapq.heappush(heap, (-bounds[i, child], child))
                    continue
                a, b = self.parts[node]
                self.opened += 1
                s = vectors[a:b] @ q[i]
                good = (s >= kth) & (self.ids[a:b] != query_ids[i])
                if good.any():
                    ids, scores = np.concatenate([ids, self.ids[a:b][good]]), np.concatenate([scores, s[good]])
                    best = np.lexsort((ids, -scores))
                    if self.repeats:  # the best row of each id
                        best = best[np.sort(np.unique(ids[best], return_index=True)[1])]
                    ids, scores = ids[best[:k]], scores[best[:k]]
                    if len(ids) == k:
                        kth = max(kth, scores[-1])
            out.append((ids, scores.astype(np.int64)))
        return out


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class KDSplit:
    """The global split of the vectors of one length: inner nodes as (dimension, threshold, left, right), leaves as cells."""

    def __init__(self, vectors: np.ndarray, cells: int):
        self.nodes: list[tuple[int, int, int, int]] = []
        self.cells = 0
        cells = max(1, min(cells, len(vectors) // SAMPLE_PER_CELL))
        self._grow(vectors, cells)

    def _grow(self, own: np.ndarray, cells: int) -> int:
        """The number of the node, or -1 - cell of a leaf."""
        spread = own.max(axis=0) - own.min(axis=0) if len(own) else np.zeros(1)
        if cells > 1 and spread.any():
            at = int(spread.argmax())
            middle = int(np.partition(own[:, at], len(own) // 2)[len(own) // 2])
            if middle == own[:, at].min():
                middle += 1
            right = own[:, at] >= middle
            node = len(self.nodes)
            self.nodes.append((at, middle, 0, 0))
            self.nodes[node] = (at, middle, self._grow(own[~right], cells // 2), self._grow(own[right], cells - cells // 2))
            return node
        self.cells += 1
        return -self.cells

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        node = np.full(len(vectors), 0 if self.nodes else -1)
        while (node >= 0).any():
            for n in np.unique(node[node >= 0]):
                at, middle, left, right = self.nodes[n]
                own = np.flatnonzero(node == n)
                node[own] = np.where(vectors[own, at] >= middle, right, left)
        return -1 - node


def _place(splits):
    """Adds the cell to (vec_id, dim, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            cells = np.zeros(len(batch), dtype=np.int32)
            for dim in np.unique(dims):
                if dim in splits.value:
                    at = np.flatnonzero(dims == dim)
                    cells[at] = splits.value[dim].assign(_vectors(batch.column("v").take(pa.array(at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=[*batch.schema.names, "cell"])

    return run


def _boxes(known: set[int]):
    """Count and box of every cell in a partition; lengths that the sample doesn't know have no box."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            dims, cells = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "cell"))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                own = _vectors(batch.column("v").take(pa.array(at))) if dim in known else None
                for cell in np.unique(cells[at]):
                    inside = cells[at] == cell
                    n, low, high = found.get((dim, cell), (0, None, None))
                    if own is not None:
                        a, b = own[inside].min(axis=0), own[inside].max(axis=0)
                        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
                    found[dim, cell] = (n + int(inside.sum()), low, high)
        if found:
            yield _box_batch(found)

    return run


def _box_batch(found: dict) -> pa.RecordBatch:
    lists = [pa.array([None if x[k] is None else x[k].tolist() for x in found.values()], pa.list_(pa.int64())) for k in (1, 2)]
    return pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int32()), pa.array([c for _, c in found], pa.int32()), pa.array([x[0] for x in found.values()], pa.int64()), *lists], names=["dim", "cell", "n", "low", "high"])


def _join_boxes(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    low, high = None, None
    if rows[0]["low"] is not None:
        low, high = np.min([r["low"] for r in rows], axis=0), np.max([r["high"] for r in rows], axis=0)
    return pa.Table.from_batches([_box_batch({(rows[0]["dim"], rows[0]["cell"]): (sum(r["n"] for r in rows), low, high)})])


class Layout:
    """The shards: for each cell its first shard and how many it has, and its box."""

    def __init__(self, rows: list):
        self.cells: dict[int, list[tuple[int, int, int]]] = {}
        self.low: dict[int, np.ndarray] = {}
        self.high: dict[int, np.ndarray] = {}
        self.shards = 0
        for r in sorted(rows, key=lambda r: (r.dim, r.cell)):
            parts = -(-r.n // SHARD_ROWS)
            self.cells.setdefault(r.dim, []).append((r.cell, self.shards, parts))
            self.shards += parts
        for dim in self.cells:
            own = sorted((r for r in rows if r.dim == dim and r.low is not None), key=lambda r: r.cell)
            if own:
                self.low[dim], self.high[dim] = np.array([r.low for r in own]), np.array([r.high for r in own])

    def reached(self, dim: int, queries: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """For each query and cell (in order), whether the cell's box allows the floor. Bounds in floating point get a margin, so none is lost."""
        if dim not in self.low:
            return np.ones((len(queries), len(self.cells[dim])), dtype=bool)
        q, low, high = (x.astype(np.float64) for x in (queries, self.low[dim], self.high[dim]))
        bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        reach = np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T
        return bounds + 1e-12 * q.shape[1] * reach >= floors[:, None]


def _deal(layout, home: bool):
    """Rows of (shard, dim, kind, vec_id, v, floor) for the queries' own cells (``home``) or for the others that they can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = layout.value
        for batch in batches:
            dims, cells = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "cell"))
            floors = np.array([-np.inf if f is None else f for f in batch.column("floor").to_pylist()])
            rows, shards = [], []
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                own = np.array([c for c, _, _ in plan.cells[dim]]) == cells[at][:, None]
                reach = own if home else plan.reached(dim, _vectors(batch.column("v").take(pa.array(at))), floors[at]) & ~own
                row, place = np.nonzero(reach)
                first, parts = (np.array([x[k] for x in plan.cells[dim]])[place] for k in (1, 2))
                rows.append(np.repeat(at[row], parts))
                shards.append(np.repeat(first, parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
            rows, shards = np.concatenate([[], *rows]).astype(np.int64), np.concatenate([[], *shards]).astype(np.int32)
            for i in range(0, len(rows), 4_096):
                take = pa.array(rows[i : i + 4_096])
                own = {c: batch.column(c).take(take) for c in ("dim", "vec_id", "v", "floor")}
                yield pa.RecordBatch.from_arrays([pa.array(shards[i : i + 4_096]), own["dim"], pa.array(np.ones(len(take), np.int32)), own["vec_id"], own["v"], own["floor"]], names=["shard", "dim", "kind", "vec_id", "v", "floor"])

    return run


def _pilot_floor(pilot, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = {}
        for dim, (ids, vectors) in pilot.value.items():
            trees[dim] = KDTree(ids, vectors)
        for batch in batches:
            floors: list[int | None] = [None] * len(batch)
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                if dim in trees:
                    at = np.flatnonzero(dims == dim)
                    part = batch.take(pa.array(at))
                    none = np.full(len(at), -np.inf)
                    for i, (ids, scores) in zip(at, trees[dim].search(part.column("vec_id").to_numpy(zero_copy_only=False), _vectors(part.column("v")), none, k)):
                        if len(ids) == k:
                            floors[i] = int(scores[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "dim", "v", "cell")), pa.array(floors, pa.int64())], names=["vec_id", "dim", "v", "cell", "floor"])

    return run


def _search_shards(k: int):
    """Rows come sorted by shard, dimension and kind: the vectors (kind 0) of a shard, then its queries (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, vectors, tree = None, [], [], None
        for batch in batches:
            if not len(batch):
                continue
            shard, dim, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "dim", "kind"))
            edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(dim) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(batch)]):
                key = (shard[a], dim[a])
                if key != current:
                    current, ids, vectors, tree = key, [], [], None
                part = batch.slice(a, b - a)
                own_ids, own = part.column("vec_id").to_numpy(zero_copy_only=False), _vectors(part.column("v"))
                if kind[a] == 0:
                    ids.append(own_ids)
                    vectors.append(own)
                    continue
                if tree is None and ids:
                    tree = KDTree(*_distinct(np.concatenate(ids), np.concatenate(vectors)))
                    ids, vectors = [], []
                if tree is None:
                    continue
                floors = np.array([-np.inf if f is None else f for f in part.column("floor").to_pylist()])
                found = tree.search(own_ids, own, floors, k)
                counts = [len(x) for x, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(own_ids, counts)), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([s for _, s in found]))],
                    names=["query_id", "vec_id", "score"],
                )

    return run


def _distinct(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(np.unique(ids)) == len(ids):
        return ids, vectors
    _, at = np.unique(np.column_stack([ids, vectors]), axis=0, return_index=True)
    return ids[at], vectors[at]


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, dim and v (whole numbers) of the rows that take part."""
    usable = F.expr(f"`{id_col}` is not null and size(`{vector_col}`) > 0 and forall(`{vector_col}`, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('Infinity'))")
    whole = F.expr(f"transform(`{vector_col}`, x -> cast(floor({SCALE} * cast(x as double)) as bigint))")
    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.size(vector_col).alias("dim"), whole.alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of every row for which ``is_query`` (over vec_id) holds."""
    spark, ws = vectors.sparkSession, Workspace(vectors.sparkSession, "top-k")
    share = spark.sparkContext.broadcast
    rows = quantised(vectors, id_col, vector_col)
    total = vectors.count()
    sample = rows.where(hash_share("vec_id") * total <= 4.0 * PILOT_ROWS).orderBy(F.xxhash64("vec_id"), "vec_id").limit(PILOT_ROWS).toArrow()
    pilot: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    splits: dict[int, KDSplit] = {}
    for dim in set(sample["dim"].to_pylist()):
        part = sample.filter(pa.compute.equal(sample["dim"], dim)).combine_chunks()
        drawn = _vectors(part["v"].combine_chunks())
        pilot[dim] = _distinct(part["vec_id"].to_numpy(), drawn)
        wanted = max(total // SHARD_ROWS, min(spark.sparkContext.defaultParallelism, total // LEAST_SHARD_ROWS)) * len(part) // len(sample)
        splits[dim] = KDSplit(drawn, min(wanted, BOX_BYTES // (16 * dim)))
    placed = ws.save(rows.mapInArrow(_place(share(splits)), "vec_id long, dim int, v array<bigint>, cell int"), "placed")
    box = "dim int, cell int, n long, low array<bigint>, high array<bigint>"
    layout = Layout(placed.select("dim", "cell", "v").mapInArrow(_boxes(set(pilot)), box).groupBy("dim", "cell").applyInArrow(_join_boxes, box).collect())  # one row for each cell
    if not layout.shards:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    first = [(dim, cell, shard, parts) for dim, cells in layout.cells.items() for cell, shard, parts in cells]
    shards = F.broadcast(spark.createDataFrame(first, "dim int, cell int, first int, parts int"))
    shard = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("shard")
    own = placed.join(shards, ["dim", "cell"]).select(shard, "dim", F.lit(0).alias("kind"), "vec_id", "v", F.lit(None).cast("long").alias("floor"))
    streamed = "shard int, dim int, kind int, vec_id long, v array<bigint>, floor long"
    plan, tasks = share(layout), min(MAX_TASKS, layout.shards)

    def search(dealt: DataFrame, tag: str) -> DataFrame:
        streams = own.union(dealt).repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard", "dim", "kind")
        return ws.save(streams.mapInArrow(_search_shards(k), "query_id long, vec_id long, score long"), tag)

    def ranked(found: DataFrame) -> DataFrame:
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)

    queries = placed.where(is_query).mapInArrow(_pilot_floor(share(pilot), k), "vec_id long, dim int, v array<bigint>, cell int, floor long")
    home = search(queries.mapInArrow(_deal(plan, True), streamed), "home")
    kth = ranked(home).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    left = queries.join(kth, "vec_id", "left").withColumn("floor", F.greatest("floor", "kth")).drop("kth")
    others = search(left.mapInArrow(_deal(plan, False), streamed), "others") if layout.shards > 1 else None
    return ranked(home.union(others) if others is not None else home).select("query_id", "rank", "vec_id", "score")

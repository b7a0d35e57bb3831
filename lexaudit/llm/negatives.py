"""Hard-negative mining: ball trees per shard, branch and bound inside windows of the score.

Method
------
Components become whole numbers floor(256 * x). A bounded sample gives a global median split into cells; a cell's ball has the mean of its
sample as centre and the distance of its farthest vector as radius, and a large cell is dealt to several shards by a hash of the id. A task builds
one ball tree for each label of its shard. For a query q a ball with centre c and radius r holds inner products from q.c - |q| r to q.c + |q| r only.

A search is a query with windows [low, high] of the score, each of which keeps its k best rows. Balls are opened by falling upper bound, and a ball
is pruned where, for every window, it lies outside the window or strictly beneath the window's k-th score so far (equal scores are still opened:
ties go to the smaller id). The k-th score starts from the sample, which every query meets first, and so excludes whole shards before the query
is sent to them. Two searches follow each other: an anchor's positives (one open window, rows of its label), then the negatives of all its
positives (a window each, rows of other labels). Queries are dealt to shards and stream past the trees; neither side is broadcast. What balls
exclude depends on the data; the result is exact either way.

Defined results: rows without an id or label, and vectors that are null, empty or hold null or non-finite components take no part. Rows that share an
id are one row, the one with the least (label, vector). Only vectors of the same length meet. Ids and labels are whole numbers. Equal scores go by
the smaller id; fewer candidates give fewer rows; an anchor without positives, or a positive whose score is negative, gives none. An empty table gives
no rows. Extra columns are ignored. Inner products must fit 64 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .knn import KDSplit
from .sampling import hash_share
from .storage import Workspace

SCALE, LEAF = 256, 128
#: Vectors of a shard; the fewest that are worth a shard of their own, if there are idle cores; rows of the sample; bytes of all centres.
SHARD_ROWS, LEAST_SHARD_ROWS, PILOT_ROWS, CENTRE_BYTES = 16_384, 1_024, 8_192, 64_000_000
MAX_TASKS = 20_000
_OPEN, _EXACT = 1 << 62, 2.0**53
#: Relative error that bounds in floating point may have.
_MARGIN = 1e-9
_STREAM = "shard int, dim int, kind int, vec_id long, label long, v array<bigint>, tags array<bigint>, base array<bigint>, low array<bigint>, high array<bigint>"
_COLUMNS = [c.split()[0] for c in _STREAM.split(", ")]


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class BallTree:
    """One tree for each label; node i covers rows parts[i] and lies in the ball (centre[i], radius[i])."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids, labels))
        centres, radii = [], []
        self.parts: list[tuple[int, int]] = []
        self.children: list[tuple[int, ...]] = []
        self.roots: dict[int, int] = {}
        starts = np.flatnonzero(np.diff(labels[order], prepend=labels[order[:1]] - 1)) if len(ids) else []
        todo = [(a, b, None, int(labels[order[a]])) for a, b in zip(starts, [*starts[1:], len(ids)])]
        while todo:
            a, b, parent, label = todo.pop()
            node = len(self.parts)
            if parent is None:
                self.roots[label] = node
            else:
                self.children[parent] += (node,)
            own = vectors[order[a:b]].astype(np.float64)
            centre = own.mean(axis=0)
            centres.append(centre)
            radii.append(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
            self.parts.append((a, b))
            self.children.append(())
            spread = own.max(axis=0) - own.min(axis=0)
            if b - a <= LEAF or not spread.any():
                order[a:b] = np.sort(order[a:b]) if len(ids) < 2 else order[a:b][np.argsort(ids[order[a:b]], kind="stable")]
                continue
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, spread.argmax()], middle)]
            todo += [(a, a + middle, node, label), (a + middle, b, node, label)]
        self.opened = 0
        self.ids, self.vectors = ids[order], vectors[order]
        self.centres, self.radii = np.array(centres).reshape(len(centres), -1), np.array(radii)
        self.reach = np.abs(self.vectors).max(axis=0).astype(np.float64)

    def search(self, own_id: int, label: int, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the k best rows in each window; of the query's label if ``same``, else of the others."""
        kind = np.float64 if np.abs(q).astype(np.float64) @ self.reach < _EXACT else np.int64
        q, low = q.astype(kind), low.astype(kind)
        high = high.astype(kind)
        real = q.astype(np.float64)
        dots, size = self.centres @ real, np.sqrt(real @ real)
        slack = size * self.radii * (1 + _MARGIN) + _MARGIN * size * np.sqrt((self.centres**2).sum(axis=1)) + _MARGIN
        up, down = dots + slack, dots - slack
        best = [(np.empty(0, np.int64), np.empty(0, kind)) for _ in low]
        wanted = lambda node: bool(((up[node] >= low) & (down[node] <= high)).any())
        heap = [(-up[r], r) for x, r in self.roots.items() if (x == label) == same and wanted(r)]
        heapq.heapify(heap)
        while heap and -heap[0][0] >= low.min():
            _, node = heapq.heappop(heap)
            if not wanted(node):
                continue
            if self.children[node]:
                for child in self.children[node]:
                    if wanted(child):
                        heapq.heappush(heap, (-up[child], child))
                continue
            a, b = self.parts[node]
            self.opened += 1
            scores = self.vectors[a:b] @ q if kind is np.int64 else self.vectors[a:b].astype(np.float64) @ q
            if scores.max() < low.min():
                continue
            for j in range(len(low)):
                at = np.flatnonzero((scores >= low[j]) & (scores <= high[j]) & (self.ids[a:b] != own_id))
                if not len(at):
                    continue
                ids, found = np.concatenate([best[j][0], self.ids[a:b][at]]), np.concatenate([best[j][1], scores[at]])
                first = np.lexsort((ids, -found))[:k]
                best[j] = ids[first], found[first]
                if len(first) == k:
                    low[j] = max(low[j], best[j][1][-1])
        return [(ids, found.astype(np.int64)) for ids, found in best]


class Cells:
    """The global split of the vectors of one length, with the centre of each cell."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.split = KDSplit(sample, cells)
        at = self.split.assign(sample)
        self.centres = np.array([sample[at == c].mean(axis=0) if (at == c).any() else np.zeros(sample.shape[1]) for c in range(self.split.cells)])

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and its distance from the centre."""
        cells = self.split.assign(vectors)
        return cells, np.sqrt(((vectors - self.centres[cells]) ** 2).sum(axis=1))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        yield int(dim), np.flatnonzero(dims == dim)


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, far = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            for dim, at in _by_length(batch):
                if dim in shared.value:
                    cells[at], far[at] = shared.value[dim].place(_vectors(batch.column("v").take(pa.array(at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    return run


def _windows(batch: pa.RecordBatch, at: np.ndarray, name: str) -> list[np.ndarray]:
    return [np.array(x, np.int64) for x in batch.column(name).take(pa.array(at)).to_pylist()]


def _raise_floors(pilot, k: int, same: bool):
    """Windows start at the k-th score that the sample has in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows: list = batch.column("low").to_pylist()
            for dim, at in _by_length(batch):
                if dim not in pilot.value:
                    continue
                ids, labels, vectors = pilot.value[dim]
                queries = _vectors(batch.column("v").take(pa.array(at)))
                names, own = (batch.column(c).take(pa.array(at)).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
                for i, q, name, label, high in zip(at, queries, names, own, _windows(batch, at, "high")):
                    kind = np.float64 if np.abs(q).astype(np.float64) @ np.abs(vectors).max(axis=0).astype(np.float64) < _EXACT else np.int64
                    scores = np.sort((vectors.astype(kind) @ q.astype(kind))[((labels == label) == same) & (ids != name)]).astype(np.int64)
                    for j, (a, b) in enumerate(zip(lows[i], high)):
                        end = np.searchsorted(scores, b, "right")
                        if end >= k:
                            lows[i][j] = max(a, int(scores[end - k]))
            yield batch.set_column(batch.schema.get_field_index("low"), "low", pa.array(lows, pa.list_(pa.int64())))

    return run


def _deal(layout):
    """Each query once for every shard whose cell its windows allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at in _by_length(batch):
                if dim not in layout.value:
                    continue
                cells, first, parts, radii, centres = layout.value[dim]
                queries = _vectors(batch.column("v").take(pa.array(at))).astype(np.float64)
                if centres is None:
                    allowed = np.ones((len(at), len(cells)), bool)
                else:
                    size, dots = np.sqrt((queries**2).sum(axis=1))[:, None], queries @ centres.T
                    slack = size * radii * (1 + _MARGIN) + _MARGIN * size * np.sqrt((centres**2).sum(axis=1)) + _MARGIN
                    allowed = np.array([((u >= a[:, None]) & (d <= b[:, None])).any(axis=0) for u, d, a, b in zip(dots + slack, dots - slack, _windows(batch, at, "low"), _windows(batch, at, "high"))])
                row, place = np.nonzero(allowed)
                rows = np.repeat(at[row], parts[place])
                shards = np.repeat(first[place], parts[place]) + np.arange(len(rows)) - np.repeat(np.cumsum(parts[place]) - parts[place], parts[place])
                for i in range(0, len(rows), 4_096):
                    own = batch.take(pa.array(rows[i : i + 4_096]))
                    yield pa.RecordBatch.from_arrays([pa.array(shards[i : i + 4_096].astype(np.int32)), *(own.column(c) for c in _COLUMNS[1:])], names=_COLUMNS)

    return run


def _search(k: int, same: bool):
    """Rows come sorted by shard, dimension and kind: the vectors (kind 0) of a shard, then its queries (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, gathered, tree = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            shard, dim, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "dim", "kind"))
            edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(dim) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(batch)]):
                if (shard[a], dim[a]) != current:
                    current, gathered, tree = (shard[a], dim[a]), [], None
                part = batch.slice(a, b - a)
                ids, labels = (part.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
                if kind[a] == 0:
                    gathered.append((ids, labels, _vectors(part.column("v"))))
                    continue
                if tree is None and gathered:
                    tree, gathered = BallTree(*(np.concatenate(x) for x in zip(*gathered))), []
                if tree is None:
                    continue
                rows = np.arange(len(part))
                out: list[tuple] = []
                for i, q, tags, base, low, high in zip(rows, _vectors(part.column("v")), *(_windows(part, rows, c) for c in ("tags", "base", "low", "high"))):
                    for j, (found, scores) in enumerate(tree.search(ids[i], labels[i], q, low, high, k, same)):
                        out += [(ids[i], tags[j], base[j], x, s) for x, s in zip(found, scores)]
                columns = zip(*out) if out else ([],) * 5
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in columns], names=["anchor_id", "tag", "base", "vec_id", "score"])

    return run


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, dim and v (whole numbers) of the rows that take part, one for each id."""
    usable = F.expr(f"`{id_col}` is not null and `{label_col}` is not null and size(`{vector_col}`) > 0 and forall(`{vector_col}`, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('Infinity'))")
    whole = F.expr(f"transform(`{vector_col}`, x -> cast(floor({SCALE} * cast(x as double)) as bigint))")
    rows = vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.struct(F.col(label_col).cast("long").alias("label"), whole.alias("v")).alias("x"))
    return rows.groupBy("vec_id").agg(F.min("x").alias("x")).select("vec_id", "x.label", F.size("x.v").alias("dim"), "x.v")


def _percent(percent: int, up: bool) -> Column:
    """Of ``score``, in whole numbers, rounded up or down."""
    x = f"{-percent if up else percent} * score"
    return F.expr(f"{'-' if up else ''}(({x} - pmod({x}, 100)) div 100)")


def mine_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every row for which ``is_anchor`` (over vec_id) holds.

    An anchor's positives are the ``positives`` best other rows of its label; for each the ``negatives`` best rows of other labels are
    returned whose score is from ``low`` to ``high`` percent of the positive's.
    """
    spark, ws = vectors.sparkSession, Workspace(vectors.sparkSession, "negatives")
    share = spark.sparkContext.broadcast
    rows = ws.save(quantised(vectors, id_col, vector_col, label_col), "rows")
    total = rows.count()
    sample = rows.where(hash_share("vec_id") * total <= 4.0 * PILOT_ROWS).orderBy(F.xxhash64("vec_id"), "vec_id").limit(PILOT_ROWS).toArrow()
    pilot, cells = {}, {}
    for dim in set(sample["dim"].to_pylist()):
        part = sample.filter(pa.compute.equal(sample["dim"], dim)).combine_chunks()
        drawn = _vectors(part["v"].combine_chunks())
        pilot[dim] = part["vec_id"].to_numpy(), part["label"].to_numpy(), drawn
        wanted = max(total // SHARD_ROWS, min(spark.sparkContext.defaultParallelism, total // LEAST_SHARD_ROWS)) * len(part) // len(sample)
        cells[dim] = Cells(drawn, min(wanted, CENTRE_BYTES // (8 * dim)))
    placed = ws.save(rows.mapInArrow(_place(share(cells)), "vec_id long, label long, dim int, v array<bigint>, cell int, far double"), "placed")
    balls = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).orderBy("dim", "cell").collect()  # one row for each cell
    layout, first, shards = {}, [], 0
    for dim in {r.dim for r in balls}:
        own = [r for r in balls if r.dim == dim]
        parts = np.array([-(-r.n // SHARD_ROWS) for r in own])
        starts = shards + np.cumsum(parts) - parts
        shards += int(parts.sum())
        centres = cells[dim].centres[[r.cell for r in own]] if dim in cells else None
        layout[dim] = [r.cell for r in own], starts, parts, np.array([r.radius for r in own]), centres
        first += [(dim, r.cell, int(s), int(p)) for r, s, p in zip(own, starts, parts)]
    if not shards:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    none = F.lit(None).cast("array<bigint>")
    shard = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("shard")
    dealt = F.broadcast(spark.createDataFrame(first, "dim int, cell int, first int, parts int"))
    own = placed.join(dealt, ["dim", "cell"]).select(shard, "dim", F.lit(0).alias("kind"), "vec_id", "label", "v", none.alias("tags"), none.alias("base"), none.alias("low"), none.alias("high"))
    plan, seen, tasks = share(layout), share(pilot), min(MAX_TASKS, shards)

    def search(queries: DataFrame, k: int, same: bool, tag: str) -> DataFrame:
        kinds = _STREAM.removeprefix("shard int, ")
        sent = queries.select(*_COLUMNS[1:]).mapInArrow(_raise_floors(seen, k, same), kinds).mapInArrow(_deal(plan), _STREAM)
        streams = own.union(sent).repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard", "dim", "kind")
        found = ws.save(streams.mapInArrow(_search(k, same), "anchor_id long, tag long, base long, vec_id long, score long"), f"found-{tag}")
        order = Window.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    anchors = placed.where(is_anchor).select("vec_id", "label", "dim", "v", F.lit(1).alias("kind"))
    whole = {"tags": 0, "base": 0, "low": -_OPEN, "high": _OPEN}
    best = search(anchors.withColumns({c: F.array(F.lit(x).cast("long")) for c, x in whole.items()}), positives, True, "positives")
    windows = best.select("anchor_id", F.struct(F.col("vec_id").alias("tag"), F.col("score").alias("base"), _percent(low, True).alias("low"), _percent(high, False).alias("high")).alias("w")).where("w.low <= w.high")
    windows = windows.groupBy("anchor_id").agg(F.collect_list("w").alias("w"))
    asked = anchors.join(windows, anchors["vec_id"] == windows["anchor_id"]).select("vec_id", "label", "dim", "v", "kind", F.col("w.tag").alias("tags"), F.col("w.base").alias("base"), F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    return search(asked, negatives, False, "negatives").select(
        "anchor_id", F.col("tag").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("base").alias("positive_score"), F.col("score").alias("negative_score")
    )

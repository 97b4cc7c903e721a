"""Exact nearest neighbours and kernel sums in few dimensions, by boxes of controls.

A kd-tree over some of the controls cuts space into boxes of about ``POINTS`` controls; it decides only who meets
where, never the result.  A treated row is searched in its own box first; the distance it finds there
bounds the rest, and it goes on only to those other boxes that reach into its ball.  Within a box a second kd-tree
does the same with leaves.  The bounds are computed by the same operations as the distances, so rounding
cannot hide a tie.  Vectors with null or non-finite entries take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import lines

POINTS, LEAF, GROUP, MATRIX = 1 << 14, 64, 256, 1 << 19
WIDE, LONG, MOST = 4, 1 << 21, 1 << 20  # with lines: least width of boxes in reaches, treated rows sent to a cell, and controls from which narrower boxes are cut
MOST_COLUMNS = 8
FIRST = 1 << 62


def gaps(lo: np.ndarray, hi: np.ndarray, to_lo: np.ndarray, to_hi: np.ndarray, metric: str) -> np.ndarray:
    """Least distance between boxes (rows of ``lo``, ``hi``; a point is a box) and others; infinite from empty ones (lo > hi)."""
    out = np.zeros((len(lo), len(to_lo)))
    for j in range(lo.shape[1]):
        g = np.maximum(np.maximum(to_lo[None, :, j] - hi[:, j, None], lo[:, j, None] - to_hi[None, :, j]), 0)
        out += g if metric == "manhattan" else g * g
    return out if metric == "manhattan" else np.sqrt(out)


def vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of an array column of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    if column.null_count:  # a null vector is one of nulls
        width = max((len(x) for x in column.to_pylist() if x is not None), default=0)
        return np.array([x if x is not None else [None] * width for x in column.to_pylist()], float).reshape(n, -1)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


class Splits:
    """A kd-tree: ``rows`` of each leaf and the least and greatest value of each node and column.  Nodes of up to ``most`` rows that are no wider than ``narrow`` stay whole."""

    def __init__(self, x: np.ndarray, size: int, band: float | None = None, narrow: float = 0.0, most: float = np.inf):
        self.dim, self.at, self.left, self.right, self.lo, self.hi, self.rows = [], [], [], [], [], [], []
        todo = [(np.arange(len(x)), -1, False)]
        while todo:
            rows, parent, is_right = todo.pop()
            me = len(self.dim)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = me
            some = x[rows]
            lo, hi = (some.min(0), some.max(0)) if len(rows) else (np.full(x.shape[1], np.inf), np.full(x.shape[1], -np.inf))
            for a, v in ((self.dim, -1), (self.at, 0.0), (self.left, -1), (self.right, -1), (self.lo, lo), (self.hi, hi), (self.rows, None)):
                a.append(v)
            if len(rows) <= size or not (hi - lo > (narrow if len(rows) <= most else 0)).any():
                self.rows[me] = rows
                continue
            wide = hi - lo
            # a band excludes, so it is cut first, until a node is about as narrow as the band
            j = len(wide) - 1 if band is not None and wide[-1] > 4 * band else int(np.argmax(wide if band is None or not wide[:-1].any() else wide[:-1]))
            v = some[:, j]
            at = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
            if at == hi[j]:
                at = v[v < hi[j]].max()
            go = v <= at
            self.dim[me], self.at[me] = j, at
            todo += [(rows[~go], me, True), (rows[go], me, False)]
        self.dim, self.at, self.left, self.right = np.array(self.dim), np.array(self.at), np.array(self.left), np.array(self.right)
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The node of the leaf that each row falls into."""
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.dim[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            at[inner] = np.where(x[inner, self.dim[node]] <= self.at[node], self.left[node], self.right[node])


def collapsed(x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of ids without equal points beyond the first ``k``: those are never among the nearest."""
    order = np.lexsort((ids, *x.T))
    x, ids = x[order], ids[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (x[1:] != x[:-1]).any(1)
    starts = np.flatnonzero(fresh)
    keep = np.arange(len(ids)) - starts[np.cumsum(fresh) - 1] < k if len(ids) else fresh
    x, ids = x[keep], ids[keep]
    order = np.argsort(ids, kind="stable")
    return x[order], ids[order]


def nearest_in(q: np.ndarray, bound: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, metric: str, caliper: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(distances, ids) of the ``k`` nearest controls within ``bound`` of each row, ties to the smaller id; infinite and ``FIRST`` where there are fewer.

    With a ``caliper`` the last column is the band: rows further apart there do not meet.
    """
    from .matching import distances

    n, p = len(q), q.shape[1] - (caliper is not None)
    best, who = np.full((n, k), np.inf), np.full((n, k), FIRST)
    if not n or not len(c):
        return best, who
    c, ids = collapsed(c, ids, k)
    tree = Splits(c, LEAF, caliper)

    def look(node: int, rows: np.ndarray) -> None:
        at = tree.rows[node]
        x, name = c[at], ids[at]
        for lo in range(0, len(rows), max(1, MATRIX // len(at))):
            r = rows[lo : lo + max(1, MATRIX // len(at))]
            d = distances(q[r, :p], x[:, :p], metric)
            if caliper is not None:
                d[np.abs(q[r, p, None] - x[None, :, p]) > caliper] = np.inf
            if k == 1:
                j = d.argmin(1)
                m, i = d[np.arange(len(r)), j], name[j]
                better = (m <= bound[r]) & np.isfinite(m) & ((m < best[r, 0]) | ((m == best[r, 0]) & (i < who[r, 0])))
                best[r[better], 0], who[r[better], 0] = m[better], i[better]
                continue
            some = np.flatnonzero(d.min(1) <= np.minimum(bound[r], best[r, -1]))
            r, d = r[some], d[some]
            d[d > bound[r, None]] = np.inf
            both = np.concatenate([best[r], d], 1)
            names = np.concatenate([who[r], np.where(np.isfinite(d), name[None, :], FIRST)], 1)
            order = np.lexsort((names, both), axis=1)[:, :k]
            best[r], who[r] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)

    home = tree.leaf(q)
    order = np.argsort(home, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
        look(int(home[rows[0]]), rows)
    todo = [(0, np.arange(n))]
    while todo:
        node, rows = todo.pop()
        near = gaps(q[rows, :p], q[rows, :p], tree.lo[node : node + 1, :p], tree.hi[node : node + 1, :p], metric)[:, 0] <= np.minimum(bound[rows], best[rows, -1])
        if caliper is not None:
            near &= np.maximum(tree.lo[node, p] - q[rows, p], q[rows, p] - tree.hi[node, p]) <= caliper
        rows = rows[near]
        if not len(rows):
            continue
        if tree.dim[node] < 0:
            rows = rows[home[rows] != node]
            if len(rows):
                look(node, rows)
        else:
            todo += [(int(tree.left[node]), rows), (int(tree.right[node]), rows)]
    return best, who


def near_blocks(q: np.ndarray, c: np.ndarray, radius: float, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of q, rows of c, distances) in blocks that hold every pair within ``radius``."""
    from .matching import distances

    if not len(q) or not len(c):
        return
    a, b = Splits(q, GROUP), Splits(c, GROUP)
    leaves = [i for i in range(len(b.dim)) if b.rows[i] is not None]
    lo, hi = b.lo[leaves], b.hi[leaves]
    for i in range(len(a.dim)):
        if a.rows[i] is None:
            continue
        near = np.flatnonzero(gaps(a.lo[i : i + 1], a.hi[i : i + 1], lo, hi, metric)[0] <= radius)
        if not len(near):
            continue
        at = np.concatenate([b.rows[leaves[j]] for j in near])
        for first in range(0, len(a.rows[i]), 4 * GROUP):  # a leaf of equal points may be long
            rows = a.rows[i][first : first + 4 * GROUP]
            step = max(1, MATRIX // len(rows))
            for s in range(0, len(at), step):
                yield rows, at[s : s + step], distances(q[rows], c[at[s : s + step]], metric)


@dataclass
class Placed:
    """Boxes and where rows go: a box with many treated rows has several cells, each with all its controls."""

    splits: Splits
    box_of: np.ndarray  # by node
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray  # cell numbers by box, and their end
    treated: Placed | None = None  # where it is less to send controls to the boxes of treated rows: the same boxes with the bounds of those

    @property
    def single(self) -> bool:
        """Whether each box is one cell."""
        return len(self.first) == len(self.lo) + 1 and self.first[-1] == len(self.lo)

    def cells(self, box: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.first[box] + ids % (self.first[box + 1] - self.first[box])


@dataclass
class BoxBackend:
    """Exact search and sums in up to ``MOST_COLUMNS`` columns.  With ``caliper`` the last entry of a vector is a band and no part of the distance."""

    metric: str = "euclidean"
    inverse: np.ndarray | None = None
    caliper: float | None = None
    points: int | None = None

    @staticmethod
    def fits(metric: str | Callable, columns: int) -> bool:
        return metric in ("euclidean", "manhattan", "mahalanobis", "cosine") and columns <= MOST_COLUMNS

    def coordinates(self, v: np.ndarray, treated: bool) -> np.ndarray:
        """Vectors whose Euclidean (Manhattan) distance gives the metric's order."""
        if self.metric == "mahalanobis":
            return v @ np.linalg.cholesky(self.inverse)
        if self.metric == "cosine":
            # a zero vector is at distance 1 from everything: at right angles to all others
            norm = np.linalg.norm(v, axis=1)[:, None]
            flat = (norm == 0).astype(float)
            unit = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
            return np.concatenate([unit, flat if treated else 0 * flat, 0 * flat if treated else flat], 1)
        return v

    @property
    def plain(self) -> str:
        return "manhattan" if self.metric == "manhattan" else "euclidean"

    def _within(self, limit: float | None) -> float:
        """A radius in the metric as one in coordinates (a little wider for cosines, which are compared again)."""
        if limit is None:
            return np.inf
        return float(np.sqrt(2 * max(limit, 0)) * (1 + 1e-9) + 1e-12) if self.metric == "cosine" else float(limit)

    def _given(self, d: np.ndarray) -> np.ndarray:
        return d * d / 2 if self.metric == "cosine" else d

    def _sides(self, treated: DataFrame, control: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(id, x array) of the rows that take part, written once."""

        def side(df: DataFrame, which: bool) -> DataFrame:
            def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    v = vectors(batch.column(1))
                    if v.size:
                        good = np.isfinite(v).all(1)
                        x = self.coordinates(v[good], which)
                        yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[good]), lists(x.ravel(), np.full(len(x), x.shape[1]))], names=["id", "x"])

            return cut(df.select("id", "v").mapInArrow(work, "id long, x array<double>"))

        return side(treated, True), side(control, False)

    def _placed(self, treated: DataFrame, control: DataFrame, reach: float = 0.0, kernel: str | None = None) -> Placed:
        """Boxes of about ``points`` controls.  Where sums of ``kernel`` go along lines, whose work hardly grows with a box, they are not
        cut below ``WIDE`` reaches while they hold up to ``MOST`` controls: else the boxes that a row is sent to would grow in number with the rows."""
        n, points = control.count(), self.points or POINTS
        some = control.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // 50_000))) == 0).select("x").toArrow()
        if not len(some):
            some = control.select("x").limit(1).toArrow()
        x = vectors(some.column(0))
        along = kernel is not None and lines.axis(x, x, kernel, n / len(x)) is not None
        splits = Splits(x, max(1, -(-len(x) * points // max(1, n))), self.caliper, 2 * WIDE * reach if along else 0.0, MOST * len(x) / max(1, n))
        leaves = np.array([i for i in range(len(splits.dim)) if splits.rows[i] is not None], np.int64)
        splits.rows = None
        box_of = np.full(len(splits.dim), -1)
        box_of[leaves] = np.arange(len(leaves))
        width = x.shape[1]
        box = self._boxed(splits, box_of)

        def bounds(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            n, lo, hi = np.zeros(len(leaves), np.int64), np.full((len(leaves), width), np.inf), np.full((len(leaves), width), -np.inf)
            ends = (f(F.get("x", F.lit(j))).alias(f"{name}{j}") for j in range(width) for name, f in (("lo", F.min), ("hi", F.max)))
            for r in box(df).groupBy("box").agg(F.count(F.lit(1)).alias("n"), *ends).collect():
                n[r.box] = r.n
                lo[r.box], hi[r.box] = ([r[f"{name}{j}"] for j in range(width)] for name in ("lo", "hi"))
            return n, lo, hi

        (_, lo, hi), (many, *theirs) = bounds(control), bounds(treated)
        placed = Placed(splits, box_of, lo, hi, np.arange(len(leaves) + 1))
        some = x[:: max(1, len(x) // 2048)]
        copies = self._touched(placed, some, np.full(len(some), reach)).sum(1).mean() if along else 1.0
        parts = np.maximum(1, np.ceil(many * copies / (LONG if along else 2 * points))).astype(np.int64)
        placed.first = np.concatenate([[0], np.cumsum(parts)])
        if along and placed.single and n <= 2 * many.sum():
            placed.treated = replace(placed, lo=theirs[0], hi=theirs[1])
        return placed

    @staticmethod
    def _boxed(splits: Splits, box_of: np.ndarray) -> Callable[[DataFrame], DataFrame]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    box = box_of[splits.leaf(vectors(batch.column(1)))]
                    yield pa.RecordBatch.from_arrays([pa.array(box.astype(np.int32)), batch.column(1)], names=["box", "x"])

        return lambda df: df.select("id", "x").mapInArrow(work, "box int, x array<double>")

    @staticmethod
    def _controls(control: DataFrame, placed: Placed) -> DataFrame:
        """(cell, id, x): each control in all cells of its box (or each treated row, where boxes are single cells)."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    box = placed.box_of[placed.splits.leaf(vectors(batch.column(1)))]
                    times = placed.first[box + 1] - placed.first[box]
                    row = np.repeat(np.arange(len(box)), times)
                    cell = placed.first[box][row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), *(batch.column(i).take(pa.array(row)) for i in (0, 1))], names=["cell", "id", "x"])

        return control.mapInArrow(work, "cell long, id long, x array<double>")

    def _touched(self, placed: Placed, x: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Rows x boxes: whether the box may hold something within ``bound``."""
        p = x.shape[1] - (self.caliper is not None)
        gap = gaps(x[:, :p], x[:, :p], placed.lo[:, :p], placed.hi[:, :p], self.plain)
        out = (gap <= bound[:, None]) & np.isfinite(gap)
        if self.caliper is not None:
            out &= np.maximum(placed.lo[None, :, p] - x[:, p, None], x[:, p, None] - placed.hi[None, :, p]) <= self.caliper
        return out

    def _sent(self, treated: DataFrame, placed: Placed, radius: float, more: tuple[str, ...] = ()) -> DataFrame:
        """(cell, id, x, ...): each treated row to one cell of every box within ``radius``."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, len(whole), 2048):
                    batch = whole.slice(lo, 2048)
                    x, ids = vectors(batch.column(1)), batch.column(0).to_numpy()
                    row, box = np.nonzero(self._touched(placed, x, np.full(len(x), radius)))
                    yield pa.RecordBatch.from_arrays([pa.array(placed.cells(box, ids[row])), *(batch.column(i).take(pa.array(row)) for i in range(2 + len(more)))], names=["cell", "id", "x", *more])

        return treated.select("id", "x", *more).mapInArrow(work, "cell long, id long, x array<double>" + "".join(f", {m} double" for m in more))

    def nearest_lists(self, treated: DataFrame, control: DataFrame, k: int, radius: float | None = None) -> DataFrame:
        """(treated, near array<struct<d, control>>): the ``k`` nearest of each treated row that has any, nearest first."""
        limit = self._within(radius)
        treated, control = self._sides(treated, control)
        if control.isEmpty():
            return treated.limit(0).select(F.col("id").alias("treated"), F.array(F.struct(F.lit(0.0).alias("d"), F.lit(0).cast("long").alias("control"))).alias("near"))
        placed = self._placed(treated, control)
        metric, caliper = self.plain, self.caliper
        controls = self._controls(control, placed)

        def found(best: np.ndarray, who: np.ndarray) -> tuple[pa.Array, pa.Array]:
            d = self._given(best)
            good = np.isfinite(best) if radius is None else np.isfinite(best) & (d <= radius)
            return lists(who[good], good.sum(1)), lists(d[good], good.sum(1))

        def own(key, t: pa.Table, c: pa.Table) -> pa.Table:
            x, ids = vectors(t.column("x")), t.column("id").to_numpy()
            if not len(ids):
                return pa.table({"treated": pa.array([], pa.int64()), "x": pa.array([], pa.list_(pa.float64())), "bound": pa.array([], pa.float64()), "control": pa.array([], pa.list_(pa.int64())), "d": pa.array([], pa.list_(pa.float64())), "more": pa.array([], pa.list_(pa.int64()))})
            best, who = nearest_in(x, np.full(len(x), limit), vectors(c.column("x")), c.column("id").to_numpy(), k, metric, caliper)
            bound = np.minimum(best[:, -1], limit)
            here = int(np.searchsorted(placed.first, key[0].as_py(), "right")) - 1
            sizes, boxes = np.zeros(len(x), np.int64), []
            for lo in range(0, len(x), 2048):
                touched = self._touched(placed, x[lo : lo + 2048], bound[lo : lo + 2048])
                touched[:, here] = False
                sizes[lo : lo + 2048] = touched.sum(1)
                boxes.append(np.nonzero(touched)[1])
            near, d = found(best, who)
            on = sizes > 0
            return pa.table({"treated": pa.array(ids), "x": lists(x[on].ravel(), on * x.shape[1]), "bound": pa.array(bound), "control": near, "d": d, "more": lists(np.concatenate(boxes).astype(np.int64), sizes)})

        def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    ids, box = batch.column(0).to_numpy(), placed.box_of[placed.splits.leaf(vectors(batch.column(1)))]
                    yield pa.RecordBatch.from_arrays([pa.array(placed.cells(box, ids)), batch.column(0), batch.column(1)], names=["cell", "id", "x"])

        def other(t: pa.Table, c: pa.Table) -> pa.Table:
            x = vectors(t.column("x"))
            if not len(x):
                return pa.table({"treated": pa.array([], pa.int64()), "control": pa.array([], pa.list_(pa.int64())), "d": pa.array([], pa.list_(pa.float64()))})
            near, d = found(*nearest_in(x, t.column("bound").to_numpy(), vectors(c.column("x")), c.column("id").to_numpy(), k, metric, caliper))
            return pa.table({"treated": t.column("id"), "control": near, "d": d})

        def cell_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    cell = placed.cells(batch.column(3).to_numpy(), batch.column(0).to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array(cell), *batch.columns[:3]], names=["cell", "id", "x", "bound"])

        homes = treated.mapInArrow(home, "cell long, id long, x array<double>")
        first = cut(homes.groupBy("cell").cogroup(controls.groupBy("cell")).applyInArrow(own, "treated long, x array<double>, bound double, control array<long>, d array<double>, more array<long>"))
        zipped = F.arrays_zip("d", "control").alias("near")
        done = first.where("size(more) = 0 and size(control) > 0").select("treated", zipped)
        open_ = first.where("size(more) > 0")
        asked = open_.select(F.col("treated").alias("id"), "x", "bound", F.explode("more").alias("box")).mapInArrow(cell_of, "cell long, id long, x array<double>, bound double")
        answers = asked.groupBy("cell").cogroup(controls.groupBy("cell")).applyInArrow(other, "treated long, control array<long>, d array<double>")
        both = open_.select("treated", zipped).unionByName(answers.where("size(control) > 0").select("treated", zipped))
        merged = both.groupBy("treated").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near")).where("size(near) > 0")
        return done.unionByName(merged)

    def neighbors(self, treated: DataFrame, control: DataFrame, k: int | None = None, radius: float | None = None) -> DataFrame:
        if k is not None:
            return self.nearest_lists(treated, control, k, radius).select("treated", F.explode("near").alias("n")).select("treated", "n.control", "n.d")

        def work(t: pa.Table, c: pa.Table) -> pa.Table:
            ids, names = t.column("id").to_numpy(), c.column("id").to_numpy()
            x, y = vectors(t.column("x")), vectors(c.column("x"))
            p = x.shape[1] - (self.caliper is not None)
            out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
            for rows, at, d in near_blocks(x[:, :p], y[:, :p], limit, self.plain):
                d = self._given(d)
                keep = np.isfinite(d) if radius is None else d <= radius
                if self.caliper is not None:
                    keep &= np.abs(x[rows, p, None] - y[None, at, p]) <= self.caliper
                i, j = np.nonzero(keep)
                for a, v in zip(out, (ids[rows[i]], names[at[j]], d[i, j]), strict=True):
                    a.append(v)
            return pa.table(dict(zip(("treated", "control", "d"), map(np.concatenate, out), strict=True)))

        limit = self._within(radius)
        treated, control = self._sides(treated, control)
        if control.isEmpty():
            return treated.limit(0).select(F.col("id").alias("treated"), F.col("id").alias("control"), F.lit(0.0).alias("d"))
        placed = self._placed(treated, control)
        return self._sent(treated, placed, limit).groupBy("cell").cogroup(self._controls(control, placed).groupBy("cell")).applyInArrow(work, "treated long, control long, d double")

    def sums(self, treated: DataFrame, control: DataFrame, weigh: Callable[[np.ndarray], np.ndarray], reach: float, form: tuple[str, float] | None = None) -> DataFrame:
        """(id, x, s): the sum of ``weigh`` of the distances from each treated row to all controls; ``weigh`` is 0 beyond ``reach``.  Both sides (id, x).

        With the ``form`` (kernel, bandwidth) of ``weigh``, sums go by ``lines`` where that is less work.
        """
        limit, placed = self._spread(treated, control, reach, form)
        if placed.treated is None:
            found = self._pairs(self._sent(treated, placed, limit), self._controls(control, placed).drop("id"), limit, weigh, False, form)
            return treated.join(found.groupBy("id").agg(F.sum("w").alias("s")), "id")
        # each treated row stays in one cell, so that its sum is whole and it takes its vector along
        home, sent = self._controls(treated, placed), self._sent(control, placed.treated, limit).drop("id")
        return self._pairs(home, sent, limit, weigh, False, form, True).withColumnRenamed("w", "s")

    def shares(self, treated: DataFrame, control: DataFrame, weigh: Callable[[np.ndarray], np.ndarray], reach: float, form: tuple[str, float] | None = None) -> DataFrame:
        """(id, w): for each control the sum of ``weigh`` over the treated rows (id, x, s), each divided by its ``s``."""
        limit, placed = self._spread(treated, control, reach, form)
        found = self._pairs(self._sent(treated, placed, limit, ("s",)).drop("id"), self._controls(control, placed), limit, weigh, True, form)
        return found if placed.single else found.groupBy("id").agg(F.sum("w").alias("w"))

    def _spread(self, treated: DataFrame, control: DataFrame, reach: float, form: tuple[str, float] | None) -> tuple[float, Placed]:
        limit = self._within(reach)
        return limit, self._placed(treated, control, limit, form[0] if form and self.metric == "euclidean" else None)

    def _pairs(self, treated: DataFrame, control: DataFrame, limit: float, weigh: Callable[[np.ndarray], np.ndarray], by_control: bool, form: tuple[str, float] | None, whole: bool = False) -> DataFrame:
        """(id, w) of each cell's controls or treated rows, with their vectors if ``whole``; only that side needs ids."""
        form = form if self.metric == "euclidean" else None

        def pairs(to: np.ndarray, of: np.ndarray, charge: np.ndarray) -> np.ndarray:
            out = np.zeros(len(to))
            for rows, at, d in near_blocks(to, of, limit, self.plain):
                out[rows] += weigh(self._given(d)) @ charge[at]
            return out

        def work(t: pa.Table, c: pa.Table) -> pa.Table:
            side, other = (c, t) if by_control else (t, c)
            to, of = vectors(side.column("x")), vectors(other.column("x"))
            charge = 1 / t.column("s").to_numpy() if by_control else np.ones(len(of))
            j = lines.axis(to, of, form[0]) if form else None
            if j is None:
                out = pairs(to, of, charge)
            else:
                heavy = charge > lines.HEAVY
                out = lines.sums(to, of[~heavy], charge[~heavy], j, *form, weigh, limit)
                small = np.isnan(out)
                out[small] = pairs(to[small], of[~heavy], charge[~heavy])
                if heavy.any():
                    out += pairs(to, of[heavy], charge[heavy])
            return side.select(["id", "x"] if whole else ["id"]).append_column("w", pa.array(out))

        schema = "id long, x array<double>, w double" if whole else "id long, w double"
        return treated.groupBy("cell").cogroup(control.groupBy("cell")).applyInArrow(work, schema)

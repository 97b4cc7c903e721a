"""Approximate nearest neighbours along shifted space-filling curves.

Vectors are projected, put on a grid and in order along several Hilbert curves.  Each curve is
range-partitioned into cells of equally many vectors; a query visits the cells of its key window on
every curve, each visit gives its nearest vectors there by exact distance, and the visits of a
query are merged and ranked again.  Nothing but ``boundaries`` (at most ``MOST_CELLS`` for a
curve), grid lines and the vectors' mean and spread reaches the driver.

Grid lines lie at shifted quantiles of each projection (of a hashed sample of vectors; all vectors are put on the
grid), so any group of vectors spans its share of the lines, however tight it is.  Vectors that even
this leaves at one place of the curve are in an order of their own on each curve; if they outgrow the window, a query
among them visits all of their cells on the first curve.

The window is a share of all rows, so that recall stays put as the table grows: vectors without
any low-dimensional structure need wide windows (see the README for measured recall).  A larger cell is split by a
hash of the vectors, and many queries of one cell by a hash of the queries, so a group is bounded.

Defined cases: rows with a null id take no part, nor do vectors that are null, zero, of another length than most, or hold null or
non-finite components.  Equal vectors are searched once; their ``k + 1`` smallest ids stand for them, which is
all that a list of ``k`` can show.  Rows repeating an id and a vector are one row.  Ties go to the smaller
id.  Other columns are ignored.  Without queries or candidates there are no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

CURVES, DIMS, BITS, TIE_BITS = 16, 8, 6, 15
WINDOW_SHARE, CELL_ROWS, MOST_CELLS = 0.08, 1024, 4096
GROUP_ROWS, GROUP_QUERIES = 8192, 4096
# Rows that grid lines are drawn from, and the part of the spread below which rounding blurs projections.
LINE_ROWS, BLUR = 16384, 2.0**-40


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place along a Hilbert curve of each row of whole numbers below ``2**bits``."""
    axes = [grid[:, i].astype(np.uint64) for i in range(grid.shape[1])]
    one = np.uint64(1)
    # Undo, from the coarsest bit down, the reflections and exchanges of axes that the curve makes in each sub-cube.
    for bit in range(bits - 1, 0, -1):
        low = np.uint64((1 << bit) - 1)
        for i, axis in enumerate(axes):
            flip = (axis >> np.uint64(bit)) & one == one
            change = (axes[0] ^ axis) & low
            axes[0], axes[i] = np.where(flip, axes[0] ^ low, axes[0] ^ change), np.where(flip, axes[i], axes[i] ^ change)
            if i == 0:
                axes[0] = np.where(flip, axis ^ low, axis)
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(grid), np.uint64)
    for bit in range(bits - 1, 0, -1):
        turn = np.where((axes[-1] >> np.uint64(bit)) & one == one, turn ^ np.uint64((1 << bit) - 1), turn)
    axes = [a ^ turn for a in axes]
    key = np.zeros(len(grid), np.uint64)
    for bit in range(bits - 1, -1, -1):
        for a in axes:
            key = (key << one) | ((a >> np.uint64(bit)) & one)
    return key


class Curves:
    """Projection, grid and key of each curve, fixed by the seed, the vectors' mean and spread and (in ``lines``) their quantiles."""

    def __init__(self, mean: np.ndarray, spread: float, curves: int, dims: int, seed: int):
        rng = np.random.default_rng(seed)
        n = len(mean)
        self.dims = min(dims, n)
        self.mean, self.spread = mean, spread or 1.0
        self.turns = [np.linalg.qr(rng.normal(size=(n, n)))[0][:, : self.dims] for _ in range(curves)]
        self.shifts = rng.uniform(0, 1, (curves, self.dims))
        self.lines: dict[int, np.ndarray] = {}

    def project(self, x: np.ndarray, curve: int) -> np.ndarray:
        return np.rint((x - self.mean) @ self.turns[curve] / self.spread / BLUR)

    def grid_lines(self, y: np.ndarray, curve: int) -> np.ndarray:
        """For each dimension the ``2**BITS - 1`` values that part projections ``y`` into about equally many."""
        at = (np.arange((1 << BITS) - 1)[:, None] + self.shifts[curve]) / (1 << BITS) * len(y)
        return np.take_along_axis(np.sort(y, axis=0), at.astype(np.int64), axis=0).T

    def keys(self, x: np.ndarray, curve: int, ties: np.ndarray) -> np.ndarray:
        y = self.project(x, curve)
        grid = np.stack([np.searchsorted(line, y[:, i], "left") for i, line in enumerate(self.lines[curve])], axis=1)
        ties = C.mix(ties + np.uint64(curve))
        return ((hilbert_keys(grid, BITS) << np.uint64(TIE_BITS)) | (ties & np.uint64((1 << TIE_BITS) - 1))).astype(np.int64)


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vec): the vectors that take part, as bytes of doubles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count or not len(v.values):
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    found = rows.select(F.col(id_col).cast("long"), F.col(vector_col)).mapInArrow(C.tidied(work), "vec_id long, vec binary")
    found = C.cut(found.withColumn("size", F.length("vec")))
    most = found.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    return found.where(F.col("size") == (most["size"] if most else -1)).drop("size")


def matrix(column) -> np.ndarray:
    n = len(column)
    return C.unpack(column, np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _statistics(unique: DataFrame, size: int) -> tuple[np.ndarray, float]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(size), np.zeros(size)
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(np.full(size, n)), pa.array(s), pa.array(q)], names=["i", "n", "s", "q"])

    rows = unique.select("vec").mapInArrow(C.tidied(work), "i long, n long, s double, q double").groupBy("i").agg(*(F.sum(c).alias(c) for c in "nsq")).orderBy("i").collect()
    n = max(1, rows[0].n)
    mean = np.array([r.s for r in rows]) / n
    return mean, float(np.sqrt(max(0.0, np.mean([r.q / n for r in rows] - mean**2))))


def _draw_lines(unique: DataFrame, n: int, plan: Curves, curves: int) -> None:
    """Fills ``plan.lines`` from about ``LINE_ROWS`` vectors, chosen by hash."""
    sent = unique.sparkSession.sparkContext.broadcast(plan)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0))
            for c in range(curves) if len(x) else ():
                y = sent.value.project(x, c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array([r.tobytes() for r in y], pa.binary())], names=["curve", "y"])

    def lines(table: pa.Table) -> pa.Table:
        c = table.column("curve")[0].as_py()
        found = sent.value.grid_lines(C.unpack(table.column("y"), np.float64).reshape(len(table), -1), c)
        return pa.table({"curve": pa.array([c], pa.int32()), "lines": pa.array([found.tobytes()], pa.binary())})

    some = unique.select("vec")
    if n > LINE_ROWS:
        some = some.where(F.pmod(F.xxhash64("vec"), F.lit(n)) < LINE_ROWS)
    for row in some.mapInArrow(C.tidied(work), "curve int, y binary").groupBy("curve").applyInArrow(lines, "curve int, lines binary").collect():
        plan.lines[row["curve"]] = np.frombuffer(row["lines"], np.float64).reshape(plan.dims, -1)


def nearest_neighbours(rows: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = CURVES, window_share: float = WINDOW_SHARE, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row that meets ``queries`` (a condition on ``vec_id``)."""
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    vectors = valid_vectors(rows, id_col, vector_col).distinct()
    by_vector = Window.partitionBy("vec").orderBy("vec_id")
    unique = vectors.withColumn("at", F.row_number().over(by_vector)).where(F.col("at") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    unique = C.cut(unique)
    n = unique.count()
    if n == 0:
        return spark.createDataFrame([], schema)
    asked = C.cut(vectors.where(queries))
    n_asked = asked.count()
    size = len(unique.first()["vec"]) // 8
    mean, spread = _statistics(unique, size)
    plan = Curves(mean, spread, curves, DIMS, seed)
    _draw_lines(unique, n, plan, curves)
    cells = min(max(1, -(-n // CELL_ROWS)), MOST_CELLS)
    half = math.ceil(window_share * cells / 2) if cells > 1 else 0
    row_parts = max(1, -(-n // (cells * GROUP_ROWS)))
    sent = spark.sparkContext.broadcast(plan)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0))
            ties = C.mix(x.view(np.uint64).sum(1, dtype=np.uint64))
            for c in range(curves):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(sent.value.keys(x, c, ties))], names=["curve", "key"])

    shares = [i / cells for i in range(1, cells)]
    edges: dict[int, np.ndarray] = {c: np.zeros(0, np.int64) for c in range(curves)}
    if shares:
        keys = unique.select("vec").mapInArrow(C.tidied(keyed), "curve int, key long")
        for row in keys.groupBy("curve").agg(F.percentile_approx("key", shares, 20 * cells).alias("at")).collect():
            edges[row.curve] = np.array(row["at"], np.int64)
    cuts = spark.sparkContext.broadcast(edges)
    # Where one place of the first curve outgrows the window, a cell may be visited by all queries.
    hot = len(edges[0]) > 0 and bool(np.unique(edges[0] >> TIE_BITS, return_counts=True)[1].max() > half)
    query_parts = max(1, -(-n_asked * (cells if hot else 2 * half + 1) // (cells * GROUP_QUERIES)))

    def dealt(visits: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(1))
                raw = C.mix(x.view(np.uint64).sum(1, dtype=np.uint64)) if len(x) else np.zeros(0, np.uint64)
                for c in range(curves):
                    key = sent.value.keys(x, c, raw) if len(x) else np.zeros(0, np.int64)
                    cell = np.searchsorted(cuts.value[c], key, "left")
                    low, high = cell - half, cell + half
                    if c == 0:
                        low = np.minimum(low, np.searchsorted(cuts.value[c], key >> TIE_BITS << TIE_BITS, "left"))
                        high = np.maximum(high, np.searchsorted(cuts.value[c], key | ((1 << TIE_BITS) - 1), "left"))
                    part = (C.mix(raw + np.uint64(c)) % np.uint64(query_parts if visits else row_parts)).astype(np.int64)
                    for step in range((low - cell).min(initial=0), (high - cell).max(initial=0) + 1) if visits else (0,):
                        ok = np.flatnonzero((cell + step >= np.maximum(low, 0)) & (cell + step <= np.minimum(high, cells - 1)))
                        for other in range(row_parts if visits else query_parts):
                            group = (c * cells + cell[ok] + step) * row_parts * query_parts
                            group += (other * query_parts + part[ok]) if visits else (part[ok] * query_parts + other)
                            at = pa.array(ok)
                            yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], names=["grp", "ids", "vec"])

        return work

    left = unique.select("ids", "vec").mapInArrow(dealt(False), "grp long, ids array<long>, vec binary")
    right = asked.select("vec_id", "vec").mapInArrow(dealt(True), "grp long, ids long, vec binary")

    def search(have: pa.Table, want: pa.Table) -> pa.Table:
        out_q, out_v, out_d = [], [], []
        if len(have) and len(want):
            x, q = matrix(have.column("vec")), matrix(want.column("vec"))
            ids, own = have.column("ids").to_pylist(), want.column("ids").to_pylist()
            step = max(1, (1 << 22) // (x.size or 1))
            for lo in range(0, len(q), step):
                diff = q[lo : lo + step, None, :] - x[None, :, :]
                d = np.sqrt((diff * diff).sum(-1))
                near = np.argpartition(d, min(k, len(x) - 1), axis=1)[:, : k + 1]
                for i, row in enumerate(near):
                    far = d[i, row].max()
                    # all vectors as near as the (k+1)-th, so that ties are settled by id
                    some = np.flatnonzero(d[i] <= far)
                    me = own[lo + i]
                    best = sorted((float(d[i, j]), v) for j in some.tolist() for v in ids[j] if v != me)[:k]
                    out_q += [me] * len(best)
                    out_d += [b[0] for b in best]
                    out_v += [b[1] for b in best]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_d, pa.float64())})

    found = left.groupBy("grp").cogroup(right.groupBy("grp")).applyInArrow(search, "query_id long, vec_id long, score double")
    merged = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")

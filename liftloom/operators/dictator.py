"""Matching without replacement by cells of space: no candidate edge becomes a row.

Treated rows in the order of ids each take their nearest unused controls.  Rows that may meet lie in cells next to each other, as wide as the
caliper; connected cells are one task's work, which holds their rows, not their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boxes import BoxBackend, vectors
from .components import components

CELL_COLUMNS = 3
FURTHEST = 10**12  # cells beyond are one: further out rounding could part rows that meet


def cell_widths(backend: BoxBackend, columns: int, radius: float | None) -> list[tuple[int, float]]:
    """(column, width) of the cells: rows that meet are in the same or in adjoining cells of each column."""
    plain = columns - (backend.caliper is not None)
    found = [(plain, backend.caliper)] if backend.caliper is not None else []
    if radius is not None:
        found += [(j, backend._within(radius)) for j in range(plain)]
    return [(j, w * 1.001) for j, w in found if w > 0][:CELL_COLUMNS]


def linked(treated: DataFrame, control: DataFrame, widths: list[tuple[int, float]]) -> tuple[DataFrame, DataFrame]:
    """Both sides (id, x) with the ``component`` of their cell; rows that meet nobody's cell are left out."""
    if not widths:
        return tuple(df.withColumn("component", F.lit(0).cast("long")) for df in (treated, control))

    def cell(j: int, w: float) -> Column:
        return F.greatest(F.lit(-FURTHEST), F.least(F.lit(FURTHEST), F.floor(F.get("x", F.lit(j)) / F.lit(w)).cast("long")))

    names = [f"c{i}" for i in range(len(widths))]
    a, b = (df.withColumns({n: cell(*w) for n, w in zip(names, widths, strict=True)}) for df in (treated, control))
    # a node is a hash of side and cell; equal hashes only join components
    node = lambda side: F.xxhash64(F.lit(side), *names)
    near = a.select(*names).distinct().withColumn("a", node(1))
    for n in names:
        near = near.withColumn(n, F.explode(F.array(F.col(n) - 1, F.col(n), F.col(n) + 1)))
    pairs = near.join(b.select(*names).distinct(), names).select("a", node(0).alias("b"))
    label = components(pairs)
    return tuple(df.withColumn("node", node(side)).join(label, "node").select("id", "x", F.col("component").alias("component")) for df, side in ((a, 1), (b, 0)))


def ranges(x: np.ndarray, y: np.ndarray, widths: list[tuple[int, float]]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(order of the controls, first and last places): for each treated row stretches of the ordered controls that hold all it may meet."""
    if not widths:
        return np.arange(len(y)), [np.zeros(len(x), np.int64)], [np.full(len(x), len(y))]
    last, w = widths[-1]
    cells = [np.clip(np.floor(np.concatenate([x[:, j], y[:, j]]) / v), -FURTHEST, FURTHEST).astype(np.int64) for j, v in widths[:-1]]
    offsets = np.stack(np.meshgrid(*[[-1, 0, 1]] * len(cells), indexing="ij"), -1).reshape(-1, len(cells)) if cells else np.zeros((1, 0), np.int64)
    n, key = len(x), np.stack(cells, 1) if cells else np.zeros((len(x) + len(y), 0), np.int64)
    at = np.lexsort((y[:, last], *key[n:].T[::-1]))
    keys = key[n:][at]
    cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1 if len(keys) else np.zeros(0, np.int64)
    bounds = np.concatenate([[0], cuts, [len(keys)]])
    groups = {tuple(keys[lo]): (lo, hi) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) if hi > lo}
    values, first, end = y[at, last], [], []
    mine = np.lexsort(key[:n].T) if key.shape[1] else np.arange(n)
    parts = np.split(mine, np.flatnonzero((key[mine][1:] != key[mine][:-1]).any(1)) + 1) if n else []
    for off in offsets:
        lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for rows in parts:
            some = groups.get(tuple(key[rows[0]] + off))
            if some is not None:
                v = values[some[0] : some[1]]
                lo[rows] = some[0] + np.searchsorted(v, x[rows, last] - w, "left")
                hi[rows] = some[0] + np.searchsorted(v, x[rows, last] + w, "right")
        first.append(lo)
        end.append(hi)
    return at, first, end


def take(x: np.ndarray, y: np.ndarray, names: np.ndarray, k: int, backend: BoxBackend, radius: float | None, widths: list[tuple[int, float]]) -> Iterator[tuple[int, int, float]]:
    """(treated row, control row, distance): each treated row in turn takes its ``k`` nearest unused controls, ties to the smaller name."""
    from .matching import distances

    p, done, left = x.shape[1] - (backend.caliper is not None), 0, np.arange(len(y))
    while done < len(x) and len(left):
        # controls in use are dropped whenever they are half of all
        order, first, end = ranges(x[done:], y[left], widths)
        order = left[order]
        at, called, free, used, start = y[order], names[order], np.ones(len(order), bool), 0, done
        first, end = np.stack(first, 1).tolist(), np.stack(end, 1).tolist()
        while done < len(x) and 2 * used <= len(order):
            i = done - start
            stretches = [lo + np.flatnonzero(free[lo:hi]) for lo, hi in zip(first[i], end[i], strict=True) if hi > lo]
            near = stretches[0] if len(stretches) == 1 else np.concatenate(stretches) if stretches else ()
            if len(near):
                c = at[near]
                d = backend._given(distances(x[done : done + 1, :p], c[:, :p], backend.plain)[0])
                if backend.caliper is not None:
                    d = np.where(np.abs(c[:, p] - x[done, p]) <= backend.caliper, d, np.inf)
                best = np.lexsort((called[near], d))[:k] if k > 1 else near_one(d, called[near])
                for j in best:
                    if d[j] <= (np.inf if radius is None else radius) and np.isfinite(d[j]):
                        free[near[j]] = False
                        used += 1
                        yield done, int(order[near[j]]), float(d[j])
            done += 1
        left = np.sort(order[free])


def near_one(d: np.ndarray, names: np.ndarray) -> np.ndarray:
    same = np.flatnonzero(d == d.min())
    return same if len(same) == 1 else same[[names[same].argmin()]]


def in_turn(backend: BoxBackend, treated: DataFrame, control: DataFrame, k: int, radius: float | None) -> DataFrame:
    """Edges (treated, control, d) without replacement from frames (id, v)."""
    treated, control = backend._sides(treated, control)
    row = treated.select(F.size("x")).first()
    widths = cell_widths(backend, row[0], radius) if row else []

    def match(t: pa.Table, c: pa.Table) -> pa.Table:
        t, c = t.sort_by("id"), c.sort_by("id")
        ids, names = t.column("id").to_numpy(), c.column("id").to_numpy()
        found = list(take(vectors(t.column("x")), vectors(c.column("x")), names, k, backend, radius, widths)) if len(ids) and len(names) else []
        i, j, d = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"treated": pa.array(ids[list(i)], pa.int64()), "control": pa.array(names[list(j)], pa.int64()), "d": pa.array(d, pa.float64())})

    a, b = linked(treated, control, widths)
    return a.groupBy("component").cogroup(b.groupBy("component")).applyInArrow(match, "treated long, control long, d double")

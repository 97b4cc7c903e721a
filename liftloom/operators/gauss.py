"""Sums of a Gaussian kernel over all pairs in time linear in the rows.

Space is cut into cells as wide as the bandwidth.  Within a cell the kernel is a polynomial through ``NODES`` Chebyshev nodes a
column, exact to about 1e-16 of its peak, so rows become charges at the nodes of their cell, the kernel is
applied between nodes column by column, and rows read the polynomial of their cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boxes import vectors

NODES, MOST_NODES, CHUNK = 16, 1 << 20, 1 << 13
_AT = 0.5 * np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
_BELOW = np.array([np.prod([a - b for b in _AT if b != a]) for a in _AT])


@dataclass
class Grid:
    low: np.ndarray
    h: float
    cells: np.ndarray

    @classmethod
    def over(cls, low: np.ndarray, high: np.ndarray, h: float) -> Grid | None:
        """The grid over a range, or None where it would have more than ``MOST_NODES`` nodes."""
        cells = np.maximum(1, np.ceil((high - low) / h))
        if not np.isfinite(cells).all() or np.prod(cells * NODES) > MOST_NODES:
            return None
        return cls(low, h, cells.astype(np.int64))

    def _basis(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(cell, Lagrange polynomials by column) of each row."""
        cell, out = np.zeros(len(x), np.int64), []
        for j in range(x.shape[1]):
            u = (x[:, j] - self.low[j]) / self.h
            c = np.clip(np.floor(u).astype(np.int64), 0, self.cells[j] - 1)
            cell = cell * self.cells[j] + c
            off = (u - c - 0.5)[:, None] - _AT[None, :]
            out.append(np.stack([np.delete(off, m, 1).prod(1) / _BELOW[m] for m in range(NODES)], 1))
        return cell, out

    @staticmethod
    def _left(basis: list[np.ndarray]) -> np.ndarray:
        out = np.ones((len(basis[0]), 1))
        for b in basis[:-1]:
            out = (out[:, :, None] * b[:, None, :]).reshape(len(out), -1)
        return out

    def _by_cell(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        cell, basis = self._basis(x)
        order = np.argsort(cell, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            if len(rows):
                some = [b[rows] for b in basis]
                yield int(cell[rows[0]]), rows, self._left(some), some[-1]

    def charges(self, df: DataFrame) -> np.ndarray:
        """The charges at all nodes (cell by cell) of rows (x, q)."""
        n = int(np.prod(self.cells))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((n, NODES ** len(self.cells)))
            for batch in batches:
                x, q = vectors(batch.column(0)), batch.column(1).to_numpy()
                if len(x):
                    for cell, rows, left, last in self._by_cell(x):
                        out[cell] += ((left * q[rows, None]).T @ last).ravel()
            flat = out.ravel()
            for lo in range(0, len(flat), CHUNK):
                if flat[lo : lo + CHUNK].any():
                    yield pa.RecordBatch.from_arrays([pa.array([lo // CHUNK], pa.int32()), pa.array([flat[lo : lo + CHUNK].tobytes()], pa.binary())], names=["chunk", "q"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(q, float) for q in table.column("q").to_pylist())
            return pa.table({"chunk": table.column("chunk")[:1], "q": pa.array([total.tobytes()], pa.binary())})

        out = np.zeros(n * NODES ** len(self.cells))
        for r in df.select("x", "q").mapInArrow(work, "chunk int, q binary").groupBy("chunk").applyInArrow(add, "chunk int, q binary").collect():
            out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(bytes(r.q), float)
        return out.reshape(n, -1)

    def potential(self, charges: np.ndarray) -> np.ndarray:
        """The kernel's sums at all nodes, in the same layout."""
        p = len(self.cells)
        v = charges.reshape(*self.cells, *[NODES] * p).transpose([i for j in range(p) for i in (j, p + j)]).reshape([int(c) * NODES for c in self.cells])
        for j, c in enumerate(self.cells):
            at = (np.arange(c)[:, None] + 0.5 + _AT[None, :]).ravel()
            kernel = np.exp(-((at[:, None] - at[None, :]) ** 2) / 2)
            v = np.moveaxis(np.tensordot(kernel, v, (1, j)), 0, j)
        v = v.reshape([k for c in self.cells for k in (int(c), NODES)])
        return np.ascontiguousarray(v.transpose([2 * j for j in range(p)] + [2 * j + 1 for j in range(p)])).reshape(charges.shape)

    def read(self, df: DataFrame, potential: np.ndarray, out: str) -> DataFrame:
        """``df`` (id, x) with the sum ``out`` at each row."""
        sent = df.sparkSession.sparkContext.broadcast(potential)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, s = vectors(batch.column(1)), np.zeros(len(batch))
                if len(x):
                    for cell, rows, left, last in self._by_cell(x):
                        s[rows] = ((left @ sent.value[cell].reshape(-1, NODES)) * last).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], names=["id", "x", out])

        return df.select("id", "x").mapInArrow(work, f"id long, x array<double>, {out} double")


def extent(df: DataFrame, columns: int) -> tuple[np.ndarray, np.ndarray]:
    row = df.agg(*(f(F.get("x", F.lit(j))).alias(f"{n}{j}") for j in range(columns) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    return np.array([row[f"lo{j}"] for j in range(columns)], float), np.array([row[f"hi{j}"] for j in range(columns)], float)

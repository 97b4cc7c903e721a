"""Sums of a compact kernel over all pairs in two columns, where one of them takes few values: exact to rounding, without pairs.

Controls of one value of that column are a line.  What a row reaches of a line is one stretch, whose ends the kernel itself decides.
Within a stretch the kernel is smooth: a polynomial for the uniform and Epanechnikov kernels and, in cells narrower than the
lines' distance, one to about 1e-12 for the triangular.  So running sums of Lagrange charges along the line give a stretch's sum.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LOOP, FLAT, CURVED = 20_000, 60, 600  # costs of a pair of lines, and of a row and a line, in pairs of rows
NODES, FEW = 14, 3
SMALL = 1e-7  # sums below that share of all charges are taken pair by pair
HEAVY = 1e3  # so are rows of a larger charge


class Line:
    def __init__(self, v: np.ndarray, q: np.ndarray):
        order = np.argsort(v, kind="stable")
        v, q = v[order], q[order]
        starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        self.v, self.q, self.tables = v[starts], np.add.reduceat(q, starts), {}

    def table(self, width: float, m: int) -> tuple:
        """(cell of each value, first place of each cell and the end, cells' middles, nodes, running charges)."""
        if (width, m) not in self.tables:
            at = 0.5 * np.cos((2 * np.arange(m) + 1) * np.pi / (2 * m))
            number = np.floor((self.v - self.v[0]) / width)
            cells, first, cell = np.unique(number, return_index=True, return_inverse=True)
            middle = self.v[0] + (cells + 0.5) * width
            off = ((self.v - middle[cell]) / width)[:, None] - at[None, :]
            basis = np.stack([np.delete(off, j, 1).prod(1) / np.prod([at[j] - b for b in np.delete(at, j)]) for j in range(m)], 1)
            running = np.concatenate([np.zeros((1, m)), np.cumsum(basis * self.q[:, None], 0)])
            self.tables[width, m] = cell, np.append(first, len(self.v)), middle, at * width, running
        return self.tables[width, m]

    def total(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray, smooth: Callable[[np.ndarray], np.ndarray], width: float, m: int) -> np.ndarray:
        """Sums of charges times ``smooth`` of (value - c) over the places ``lo`` to ``hi``."""
        out, rows = np.zeros(len(c)), np.flatnonzero(hi > lo)
        if not len(rows):
            return out
        cell, first, middle, nodes, running = self.table(width, m)
        k, last = cell[lo[rows]], cell[hi[rows] - 1]
        while len(rows):
            a, b = np.maximum(lo[rows], first[k]), np.minimum(hi[rows], first[k + 1])
            out[rows] += (smooth((middle[k] - c[rows])[:, None] + nodes) * (running[b] - running[a])).sum(1)
            go = k < last
            rows, k, last = rows[go], k[go] + 1, last[go]
        return out

    def reached(self, c: np.ndarray, dy: float, weigh: Callable, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """First and last places of the values that ``weigh`` gives a weight: rounding is monotone, so they are one stretch."""
        r = np.sqrt(max(0.0, reach * reach * (1 + 1e-9) - dy * dy))
        lo, hi = np.searchsorted(self.v, c - r, "left"), np.searchsorted(self.v, c + r, "right")
        for places, step in ((lo, 1), (hi, -1)):
            rows = np.flatnonzero(hi > lo)
            while len(rows):
                d = self.v[places[rows] - (step < 0)] - c[rows]
                rows = rows[weigh(np.sqrt(d * d + dy * dy)) <= 0]
                places[rows] += step
                rows = rows[hi[rows] > lo[rows]]
        return lo, hi


def axis(q: np.ndarray, c: np.ndarray, kernel: str, times: float = 1.0) -> int | None:
    """The column to cut into lines, or None where pairs of rows are less work; each row stands for so many."""
    if q.shape[1] != 2 or not len(q) or not len(c):
        return None
    j = min((0, 1), key=lambda j: len(np.unique(c[:, j])))
    to, of = len(np.unique(q[:, j])), len(np.unique(c[:, j]))
    return j if to * of * LOOP + times * len(q) * of * (CURVED if kernel == "triangular" else FLAT) < times * len(q) * times * len(c) else None


def sums(x: np.ndarray, y: np.ndarray, charge: np.ndarray, j: int, kernel: str, h: float, weigh: Callable, reach: float) -> np.ndarray:
    """For each row of ``x`` the sum over ``y`` of charge times kernel, by lines of column ``j``; those too small to trust are NaN."""
    at, inverse = np.unique(y[:, j], return_inverse=True)
    lines = [Line(y[rows, 1 - j], charge[rows]) for rows in np.split(np.argsort(inverse, kind="stable"), np.cumsum(np.bincount(inverse))[:-1])]
    mine, inverse = np.unique(x[:, j], return_inverse=True)
    out, some = np.zeros(len(x)), np.zeros(len(x), bool)
    for value, rows in zip(mine, np.split(np.argsort(inverse, kind="stable"), np.cumsum(np.bincount(inverse))[:-1]), strict=True):
        c = x[rows, 1 - j]
        for i in np.flatnonzero(np.abs(at - value) <= reach):
            line, dy = lines[i], abs(float(at[i] - value))
            lo, hi = line.reached(c, dy, weigh, reach)
            some[rows] |= hi > lo
            if kernel == "uniform":
                out[rows] += line.total(lo, hi, c, np.ones_like, h, 1)
            elif kernel == "epanechnikov":
                out[rows] += line.total(lo, hi, c, lambda u, dy=dy: 0.75 * (1 - (u * u + dy * dy) / (h * h)), h, FEW)
            elif dy == 0:
                mid = np.clip(np.searchsorted(line.v, c), lo, hi)
                out[rows] += line.total(lo, mid, c, lambda u: 1 + u / h, h, FEW) + line.total(mid, hi, c, lambda u: 1 - u / h, h, FEW)
            else:
                width = h
                while width > 0.6 * dy and width > h * 1e-6:
                    width /= 2
                if width > h * 1e-6 and h / width < len(line.v):
                    out[rows] += line.total(lo, hi, c, lambda u, dy=dy: 1 - np.sqrt(u * u + dy * dy) / h, width, NODES)
                else:  # lines so near each other, or so few on them, that cells are no gain
                    for r, a, b in zip(rows, lo, hi, strict=True):
                        u = line.v[a:b] - x[r, 1 - j]
                        out[r] += (line.q[a:b] * (1 - np.sqrt(u * u + dy * dy) / h)).sum()
    return np.where(some & (out < SMALL * charge.sum()), np.nan, out)

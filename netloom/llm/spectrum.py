"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The factors ``P (A - s I) P' = L D L'`` (pivots of one or two rows) have as many positive eigenvalues in D as
A has eigenvalues above s. Bisection by these counts isolates each leading eigenvalue in an interval of its
own; Rayleigh quotient iteration then converges cubically inside it, and two more counts, just below and just
above the result, certify that it is the eigenvalue with that number. Eigenvalues that no shift can separate
in double precision are one cluster: their count is certified together and an orthonormal basis of their
common space is returned.

All work is on one matrix whose size is the number of dimensions, whatever the number of rows behind it.
"""

from __future__ import annotations

import numpy as np

_PIVOT = (1 + 17**0.5) / 8  # balances the growth of pivots of one and of two rows
_EPS = np.finfo(float).eps


class Factors:
    """L D L' factors of a symmetric matrix; D has blocks of one or two rows."""

    def __init__(self, matrix: np.ndarray):
        a, n = np.array(matrix, dtype=float), len(matrix)
        order, blocks, k = np.arange(n), [], 0
        while k < n:
            size, at = self._pivot(a, k)
            to = k + size - 1
            if at != to:
                a[[to, at], :] = a[[at, to], :]
                a[:, [to, at]] = a[:, [at, to]]
                order[[to, at]] = order[[at, to]]
            block, rest = a[k : k + size, k : k + size].copy(), slice(k + size, n)
            if size == 2 or block[0, 0] != 0:
                column = a[rest, k : k + size].copy()
                lower = column / block[0, 0] if size == 1 else np.linalg.solve(block, column.T).T
                a[rest, rest] -= lower @ column.T
                a[rest, k : k + size] = lower
            blocks.append((k, size, block))
            k += size
        self.lower, self.order, self.blocks = a, order, blocks

    @staticmethod
    def _pivot(a: np.ndarray, k: int) -> tuple[int, int]:
        """Rows of the next pivot, and the row that comes to its last place."""
        below = np.abs(a[k + 1 :, k])
        if not len(below) or (most := below.max()) == 0 or abs(a[k, k]) >= _PIVOT * most:
            return 1, k
        r = int(below.argmax()) + k + 1
        across = np.abs(a[r, k:])
        across[r - k] = 0
        if abs(a[k, k]) * across.max() >= _PIVOT * most * most:
            return 1, k
        return (1, r) if abs(a[r, r]) >= _PIVOT * across.max() else (2, r)

    def positive(self) -> int:
        """Number of positive eigenvalues."""
        found = 0
        for _, size, b in self.blocks:
            if size == 1:
                found += b[0, 0] > 0
            else:
                negative_product = b[0, 0] * b[1, 1] < b[0, 1] * b[1, 0]
                found += 1 if negative_product else 2 * (b[0, 0] + b[1, 1] > 0)
        return int(found)

    def solve(self, right: np.ndarray, least: float) -> np.ndarray:
        """Solution for one or more right-hand sides; pivots below ``least`` count as ``least``."""
        z = np.array(right[self.order], dtype=float)
        for k, size, _ in self.blocks:
            z[k + size :] -= self.lower[k + size :, k : k + size] @ z[k : k + size]
        for k, size, b in self.blocks:
            if size == 1:
                d = b[0, 0]
                z[k] /= d if abs(d) >= least else (least if d >= 0 else -least)
            else:
                z[k : k + 2] = np.linalg.solve(b, z[k : k + 2])
        for k, size, _ in reversed(self.blocks):
            z[k : k + size] -= self.lower[k + size :, k : k + size].T @ z[k + size :]
        out = np.empty_like(z)
        out[self.order] = z
        return out


class Slices:
    """Counts of eigenvalues above shifts, each factored once."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.n = matrix, len(matrix)
        self.norm = float(np.abs(matrix).sum(axis=1).max()) if self.n else 0.0
        self.unit = np.eye(self.n)
        edge = self.norm * (1 + 4 * _EPS) + np.finfo(float).tiny
        self.known = {edge: 0, -edge: self.n}

    def factors(self, shift: float) -> Factors:
        return Factors(self.matrix - shift * self.unit)

    def above(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = self.factors(shift).positive()
        return self.known[shift]

    def bracket(self, number: int) -> tuple[float, float]:
        """The narrowest known interval that holds the eigenvalue with this number."""
        low = max(s for s, above in self.known.items() if above >= number)
        return low, min(s for s, above in self.known.items() if above < number and s > low)

    def halve(self, low: float, high: float) -> None:
        self.above(low + (high - low) / 2)


def _basis(vectors: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Orthonormal columns for ``vectors``, at right angles to the columns found before."""
    for _ in range(2):
        vectors = vectors - found @ (found.T @ vectors)
        vectors, _ = np.linalg.qr(vectors)
    return vectors


def _iterate(slices: Slices, low: float, high: float, found: np.ndarray, seed: int) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from the middle of an interval; None if it leaves the interval."""
    a, least = slices.matrix, _EPS * slices.norm
    z = np.random.default_rng(seed).standard_normal((slices.n, 1))
    shift, residual = low + (high - low) / 2, np.inf
    for step in range(30):
        z = slices.factors(shift).solve(z, least)
        z = _basis(z / np.abs(z).max(), found)
        quotient = (z.T @ a @ z).item()
        before, residual = residual, float(np.linalg.norm(a @ z - quotient * z))
        if residual <= 4 * _EPS * slices.norm or (step > 3 and residual >= before and residual <= 1e3 * _EPS * slices.norm):
            return (quotient, z[:, 0]) if low < quotient < high else None
        if step >= 1:  # two steps with the fixed middle turn the start to the right vector
            if not low < quotient < high:
                return None
            shift = quotient
    return None


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit vectors as columns; fewer if the matrix is smaller."""
    slices = Slices(np.asarray(matrix, dtype=float))
    n, width = slices.n, 8 * _EPS * max(slices.n, 1) * slices.norm
    if slices.norm == 0:
        return np.zeros(min(count, n)), slices.unit[:, :count]
    values, vectors = [], np.zeros((n, 0))
    while len(values) < min(count, n):
        number = len(values) + 1
        low, high = slices.bracket(number)
        while (slices.above(low) > number or slices.above(high) < number - 1) and high - low > width:
            slices.halve(low, high)
            low, high = slices.bracket(number)
        several = slices.above(low) - (number - 1)
        if several == 1:
            pair = _iterate(slices, low, high, vectors, number)
            if pair and slices.above(pair[0] - width) >= number and slices.above(pair[0] + width) < number:
                values.append(pair[0])
                vectors = np.column_stack([vectors, pair[1]])
                continue
            if high - low > width:  # it has found another eigenvalue, such as one at the interval's end
                slices.halve(low, high)
                continue
        middle, z = low + (high - low) / 2, np.random.default_rng(number).standard_normal((n, several))
        for _ in range(4):
            z = slices.factors(middle).solve(z, _EPS * slices.norm + np.finfo(float).tiny)
            z = _basis(z / max(np.abs(z).max(), np.finfo(float).tiny), vectors)
        quotients = np.einsum("ij,ij->j", z, slices.matrix @ z)
        order = np.argsort(-quotients, kind="stable")
        values += quotients[order].tolist()
        vectors = np.column_stack([vectors, z[:, order]])
    return np.array(values[:count]), vectors[:, :count]

"""Poses of a chain of slices from the moments of their correspondences."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Sums over the correspondences (px, py) -> (qx, qy) of weight w of each group: all that a rigid pose graph needs of them.

    Points are taken from the group's weighted means, so that coordinates far from the
    origin cost no digits: one pass for the means, one for the rest.
    """
    mass = F.sum("w")
    means = pairs.groupBy(*by).agg(mass.alias("mass"), *((F.sum(F.col("w") * F.col(c)) / mass).alias(f"m{c}") for c in ("px", "py", "qx", "qy"))).filter("mass > 0")
    at = pairs.join(F.broadcast(means), by)  # a row for each pair of slices
    px, py, qx, qy = (F.col(c) - F.col(f"m{c}") for c in ("px", "py", "qx", "qy"))
    s = lambda e, n: F.sum(F.col("w") * e).alias(n)
    first = [F.first(c).alias(c) for c in ("mass", "mpx", "mpy", "mqx", "mqy")]
    return at.groupBy(*by).agg(*first, s(px * px + py * py, "pp"), s(qx * qx + qy * qy, "qq"), s(px * qx + py * qy, "dot"), s(px * qy - py * qx, "cross"))


def _turned(a: float, v: np.ndarray) -> np.ndarray:
    return np.array([math.cos(a) * v[0] - math.sin(a) * v[1], math.sin(a) * v[0] + math.cos(a) * v[1]])


@dataclass(frozen=True)
class Moments:
    """One pair: its mass, both means, both spreads about them, and the centred products p . q and p x q."""

    w: float
    p: np.ndarray
    q: np.ndarray
    pp: float
    qq: float
    dot: float
    cross: float

    @classmethod
    def of(cls, r) -> Moments:
        return cls(r["mass"], np.array([r["mpx"], r["mpy"]]), np.array([r["mqx"], r["mqy"]]), r["pp"], r["qq"], r["dot"], r["cross"])

    def fit(self) -> tuple[float, np.ndarray]:
        """The pose (angle, move) that takes p to q best."""
        a = math.atan2(self.cross, self.dot)
        return a, self.q - _turned(a, self.p)

    def cost(self, high: np.ndarray, low: np.ndarray) -> float:
        """The sum of w |R_h p + t_h - R_l q - t_l|^2."""
        a = high[0] - low[0]
        d = _turned(high[0], self.p) + high[1:] - _turned(low[0], self.q) - low[1:]
        return max(0.0, self.pp + self.qq - 2 * (math.cos(a) * self.dot + math.sin(a) * self.cross)) + self.w * float(d @ d)

    def normal(self, high: np.ndarray, low: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The parts of J'J and J'e: (high, high), (low, low), (high, low); high, low. Unknowns of a slice are its angle and move.

        With u = R_h p, v = R_l q and K the quarter turn, the columns of J are K u, I, -K v, -I.
        exact: the second derivatives in place of J'J, which differ in each angle's own entry alone.
        """
        a, (u, v) = high[0] - low[0], (_turned(high[0], self.p), _turned(low[0], self.q))
        d = u + high[1:] - v - low[1:]
        uv = math.cos(a) * self.dot + math.sin(a) * self.cross  # of the centred parts, as is `slope`
        slope = math.cos(a) * self.cross - math.sin(a) * self.dot
        ku, kv = np.array([-u[1], u[0]]), np.array([-v[1], v[0]])
        hh, ll, hl = np.eye(3) * self.w, np.eye(3) * self.w, -np.eye(3) * self.w
        hh[0, 0], ll[0, 0], hl[0, 0] = self.pp + self.w * u @ u, self.qq + self.w * v @ v, -uv - self.w * u @ v
        if exact:
            hh[0, 0], ll[0, 0] = uv + self.w * (u @ u - d @ u), uv + self.w * (v @ v + d @ v)
        hh[0, 1:] = hh[1:, 0] = self.w * ku
        ll[0, 1:] = ll[1:, 0] = self.w * kv
        hl[0, 1:], hl[1:, 0] = -self.w * ku, -self.w * kv
        return hh, ll, hl, np.array([self.w * ku @ d - slope, *(self.w * d)]), np.array([slope - self.w * kv @ d, *(-self.w * d)])


def tridiagonal(diagonal: np.ndarray, above: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of a symmetric block-tridiagonal system: n blocks on the diagonal, n - 1 above it."""
    d, r = diagonal.copy(), right.copy()
    for i in range(1, len(d)):
        f = np.linalg.solve(d[i - 1], above[i - 1]).T
        d[i] -= f @ above[i - 1]
        r[i] -= f @ r[i - 1]
    out = np.zeros_like(r)
    for i in range(len(d) - 1, -1, -1):
        out[i] = np.linalg.solve(d[i], r[i] - (above[i] @ out[i + 1] if i + 1 < len(d) else 0.0))
    return out


def chain(links: dict[int, Moments], n: int, anchor: int) -> np.ndarray:
    """Poses (angle, move) composed outward from the anchor, which stays; links[i] ties slice i + 1 to slice i. A slice beyond a missing link stays."""
    x, reached = np.zeros((n, 3)), {anchor}
    for i, to in [(i, i - 1) for i in range(anchor + 1, n)] + [(i, i + 1) for i in range(anchor - 1, -1, -1)]:
        link = links.get(min(i, to))
        if link is not None and to in reached:
            a, t = link.fit()
            if i < to:  # the pair's pose takes the upper slice to the lower one
                a, t = -a, -_turned(-a, t)
            x[i] = (x[to, 0] + a, *(_turned(x[to, 0], t) + x[to, 1:]))
            reached.add(i)
    return x


def total(links: dict[int, Moments], x: np.ndarray, smooth: list[int], lam: float) -> float:
    return 0.5 * (sum(m.cost(x[i + 1], x[i]) for i, m in links.items()) + lam * sum(float(((x[i + 1] - x[i]) ** 2).sum()) for i in smooth))


def _step(links: dict[int, Moments], x: np.ndarray, anchor: int, smooth: list[int], lam: float, damp: float, exact: bool) -> np.ndarray:
    n = len(x)
    diagonal, above, slope = np.zeros((n, 3, 3)), np.zeros((n - 1, 3, 3)), np.zeros((n, 3))
    for i, m in links.items():
        hh, ll, hl, gh, gl = m.normal(x[i + 1], x[i], exact)
        diagonal[i + 1] += hh
        diagonal[i] += ll
        above[i] += hl.T
        slope[i + 1] += gh
        slope[i] += gl
    for i in smooth:
        step = lam * (x[i + 1] - x[i])
        diagonal[i : i + 2] += lam * np.eye(3)
        above[i] -= lam * np.eye(3)
        slope[i + 1] += step
        slope[i] -= step
    diagonal += damp * np.eye(3)
    # the anchor stays: its unknowns leave the system
    diagonal[anchor], slope[anchor] = np.eye(3), 0.0
    above[max(0, anchor - 1) : anchor + 1] = 0.0
    return tridiagonal(diagonal, above, -slope)


def solve(links: dict[int, Moments], n: int, anchor: int, lam: float = 0.0, most: int = 50) -> tuple[np.ndarray, float, int]:
    """(poses (angle, move) of the n slices, cost, evaluations) of the pose graph; lam weighs the squared steps between neighbours other than the anchor."""
    x = chain(links, n, anchor)
    smooth = [i for i in range(n - 1) if anchor not in (i, i + 1)] if lam > 0 else []
    cost, tried, damp = total(links, x, smooth, lam), 1, 1e-3
    while smooth and tried < most:
        for exact in (True, False):
            # Newton's step ends at large residuals too, Gauss and Newton's always leads down
            new = x + _step(links, x, anchor, smooth, lam, damp, exact)
            reached = total(links, new, smooth, lam)
            tried += 1
            if reached < cost:
                break
        if reached < cost:
            small = cost - reached < 1e-12 * (cost + 1e-12)
            x, cost, damp = new, reached, damp / 3
            if small:
                break
        else:
            damp *= 4
            if damp > 1e8:
                break
    return x, cost, tried

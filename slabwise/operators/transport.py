"""Optimal transport between two bounded sets of spots: numpy blocks that run in one task for a pair of slices."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

import numpy as np

#: Names that ask for an exact assignment.
ASSIGNMENT = ("emd", "lap", "linear_assignment", "linear_sum_assignment")


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :]
    out -= 2 * a @ b.T
    return np.maximum(out, 0.0, out=out)


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


#: Change of a potential up to which a kernel that holds the one before serves; exp of it and of the kernel's entries stay far within doubles.
DRIFT = 30.0


def _potentials(k: np.ndarray, la: np.ndarray, lb: np.ndarray, power: float, rounds: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Sinkhorn's potentials f and g of the log kernel k.

    A round in the log domain takes two exponentials of every entry. Where potentials move
    by less than DRIFT the kernel that holds those before is multiplied by exp of the
    change instead, two products with a vector; otherwise, or where a sum is lost, the
    round is made in the log domain and the kernel anew. Both are one iteration to rounding.
    """
    f, g, held = np.zeros(len(la)), np.zeros(len(lb)), None
    for _ in range(rounds):
        old, done = f, False
        if held is not None and np.abs(g - held[2]).max() <= DRIFT:
            kernel, f0, g0 = held
            r = kernel @ np.exp(g - g0)
            if r.min() > 0 and np.isfinite(r).all():
                f = -power * (np.log(r) - f0 - la)
                if np.abs(f - f0).max() <= DRIFT:
                    c = np.exp(f - f0) @ kernel
                    done = c.min() > 0 and np.isfinite(c).all()
                    g = -power * (np.log(c) - g0 - lb) if done else g
        if not done:
            f = -power * logsumexp(k + (g + lb)[None, :], 1)
            g = -power * logsumexp(k + (f + la)[:, None], 0)
            held = (np.exp(k + (f + la)[:, None] + (g + lb)[None, :]), f, g)
        if np.abs(f - old).max() < tol:
            break
    return f, g


def sinkhorn(a, b, cost, reg, reg_m: float | None = None, rounds: int = 20_000, tol: float = 1e-9) -> np.ndarray:
    """Entropic transport in the log domain; with reg_m, marginals are relaxed by a Kullback-Leibler term of that weight.

    The entropy is taken against a x b in both cases.
    """
    la, lb = np.log(np.asarray(a, float)), np.log(np.asarray(b, float))
    k = -np.asarray(cost, float) / reg
    f, g = _potentials(k, la, lb, 1.0 if reg_m is None else reg_m / (reg_m + reg), rounds, tol)
    return np.exp(k + (f + la)[:, None] + (g + lb)[None, :])


def assignment(cost: np.ndarray | Costs | _Square) -> np.ndarray:
    """The column of each row in a least-cost perfect assignment of a square matrix: shortest augmenting paths, a vector step for each row visited.

    Rows are asked for one at a time, so `Costs` serve as well as an array; those of at
    most ENTRIES entries are made once. Columns are priced at their least cost and rows at
    what is then least in them; rows that have such a column to themselves begin with it, and
    only the others look for a path. Costs that have a way of their own go it.
    """
    n = len(cost)
    if hasattr(cost, "assigned"):
        return cost.assigned()
    if not isinstance(cost, np.ndarray) and n * n <= ENTRIES:
        cost = cost.rows(0, n)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    row_of = np.full(n + 1, -1)
    for low, high in row_blocks(n, n):
        part = cost[low:high] if isinstance(cost, np.ndarray) else cost.rows(low, high)
        v[:n] = np.minimum(v[:n], part.min(0)) if low else part.min(0)
    begun = np.zeros(n, dtype=bool)
    for low, high in row_blocks(n, n):
        part = (cost[low:high] if isinstance(cost, np.ndarray) else cost.rows(low, high)) - v[:n]
        at = part.argmin(1)
        u[low:high] = part[np.arange(high - low), at]
        for i, j in enumerate(at, low):
            if row_of[j] < 0:
                row_of[j], begun[i] = i, True
    for i in np.flatnonzero(~begun):
        row_of[n] = i
        j0 = n
        least, used, way = np.full(n, np.inf), np.zeros(n + 1, dtype=bool), np.full(n, n)
        while True:
            used[j0] = True
            r = row_of[j0]
            reduced = cost[r] - u[r] - v[:n]
            free = ~used[:n]
            better = free & (reduced < least)
            least[better], way[better] = reduced[better], j0
            j1 = int(np.argmin(np.where(free, least, np.inf)))
            step = least[j1]
            u[row_of[used]] += step
            v[used] -= step
            least[free] -= step
            j0 = j1
            if row_of[j0] < 0:
                break
        while j0 != n:
            before = way[j0]
            row_of[j0] = row_of[before]
            j0 = before
    out = np.empty(n, dtype=int)
    out[row_of[:n]] = np.arange(n)
    return out


class _Square:
    """Squared distances between two sets of features, filled up to a square by rows or columns without cost; rows are made when they are asked for."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b, self.n = a, b, max(len(a), len(b))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> np.ndarray:
        return self.rows(i, i + 1)[0]

    def rows(self, low: int, high: int) -> np.ndarray:
        out, own = np.zeros((high - low, self.n)), self.a[low:high]
        out[: len(own), : len(self.b)] = squared_distances(own, self.b)
        return out


def assigned_pair(rows):
    """(src, dst) of a least-cost assignment by features between the sides 0 and 1 of bounded rows (side, gid, vec).

    All rows of the smaller side are assigned: rows or columns without cost fill up the
    square, which is never held beyond ENTRIES entries.
    """
    import pandas as pd

    a, b = (rows[rows["side"] == i].sort_values("gid") for i in (0, 1))
    out = []
    if len(a) and len(b):
        cost = _Square(np.array(a["vec"].tolist()), np.array(b["vec"].tolist()))
        out = [(int(a["gid"].iloc[i]), int(b["gid"].iloc[j])) for i, j in enumerate(assignment(cost)) if i < len(a) and j < len(b)]
    return pd.DataFrame(out, columns=["src", "dst"])


#: Entries of a cost that are made at a time: 32 MB of doubles.
ENTRIES = 1 << 22


def row_blocks(n: int, m: int):
    """Ranges of rows that cut an n x m matrix into parts of at most ENTRIES entries (a row at least)."""
    step = max(1, ENTRIES // max(m, 1))
    return [(low, min(low + step, n)) for low in range(0, n, step)]


def nearest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place of each row's nearest row of b, the first of equals."""
    return np.concatenate([squared_distances(a[low:high], b).argmin(1) for low, high in row_blocks(len(a), len(b))] or [np.empty(0, int)])


@dataclass(frozen=True)
class Costs:
    """An n x m cost of which each row's k candidates alone are kept: (n, k) columns and values, and one value for all others in a row.

    Two terms that every entry has are kept as rules: `ties` * (row - column)^2, where rows
    count from `first`, and a gate weight * |p - q|^2 of the rows' and columns' places. Nothing of size n x m is held:
    what has to be seen entry by entry is made for a block of rows and let go.
    """

    col: np.ndarray
    val: np.ndarray
    fill: np.ndarray
    width: int
    ties: float = 0.0
    gate: tuple | None = None
    first: int = 0
    #: Whether every column is a candidate, in order.
    whole: bool = False

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, k: int | None = None) -> Costs:
        """Squared distances to the k nearest, ties to the lesser column; others are not finite. All are candidates where k is None, not positive or not less than the width."""
        n, m = len(a), len(b)
        if k is None or k <= 0 or k >= m:
            parts = row_blocks(n, m)
            val = squared_distances(a, b) if len(parts) == 1 else np.empty((n, m))
            for low, high in parts[1:] and parts:
                val[low:high] = squared_distances(a[low:high], b)
            return cls(np.broadcast_to(np.arange(m, dtype=np.int32), (n, m)), val, np.full(n, np.inf), m, whole=True)
        col, val = np.empty((n, k), dtype=np.int32), np.empty((n, k))
        for low, high in row_blocks(n, m):
            d = squared_distances(a[low:high], b)
            d[np.isnan(d)] = np.inf
            last = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
            below, even = d < last, d == last
            taken = below | (even & (np.cumsum(even, axis=1) <= k - below.sum(axis=1, keepdims=True)))
            col[low:high] = np.nonzero(taken)[1].reshape(-1, k)
            val[low:high] = np.take_along_axis(d, col[low:high].astype(int), 1)
        return cls(col, val, np.full(n, np.inf), m)

    def __len__(self) -> int:
        return len(self.val)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.rows(i, i + 1)[0]

    def rows(self, low: int, high: int) -> np.ndarray:
        if self.whole:
            out = self.val[low:high].copy()
        else:
            out = np.repeat(self.fill[low:high, None], self.width, axis=1)
            np.put_along_axis(out, self.col[low:high].astype(int), self.val[low:high], 1)
        if self.ties:
            out += self.ties * (np.arange(self.first + low, self.first + high)[:, None] - np.arange(self.width)) ** 2
        if self.gate is not None:
            p, q, weight = self.gate
            out += weight * squared_distances(p[low:high], q)
        return out

    def cleaned(self, clip_quantile: float | None = None, pairwise: bool = True) -> Costs:
        """Clip each row's candidates at a quantile, fill what is not finite with ten times the row's maximum (1 at least), subtract the row's minimum.

        A RuntimeError where no entry is finite. pairwise: a row whose maximum is not positive is filled with 10.
        """
        if self.val.size and np.isfinite(self.val).all():
            over = False if clip_quantile is None else self.val > np.quantile(self.val, clip_quantile, axis=1, keepdims=True)
            top = self.val.max(axis=1) if over is False else np.max(self.val, axis=1, where=~over, initial=0.0)
            top = np.where(top > 0, top, 1.0) if pairwise else top
            fill, least = np.maximum(10 * top, 1.0), self.val.min(axis=1)
            val = self.val if over is False else np.where(over, fill[:, None], self.val)
            return replace(self, val=val - least[:, None], fill=fill - least)
        c = np.where(np.isfinite(self.val), self.val, np.nan)
        some = ~np.isnan(c).all(axis=1)
        if not some.any():
            raise RuntimeError("the cost has no finite entry")
        if clip_quantile is not None:
            c[some] = np.where(c[some] > np.nanquantile(c[some], clip_quantile, axis=1, keepdims=True), np.nan, c[some])
        top = np.where(some, np.where(np.isnan(c), -np.inf, c).max(axis=1), 0.0)
        if pairwise:
            top = np.where(top > 0, top, 1.0)
        fill = np.maximum(10 * top, 1.0)
        least = np.where(some, np.where(np.isnan(c), np.inf, c).min(axis=1), fill)
        return replace(self, val=np.where(np.isnan(c), fill[:, None], c) - least[:, None], fill=fill - least)

    def placed(self, first: int) -> Costs:
        """As rows of a larger matrix, from its row `first` on."""
        return replace(self, first=first)

    def greatest(self) -> float:
        return float(max(self.val.max(initial=0.0), self.fill.max(initial=0.0) if self.val.shape[1] < self.width else 0.0))

    def tie_broken(self, top: float | None = None) -> Costs:
        """With 1e-6 * max(the greatest cost, 1) * (i - j)^2, so that equal assignments have an order; top: the greatest of the matrix that these rows are part of."""
        return replace(self, ties=1e-6 * max(self.greatest() if top is None else top, 1.0))

    def gated(self, a: np.ndarray, b: np.ndarray, sigma: float, weight: float = 0.2) -> Costs:
        """With weight * squared distance of a and b / sigma^2; a gate from before is replaced."""
        return replace(self, gate=(a, b, weight / sigma**2) if weight else None)


class _Support:
    """Sums over exp(f + g - cost / reg) where others than candidates cost one value in each row: time and memory of n x k.

    exp(-cost / reg) is a constant in each row plus what candidates have above it; as no
    candidate costs more than the others do, all terms are positive and nothing cancels.
    """

    def __init__(self, c: Costs, reg: float):
        fill = np.full(len(c), np.inf) if c.val.shape[1] == c.width else c.fill
        self.rest = -fill / reg
        with np.errstate(divide="ignore", invalid="ignore"):
            self.gain = np.where(np.isinf(c.val), -np.inf, -c.val / reg + np.log(-np.expm1(-(fill[:, None] - c.val) / reg)))
        self.col, self.width = c.col, c.width
        self.order = np.argsort(c.col.ravel(), kind="stable")
        by_col = c.col.ravel()[self.order]
        self.starts = np.flatnonzero(np.diff(by_col, prepend=-1))
        self.met, self.sizes = by_col[self.starts], np.diff(np.append(self.starts, len(by_col)))
        self.by_col = self.gain.ravel()[self.order]
        self.row_of = self.order // max(1, c.val.shape[1])

    def step(self, h: np.ndarray, turn) -> tuple[np.ndarray, np.ndarray]:
        """Log sums of the rows under h, and of the columns under turn(those)."""
        r = np.logaddexp(self.rest + logsumexp(h[None, :], 1), logsumexp(self.gain + h[self.col], 1))
        e = turn(r, 0, len(r))
        others = logsumexp((self.rest + e)[None, :], 1)
        out = np.repeat(others, self.width)
        t = self.by_col + e[self.row_of]
        top = np.maximum.reduceat(t, self.starts)
        top = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            out[self.met] = np.logaddexp(out[self.met], top + np.log(np.add.reduceat(np.exp(t - np.repeat(top, self.sizes)), self.starts)))
        return r, out

    def moved(self, e: np.ndarray, h: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row masses of the plan and its rows' sums of targets."""
        high = h.max()
        all_of, rest = np.exp(h - high), np.exp(self.rest + e + high)
        p = np.exp(self.gain + h[self.col] + e[:, None])
        return rest * all_of.sum() + p.sum(axis=1), rest[:, None] * (all_of @ targets) + np.stack([(p * targets[self.col, d]).sum(axis=1) for d in range(targets.shape[1])], axis=1)


class _Blocks:
    """The same sums where every entry has a cost of its own: made a block of rows at a time, held where one block is all."""

    def __init__(self, c: Costs, reg: float):
        self.c, self.reg, self.parts = c, reg, row_blocks(len(c), c.width)
        self.held = c.rows(0, len(c)) / -reg if len(self.parts) == 1 else None

    def kernel(self, low: int, high: int) -> np.ndarray:
        return self.c.rows(low, high) / -self.reg if self.held is None else self.held

    def step(self, h: np.ndarray, turn) -> tuple[np.ndarray, np.ndarray]:
        r, out = np.empty(len(self.c)), np.full(len(h), -np.inf)
        for low, high in self.parts:
            k = self.kernel(low, high)
            r[low:high] = logsumexp(k + h, 1)
            out = np.logaddexp(out, logsumexp(k + turn(r[low:high], low, high)[:, None], 0))
        return r, out

    def moved(self, e: np.ndarray, h: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, sums = np.empty(len(e)), np.empty((len(e), targets.shape[1]))
        for low, high in self.parts:
            p = np.exp(self.kernel(low, high) + e[low:high, None] + h)
            w[low:high], sums[low:high] = p.sum(axis=1), p @ targets
        return w, sums


def entropic_move(costs: Costs, targets: np.ndarray, reg: float, reg_m: float | None = None, rounds: int = 20_000, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Row masses and row sums of targets under the entropic plan of uniform weights; the plan is that of `sinkhorn` and never held."""
    n, m = len(costs), costs.width
    over = (_Support if not costs.ties and costs.gate is None else _Blocks)(costs, reg)
    power = 1.0 if reg_m is None else reg_m / (reg_m + reg)
    la, lb = -np.log(n), -np.log(m)
    if isinstance(over, _Blocks) and over.held is not None:
        f, g = _potentials(over.held, np.full(n, la), np.full(m, lb), power, rounds, tol)
        return over.moved(f + la, g + lb, targets)
    f, g = np.zeros(n), np.zeros(m)
    for _ in range(rounds):
        old = f
        r, c = over.step(g + lb, lambda r, low, high: la - power * r)
        f, g = -power * r, -power * c
        if np.abs(f - old).max() < tol:
            break
    return over.moved(f + la, g + lb, targets)


def barycentric_move(costs: Costs, targets: np.ndarray, transport: str, reg: float, emd_max_n: int | None = 2000, reg_m: float | None = None, rounds: int = 20_000, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray, str]:
    """Each row's mass and mean target under a plan of uniform weights, and the method that made it."""
    n, m = len(costs), costs.width
    if transport in ASSIGNMENT:
        if n == m and (emd_max_n is None or n <= emd_max_n):
            w = np.full(n, 1.0 / n)
            return w, targets[assignment(costs)] * (w / (w + 1e-12))[:, None], "emd"
        warnings.warn("an exact assignment needs equal sides of bounded size; Sinkhorn is used", stacklevel=2)
    elif transport != "sinkhorn":
        raise ValueError(f"unknown transport: {transport}")
    w, sums = entropic_move(costs, targets, reg, reg_m, rounds, tol)
    return w, sums / (w + 1e-12)[:, None], "sinkhorn"


def barycentres(pi: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row masses, and the mean target of each row."""
    w = pi.sum(axis=1)
    return w, (pi @ targets) / (w + 1e-12)[:, None]

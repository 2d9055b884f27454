"""Exact nearest centre without looking at every centre.

About sqrt(K) of the centres are pivots; every centre belongs to its nearest pivot, and a
group has a radius. A point is compared with all pivots, then with the group of its
nearest pivot. From there the triangle inequality leaves out the rest in two ways:

* a centre c' can't be as near as the best one c so far if ``|c - c'| > 2 |x - c|``: the
  neighbours of every centre are sorted by distance, and only the first of them are compared;
* no centre of a group is nearer than ``|x - pivot| - radius``. This serves points whose best
  centre is still so far away that most neighbours are within the first bound, and models of
  more than ``MAX_NEIGHBOURS`` centres, for which no neighbour lists are made.

The distances themselves are those of the plain scan, and centres are left out only if the
bound is passed by more than rounding, so the answer, ties to the lowest index included, is
that of the scan.
"""

from __future__ import annotations

import numpy as np

#: Below this many centres the plain scan is as fast.
MIN_CENTERS = 48
#: Up to this many centres the distances between all of them are kept (K * K * 12 bytes a task).
MAX_NEIGHBOURS = 2048
#: Relative slack of a bound, far above the rounding of a distance sum.
_SLACK = {np.float64: 1e-9, np.float32: 1e-3}


def scan_distances(X: np.ndarray, C: np.ndarray, dtype) -> np.ndarray:
    """(rows, K) squared distances, each summed coordinate by coordinate, left to right."""
    columns = np.ascontiguousarray(X.T, dtype=dtype)
    C = np.asarray(C, dtype=dtype)
    out = np.zeros((X.shape[0], len(C)), dtype=dtype)
    for j in range(len(columns)):
        diff = columns[j][:, None] - C[:, j]
        diff *= diff
        out += diff
    return out


class CenterGroups:
    """Centres dealt out to pivots; ``nearest`` counts in ``evaluated`` the distances it works out."""

    def __init__(self, C: np.ndarray, dtype=np.float64):
        self.C, self.dtype, self.evaluated = np.asarray(C, np.float64), dtype, 0
        k = len(C)
        picks, far = [0], None
        for _ in range(max(0, int(np.ceil(np.sqrt(k))) - 1)):  # each next pivot is the centre farthest from those taken
            d = ((self.C - self.C[picks[-1]]) ** 2).sum(1)
            far = d if far is None else np.minimum(far, d)
            if far.max() == 0:
                break
            picks.append(int(far.argmax()))
        self.pivots = np.array(picks)
        away = np.stack([((self.C - self.C[p]) ** 2).sum(1) for p in picks], axis=1)
        owner = away.argmin(1)
        rest = np.setdiff1d(np.arange(k), self.pivots)
        self.members = [rest[owner[rest] == g] for g in range(len(picks))]
        self.order = None
        if k <= MAX_NEIGHBOURS:
            between = np.empty((k, k))
            for i in range(k):
                between[i] = np.sqrt(((self.C - self.C[i]) ** 2).sum(1))
            self.order = between.argsort(1, kind="stable").astype(np.int32)
            self.between = np.take_along_axis(between, self.order, 1)
        self.radius = np.array([np.sqrt(away[m, g].max()) if len(m) else -np.inf for g, m in enumerate(self.members)])

    def nearest(self, X: np.ndarray) -> np.ndarray:
        slack = _SLACK[self.dtype]
        X = X.astype(self.dtype, copy=False)
        to_pivots = scan_distances(X, self.C[self.pivots], self.dtype)
        self.evaluated += to_pivots.size
        home = to_pivots.argmin(1)
        best = to_pivots[np.arange(len(X)), home]
        # the lowest index among equally near pivots
        index = np.where(to_pivots == best[:, None], self.pivots, len(self.C)).min(1)
        reach = np.sqrt(to_pivots.astype(np.float64))

        def compare(m: np.ndarray, rows: np.ndarray) -> None:
            d = scan_distances(X[rows], self.C[m], self.dtype)
            self.evaluated += d.size
            at = d.argmin(1)  # m ascends, so the first is the lowest
            least, found = d[np.arange(len(rows)), at], m[at]
            better = (least < best[rows]) | ((least == best[rows]) & (found < index[rows]))
            best[rows[better]], index[rows[better]] = least[better], found[better]

        groups = [g for g, m in enumerate(self.members) if len(m)]
        for g in groups:
            rows = np.flatnonzero(home == g)
            if len(rows):
                compare(self.members[g], rows)
        far = np.ones(len(X), bool)
        if self.order is not None:
            reachable = 2 * np.sqrt(best.astype(np.float64)) * (1 + slack) + slack
            start = index.copy()
            for c in np.unique(start):
                rows = np.flatnonzero(start == c)
                # neighbours that may be as near, the centre itself (the first at distance 0) among them
                n = np.searchsorted(self.between[c], reachable[rows] + slack * self.between[c, -1], "right")
                few = n <= len(self.C) // 2
                far[rows[few]] = False
                rows, n = rows[few], n[few]
                for part in np.array_split(np.argsort(n, kind="stable"), min(4, max(1, len(n) // 16))):
                    if len(part) and n[part].max() > 1:
                        compare(np.sort(self.order[c, : n[part].max()]), rows[part])
        for g in groups:
            bound = reach[:, g] - self.radius[g]
            limit = np.sqrt(best.astype(np.float64)) * (1 + slack) + slack * (reach[:, g] + self.radius[g])
            rows = np.flatnonzero(far & (bound <= limit) & (home != g))
            if len(rows):
                compare(self.members[g], rows)
        return index.astype(np.int32)


class Scan:
    """The plain scan with the same interface."""

    def __init__(self, C: np.ndarray, dtype=np.float64):
        self.C, self.dtype, self.evaluated = np.asarray(C, np.float64), dtype, 0

    def nearest(self, X: np.ndarray) -> np.ndarray:
        self.evaluated += len(X) * len(self.C)
        return scan_distances(X, self.C, self.dtype).argmin(1).astype(np.int32)


def searcher(C: np.ndarray, dtype=np.float64) -> CenterGroups | Scan:
    return CenterGroups(C, dtype) if len(C) >= MIN_CENTERS else Scan(C, dtype)

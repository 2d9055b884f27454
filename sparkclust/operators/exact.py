"""Sums of doubles that don't depend on their order.

A double is split without error into digits of 26 bits, ``x = sum(q_j * 2**(26 j))``. Digits
are whole numbers, so adding them up is exact in any order: in a task (float products of
whole numbers below 2**53, then 64-bit integers), between tasks (``sum`` of a LONG column)
and on the driver (Python integers). Only the finished sum is rounded, once, to a double.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

DIGIT_BITS = 26


def digits(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place j, whole numbers below 2**26 in size) of finite ``x``, highest place first."""
    rest = np.array(x, np.float64)
    while rest.size:
        top = float(np.abs(rest).max())
        if top == 0.0:
            return
        place = (int(np.frexp(top)[1]) - 1) // DIGIT_BITS
        shift = DIGIT_BITS * place
        # a product with a power of two is exact; beyond the doubles ldexp takes the two steps
        near = abs(shift) < 1000
        q = np.trunc(rest * 2.0**-shift if near else np.ldexp(rest, -shift))
        yield place, q
        rest -= q * 2.0**shift if near else np.ldexp(q, shift)


class ExactSums:
    """Sums of K rows of ``width`` numbers, kept as digits."""

    def __init__(self, k: int, width: int):
        self.shape = (k, width)
        self.places: dict[int, np.ndarray] = {}

    def at(self, place: int) -> np.ndarray:
        return self.places.setdefault(place, np.zeros(self.shape, np.int64))

    def add_dense(self, X: np.ndarray, row: np.ndarray) -> None:
        """Add each row of ``X`` (at most 2**26 of them at once) to the sums of its ``row``."""
        order = np.argsort(row, kind="stable")
        cuts = np.flatnonzero(np.diff(row[order], prepend=-1))
        to = row[order[cuts]]
        for place, q in digits(X):
            self.at(place)[to, : X.shape[1]] += np.add.reduceat(q[order], cuts, axis=0).astype(np.int64)

    def add_sparse(self, index: np.ndarray, values: np.ndarray) -> None:
        """Add ``values`` to the sums at flat positions ``index``."""
        size = self.shape[0] * self.shape[1]
        for place, q in digits(values):
            self.at(place)[:] += np.bincount(index, q, size).astype(np.int64).reshape(self.shape)

    def settle(self) -> dict[int, np.ndarray]:
        """The same sums with digits of at most 2**25 in size (what is beyond moves up a place)."""
        out, carry = {}, None
        places = sorted(self.places)
        while places:
            place = places.pop(0)
            v = self.places.get(place, 0) + (0 if carry is None else carry)
            up = (v + (1 << (DIGIT_BITS - 1))) >> DIGIT_BITS
            v = v - (up << DIGIT_BITS)
            if v.any():
                out[place] = v
            carry = up if up.any() else None
            if carry is not None and (not places or places[0] != place + 1):
                places.insert(0, place + 1)
        return out


def rounded(parts: dict[int, int]) -> float:
    """The double nearest to ``sum(q * 2**(26 place))``."""
    low = min(parts, default=0)
    whole = sum(q << (DIGIT_BITS * (place - low)) for place, q in parts.items())
    shift = DIGIT_BITS * low
    # a quotient of integers is rounded correctly
    return float(whole << shift) if shift >= 0 else whole / (1 << -shift)

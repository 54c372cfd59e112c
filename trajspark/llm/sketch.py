"""Percentiles of very large numeric columns by deterministic buffer collapsing.

A sketch holds at most `buffers` full buffers of `size` sorted values, each with a weight, and one
buffer being filled. When all are full, the buffers of the lowest level are collapsed into one:
their weighted values are merged and evenly spaced positions are kept. Every collapse adds at most
half its weight to the rank error, which the sketch adds up, so that each answer comes with
certain bounds. Sketches of separate pieces, partitions or days merge into one.
"""

import struct

import numpy as np


class QuantileSketch:
    """Weighted sorted buffers. `slack` bounds the rank error of any value read from the sketch."""

    __slots__ = ("size", "buffers", "full", "part", "n", "slack", "flip", "lo", "hi")

    def __init__(self, size: int = 2048, buffers: int = 8):
        if size < 2 or buffers < 2:
            raise ValueError("a sketch needs at least 2 buffers of at least 2 values")
        self.size, self.buffers = size, buffers
        self.full: list[tuple[int, int, np.ndarray]] = []  # level, weight, sorted values
        self.part: list[np.ndarray] = []  # unsorted values of weight 1, fewer than `size`
        self.n, self.slack, self.flip = 0, 0.0, 0
        self.lo, self.hi = np.inf, -np.inf

    def add(self, values: np.ndarray) -> "QuantileSketch":
        """Adds finite values; NaN and infinities are left out."""
        v = np.asarray(values, dtype=np.float64).ravel()
        v = v[np.isfinite(v)]
        if not len(v):
            return self
        self.n += len(v)
        self.lo, self.hi = min(self.lo, float(v.min())), max(self.hi, float(v.max()))
        self._fill(v)
        return self

    def _fill(self, v: np.ndarray) -> None:
        held = sum(map(len, self.part))
        while held + len(v) >= self.size:
            take = self.size - held
            self._push(0, 1, np.sort(np.concatenate([*self.part, v[:take]])))
            self.part, held, v = [], 0, v[take:]
        if len(v):
            self.part.append(v)

    def _push(self, level: int, weight: int, values: np.ndarray) -> None:
        self.full.append((level, weight, values))
        while len(self.full) > self.buffers:
            self._collapse()

    def _collapse(self) -> None:
        """Collapses the buffers of the lowest level, or of the two lowest if there is one alone."""
        self.full.sort(key=lambda b: b[0])
        low = self.full[0][0]
        many = [b for b in self.full if b[0] == low]
        if len(many) < 2:
            low = self.full[1][0]
            many = [b for b in self.full if b[0] <= low]
        rest = self.full[len(many) :]
        weight = sum(b[1] for b in many)
        values = np.concatenate([b[2] for b in many])
        order = np.argsort(values, kind="stable")
        ends = np.cumsum(np.repeat([b[1] for b in many], [len(b[2]) for b in many])[order])
        # evenly spaced positions; for even weights the two middles take turns
        offset = (weight + 1) // 2 if weight % 2 else weight // 2 + self.flip
        if weight % 2 == 0:
            self.flip ^= 1
        at = np.searchsorted(ends, np.arange(len(ends) and self.size) * weight + offset)
        self.full = [*rest, (low + 1, weight, values[order][np.minimum(at, len(order) - 1)])]
        self.slack += weight / 2

    def merge(self, other: "QuantileSketch") -> "QuantileSketch":
        """Takes in another sketch of the same buffer size; the error bounds add up."""
        if other.size != self.size:
            raise ValueError("sketches of different buffer sizes can't be merged")
        self.n, self.slack = self.n + other.n, self.slack + other.slack
        self.lo, self.hi = min(self.lo, other.lo), max(self.hi, other.hi)
        for b in other.full:
            self._push(*b)
        for p in other.part:
            self._fill(p)
        return self

    def _steps(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted values and the ranks (from 1) at which each one's weight ends."""
        parts = [(1, p) for p in self.part] + [(w, v) for _, w, v in self.full]
        if not parts:
            return np.zeros(0), np.zeros(0)
        values = np.concatenate([v for _, v in parts])
        order = np.argsort(values, kind="stable")
        return values[order], np.cumsum(np.repeat([w for w, _ in parts], [len(v) for _, v in parts])[order])

    def quantile(self, q: float) -> tuple[float, float, float]:
        """(estimate, least, greatest possible value) of the q-quantile, linearly interpolated.

        The exact quantile of all values added lies within the bounds. NaN if nothing was added.
        """
        values, ends = self._steps()
        if not len(values):
            return (float("nan"),) * 3
        at = (self.n - 1) * q
        low, frac = int(np.floor(at)), at - np.floor(at)
        rank = lambda r: float(values[min(int(np.searchsorted(ends, r)), len(values) - 1)])
        a, b = rank(low + 1), rank(min(low + 2, self.n))
        mid = a + (b - a) * frac
        if not self.slack:
            return mid, mid, mid
        # a stored value of weight w stands for w ranks, and its own may be off by the slack
        least = low + 1 - self.slack
        most = min(low + 2, self.n) + self.slack
        i = int(np.searchsorted(ends, least)) - 1
        j = int(np.searchsorted(ends, most)) + 1
        return mid, (float(values[i]) if i >= 0 else self.lo), (float(values[j]) if j < len(values) else self.hi)

    def dump(self) -> bytes:
        """A compact form: 32-bit values where these hold the numbers exactly."""
        part = np.concatenate(self.part) if self.part else np.zeros(0)
        blocks = [(0, 0, part)] + self.full
        exact = all(np.array_equal(v.astype(np.float32).astype(np.float64), v) for _, _, v in blocks)
        kind = np.float32 if exact else np.float64
        head = struct.pack("<iiqdddii?", self.size, self.buffers, self.n, self.slack, self.lo, self.hi, self.flip, len(blocks), exact)
        return head + b"".join(struct.pack("<iqi", lv, w, len(v)) + v.astype(kind).tobytes() for lv, w, v in blocks)

    @classmethod
    def load(cls, data: bytes) -> "QuantileSketch":
        size, buffers, n, slack, lo, hi, flip, count, exact = struct.unpack_from("<iiqdddii?", data)
        s, at = cls(size, buffers), struct.calcsize("<iiqdddii?")
        s.n, s.slack, s.lo, s.hi, s.flip = n, slack, lo, hi, flip
        kind = np.dtype(np.float32 if exact else np.float64)
        for i in range(count):
            level, weight, k = struct.unpack_from("<iqi", data, at)
            at += struct.calcsize("<iqi")
            v = np.frombuffer(data, kind, k, at).astype(np.float64)
            at += k * kind.itemsize
            if i:
                s.full.append((level, weight, v))
            elif k:
                s.part = [v]
        return s

"""Compressed bitmaps over ranges of 32,768 keys."""

import numpy as np

#: Keys of one container.
RANGE = 1 << 15
#: Up to so many keys a container holds the sorted positions, beyond that the bits.
SPARSE = RANGE // 16


class KeyBits:
    """One container: sorted 16-bit positions while sparse, a bit set when dense."""

    __slots__ = ("at", "bits")

    def __init__(self, at: np.ndarray | None = None, bits: np.ndarray | None = None):
        self.at, self.bits = at, bits

    @classmethod
    def of(cls, positions: np.ndarray) -> "KeyBits":
        p = np.unique(np.asarray(positions, dtype=np.uint16))
        if len(p) <= SPARSE:
            return cls(at=p)
        flags = np.zeros(RANGE, np.uint8)
        flags[p] = 1
        return cls(bits=np.packbits(flags, bitorder="little"))

    def _dense(self) -> np.ndarray:
        if self.bits is not None:
            return self.bits
        flags = np.zeros(RANGE, np.uint8)
        flags[self.at] = 1
        return np.packbits(flags, bitorder="little")

    def _holds(self, at: np.ndarray) -> np.ndarray:
        if self.at is not None:
            return np.isin(at, self.at, assume_unique=True)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def and_not(self, other: "KeyBits") -> "KeyBits":
        if self.at is not None:
            return KeyBits(at=self.at[~other._holds(self.at)])
        return KeyBits.of(np.flatnonzero(np.unpackbits(self.bits & ~other._dense(), bitorder="little")))

    def both(self, other: "KeyBits") -> "KeyBits":
        if self.at is not None:
            return KeyBits(at=self.at[other._holds(self.at)])
        if other.at is not None:
            return other.both(self)
        return KeyBits.of(np.flatnonzero(np.unpackbits(self.bits & other.bits, bitorder="little")))

    def decode(self) -> np.ndarray:
        return self.at if self.at is not None else np.flatnonzero(np.unpackbits(self.bits, bitorder="little")).astype(np.uint16)

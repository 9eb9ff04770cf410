"""Words and bytes of Arrow text columns, for Python workers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A-Z to a-z, all else unchanged.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: As LOWER, and every ASCII byte that is neither digit nor letter to a space.
ALNUM = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER)

_MULTIPLIER = 0x9E3779B97F4A7C15


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes, modulo 2**64, of fixed runs of hashed words.

    With an odd multiplier B, sum(h[k] * B**k) over a run differs between
    positions only by a power of B, which has an inverse, so that each run's
    hash comes from two prefix sums.
    """

    def __init__(self) -> None:
        self._powers = np.ones(1, np.uint64)
        self._inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._powers) < n:
            n = 1 << (n - 1).bit_length()
            b, inv = np.full(n, _MULTIPLIER, np.uint64), np.full(n, pow(_MULTIPLIER, -1, 1 << 64), np.uint64)
            b[0] = inv[0] = 1
            self._powers, self._inverse = np.multiply.accumulate(b), np.multiply.accumulate(inv)

    def runs(self, hashes: np.ndarray, width: int) -> np.ndarray:
        """The hash of each run of ``width`` words, by its first word."""
        n = len(hashes) - width + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        self._grow(len(hashes))
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self._powers[: len(hashes)], out=sums[1:])
        return mix64((sums[width:] - sums[:n]) * self._inverse[:n])

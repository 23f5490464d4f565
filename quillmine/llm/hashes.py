"""Vectorised rolling hashes and minimizers over flat arrays."""

from __future__ import annotations

import numpy as np

#: Odd bases; their powers have inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: A minimizer is chosen by the upper bits of its hash, then the leftmost.
INDEX_BITS = 28
_tables: dict[tuple[int, bool], np.ndarray] = {}


def _powers(base: int, n: int, inverse: bool) -> np.ndarray:
    """base ** 0 .. n-1 (or of its inverse) modulo 2**64; kept and lengthened as needed."""
    known = _tables.get((base, inverse))
    if known is None or len(known) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        size = 1 << max(16, (n - 1).bit_length())
        out = np.ones(size, np.uint64)
        have, factor = 1, step
        while have < size:
            out[have : 2 * have] = out[:have] * np.uint64(factor)
            have, factor = 2 * have, factor * factor & 0xFFFFFFFFFFFFFFFF
        known = _tables[base, inverse] = out
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values times powers of base: n+1 of them."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * _powers(base, len(values), False), out=out[1:])
    return out


def ranges(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of values[starts:ends] from prefix sums, wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _powers(base, len(sums), True)[starts] + (ends - starts).astype(np.uint64))


def sliding(sums: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hashes of all runs of width values."""
    n = max(0, len(sums) - width)
    return mix((sums[width:] - sums[:n]) * _powers(base, len(sums), True)[:n])


def window_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of width keys."""
    out, have = keys, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every run of width hashes, the place of the least (by its upper bits), the leftmost of equals. Empty if there are fewer.

    A place is packed into the INDEX_BITS lower bits; longer arrays are taken in pieces that overlap by width - 1."""
    most = 1 << INDEX_BITS
    if len(hashes) > most:
        step = most - width + 1
        return np.concatenate([at + minimizers(hashes[at : at + most], width) for at in range(0, len(hashes) - width + 1, step)])
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    low = np.uint64(most - 1)
    return (window_minimum((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), width) & low).astype(np.int64)

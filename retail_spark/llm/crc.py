"""CRC-32 of joined texts out of the CRC-32 of their parts."""

from __future__ import annotations

import zlib

import numpy as np

#: Bytes of a second part up to which shifts come from a table; longer ones are few and go one by one.
TABLED = 64

_TABLES: list[np.ndarray] = []


def _shifts() -> np.ndarray:
    """[n, k, b]: what byte k of a checksum, worth b, becomes when n zero bytes follow it.

    A zero byte moves a checksum eight bits on and adds the table entry of the byte that falls out. The entries are the
    eight bitwise steps of the checksum's polynomial.
    """
    if not _TABLES:
        entry = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            entry = np.where(entry & 1, (entry >> 1) ^ np.uint32(0xEDB88320), entry >> 1)
        steps = [np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)]
        for _ in range(TABLED):
            steps.append(entry[steps[-1] & 255] ^ (steps[-1] >> 8))
        _TABLES.append(np.stack(steps))
    return _TABLES[0]


def joined(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums of first + second for each place, from theirs; ``lengths`` are the second parts' bytes, TABLED at most."""
    t = _shifts()
    return t[lengths, 0, first & 255] ^ t[lengths, 1, (first >> 8) & 255] ^ t[lengths, 2, (first >> 16) & 255] ^ t[
        lengths, 3, first >> 24
    ] ^ second


def continued(first: int, second: bytes) -> int:
    """The checksum of a text of checksum ``first`` with ``second`` behind it."""
    return zlib.crc32(second, first)

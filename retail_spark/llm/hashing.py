"""Word and shingle hashes of many texts at once, in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes that are hashed together. Longer texts are taken in parts that end at white space.
PART = 1 << 20
#: Longer words are hashed by a library function, so that a part never has to hold a very long one.
LONG_WORD = 1 << 16

_U = np.uint64
_GOLDEN, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers, one to one."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


def seeds(n: int, start: int = 0) -> np.ndarray:
    """n fixed numbers without pattern."""
    return mixed((np.arange(start, start + n, dtype=_U) + _U(1)) * _GOLDEN)


_ROOT = 0xD1342543DE82EF95  # odd, so that its powers can be divided by
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = seeds(256, 1000)


def _powers(root: int, n: int) -> np.ndarray:
    out = np.full(n, root, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES["up"] = _powers(_ROOT, PART + 1)
        _TABLES["down"] = _powers(pow(_ROOT, -1, 1 << 64), PART + 1)
    return _TABLES["up"], _TABLES["down"]


def _part_hashes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of at most PART bytes: sum of table[byte] * root^place, moved to place 0."""
    up, down = _tables()
    word = np.zeros(len(x) + 2, np.int8)
    word[1:-1] = ~_SPACE[x]
    step = np.diff(word)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    total = np.zeros(len(x) + 1, _U)
    np.cumsum(_BYTE[x] * up[: len(x)], out=total[1:])
    hashes = mixed((total[ends] - total[starts]) * down[starts])
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        hashes[i] = _long_hash(x[starts[i] : ends[i]].tobytes())
    return hashes, starts, ends


def _long_hash(word: bytes) -> np.uint64:
    return _U(int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))


@dataclass
class Words:
    """The words of the texts first .. first + len(bounds) - 2: text i has hashes[bounds[i]:bounds[i + 1]]."""

    first: int
    hashes: np.ndarray
    bounds: np.ndarray
    tails: np.ndarray  # last byte * 256 + last but one of each word


def _tails(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    last = x[ends - 1].astype(np.uint16) if len(ends) else np.zeros(0, np.uint16)
    before = np.where(ends - starts > 1, x[np.maximum(ends - 2, 0)], 0).astype(np.uint16) if len(ends) else last
    return last * np.uint16(256) + before


def _long_text(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    hashes, tails, at = [], [], 0
    whole = np.frombuffer(raw, np.uint8)
    while at < len(raw):
        end = min(at + PART, len(raw))
        if end < len(raw):
            spaces = np.flatnonzero(_SPACE[whole[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            else:  # one word fills the part: find its end
                while end < len(raw) and not _SPACE[whole[end]]:
                    end += 1
                word = whole[at:end]
                hashes.append(np.array([_long_hash(word.tobytes())], _U))
                tails.append(_tails(word, np.array([0]), np.array([len(word)])))
                at = end
                continue
        part = whole[at:end]
        h, starts, ends = _part_hashes(part)
        hashes.append(h)
        tails.append(_tails(part, starts, ends))
        at = end
    return np.concatenate(hashes), np.concatenate(tails)


def words_of(texts: list[str | None]) -> Iterator[Words]:
    """Word hashes of all texts, in order; A-Z count as lower case, words stand between ASCII white space, null is empty."""
    held: list[bytes] = []
    first, size = 0, 0

    def together() -> Words:
        x = np.frombuffer(b" ".join(held) + b" ", np.uint8)
        offsets = np.zeros(len(held) + 1, np.int64)
        np.cumsum([len(r) + 1 for r in held], out=offsets[1:])
        hashes, starts, ends = _part_hashes(x)
        return Words(first, hashes, np.searchsorted(starts, offsets), _tails(x, starts, ends))

    for i, text in enumerate(texts):
        raw = (text or "").encode().lower()  # of bytes: A-Z only
        if held and size + len(raw) + 1 > PART:
            yield together()
            first, held, size = i, [], 0
        if len(raw) + 1 > PART:
            hashes, tails = _long_text(raw)
            yield Words(i, hashes, np.array([0, len(hashes)]), tails)
            first = i + 1
        else:
            held.append(raw)
            size += len(raw) + 1
    if held:
        yield together()


def shingles(words: Words, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the runs of k words of each text. With ``short`` a text of 1 to k - 1 words has one of all its words."""
    h, bounds = words.hashes, words.bounds
    sizes = np.diff(bounds)
    if len(h) >= k:
        total = np.zeros(len(h) - k + 1, _U)
        for i in range(k):
            total = total * _GOLDEN + h[i : len(h) - k + 1 + i]
        total = mixed(total)
    else:
        total = np.zeros(0, _U)
    counts = np.maximum(sizes - k + 1, 0)
    # text i keeps the runs that begin at bounds[i] .. bounds[i + 1] - k
    marks = np.zeros(len(h) + 2, np.int32)
    full = counts > 0
    np.add.at(marks, bounds[:-1][full], 1)
    np.add.at(marks, (bounds[:-1] + counts)[full], -1)
    keep = np.cumsum(marks)[: len(total)] > 0
    if not short or not ((sizes > 0) & (sizes < k)).any():
        out_bounds = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(counts, out=out_bounds[1:])
        return total[keep], out_bounds
    kept, pieces, at = total[keep], [], 0
    for i in range(len(sizes)):
        n = int(counts[i])
        if n:
            pieces.append(kept[at : at + n])
            at += n
        elif sizes[i]:
            value = _U(0)
            with np.errstate(over="ignore"):
                for x in h[bounds[i] : bounds[i + 1]]:
                    value = value * _GOLDEN + x
            pieces.append(mixed(np.array([value + _U(int(sizes[i]))], _U)))
        else:
            pieces.append(kept[:0])
    out_bounds = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum([len(p) for p in pieces], out=out_bounds[1:])
    return np.concatenate(pieces) if pieces else kept, out_bounds


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

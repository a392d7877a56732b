"""Locally consistent parsing of many texts at once, in numpy: deterministic coin tossing names phrases level by level."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from retail_spark.llm.hashing import mixed

#: Code points that are parsed together, so that their arrays stay in the processor's cache. A longer text is parsed alone.
PART = 1 << 17

_U = np.uint64
_CHILD, _RUN = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95)


def _bit_places() -> np.ndarray:
    """Place of a single set bit by the top six bits of its product with _SPREAD, which differ for all 64 places."""
    out = np.zeros(64, np.uint8)
    out[((_U(1) << np.arange(64, dtype=_U)) * _SPREAD) >> _U(58)] = np.arange(64)
    return out


_SPREAD = _U(0x03F79D71B4CB0A89)  # a de Bruijn sequence of 64 bits
_PLACES = _bit_places()


#: Rounds of coin tossing: names of 64 bits become labels under 128, then 14, 8 and 6.
ROUNDS = 4


@dataclass
class Level:
    """The phrases of one level, text by text: names, the code point each begins at, and whether it is the first of its text."""

    names: np.ndarray
    begins: np.ndarray
    first: np.ndarray
    size: int  # code points in all

    def spans(self) -> np.ndarray:
        """Code points that each phrase covers."""
        return np.diff(self.begins, append=self.size)

    def owners(self) -> np.ndarray:
        """The text of each phrase, empty texts not counted."""
        return np.cumsum(self.first) - 1


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels under 6 that differ between neighbours of a text and depend on the ROUNDS names before each place only.

    A round gives each place twice the number of the lowest bit in which it differs from its left neighbour, plus that
    bit. A text's first place has no neighbour and takes its second place's bit number. ``first`` marks first places;
    neighbours within a text differ.
    """
    starts = np.flatnonzero(first)
    seconds = np.minimum(starts + 1, len(names) - 1)
    seconds = np.where(first[seconds], starts, seconds)  # a text of one name is its own neighbour

    def lowest(labels: np.ndarray) -> np.ndarray:
        """The lowest bit in which each place differs from its left neighbour."""
        differing = labels.copy()
        differing[1:] ^= labels[:-1]
        differing[starts] = np.where(seconds == starts, 1, differing[seconds])
        return differing & (~differing + labels.dtype.type(1))

    bit = lowest(names)
    place = _PLACES.take(((bit * _SPREAD) >> _U(58)).view(np.int64), mode="clip")
    labels = place + place + ((names & bit) != 0).view(np.uint8)
    for bits in (7, 4, 3):
        bit = lowest(labels)
        place = np.zeros(len(bit), np.uint8)
        for k in range(bits - 1):
            place += (bit > (1 << k)).view(np.uint8)
        labels = place + place + ((labels & bit) != 0).view(np.uint8)
    return labels


def _without_runs(level: Level) -> Level:
    """Equal neighbours of a text become one name, made of theirs and of how many they are."""
    new = level.first.copy()
    new[1:] |= level.names[1:] != level.names[:-1]
    if new.all():
        return level
    at = np.flatnonzero(new)
    times = np.diff(at, append=len(new))
    names = level.names[at]
    many = np.flatnonzero(times > 1)
    names[many] = mixed(names[many] * _RUN + times[many].astype(_U))
    return Level(names, level.begins[at], level.first[at], level.size)


def next_level(level: Level) -> Level:
    """Cuts each text's names before the local maxima of their labels and names the pieces after their parts.

    A piece has 1 to 12 parts. Its cuts depend on ROUNDS names to the left and one to the right, so equal stretches of
    two texts are cut alike but for a few names at their ends. A text of one name keeps it.
    """
    level = _without_runs(level)
    names, first = level.names, level.first
    last = np.ones(len(names), bool)
    last[:-1] = first[1:]
    labels = _labels(names, first)
    rises = labels[1:] > labels[:-1]
    cut = np.zeros(len(names), bool)
    cut[1:-1] = rises[:-1] & ~rises[1:]  # neighbours differ
    cut &= ~last
    cut |= first
    at = np.flatnonzero(cut)
    sizes = np.diff(at, append=len(names))
    made = names[at] + sizes.astype(_U)
    for k in range(1, int(sizes.max(initial=0))):
        longer = np.flatnonzero(sizes > k)
        made[longer] = made[longer] * _CHILD + names[at[longer] + k]
    made = mixed(made)
    alone = np.flatnonzero(first & last)  # texts of one name
    if len(alone):
        made[np.searchsorted(at, alone)] = names[alone]
    return Level(made, level.begins[at], first[at], level.size)


def levels(texts: list[str]) -> Iterator[Level]:
    """The phrases of every level above the code points, up to where each text is one name. Empty texts have none."""
    whole = "".join(texts)
    if not whole:
        return
    sizes = np.array([len(t) for t in texts if t])
    first = np.zeros(len(whole), bool)
    first[np.cumsum(sizes) - sizes] = True
    names = (np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(_U) + _U(1)) * _RUN
    level = Level(names, np.arange(len(names)), first, len(names))
    while True:
        level = next_level(level)
        yield level
        if len(level.names) == len(sizes):
            return


def parts(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts) of runs of texts that are parsed together."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > PART:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, texts[start:]

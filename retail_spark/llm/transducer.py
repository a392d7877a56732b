"""A minimal acyclic transducer: sorted terms in, each term's place among them out."""

from __future__ import annotations

import pickle
from collections.abc import Iterable

import numpy as np


class Transducer:
    """Maps each of its terms (bytes) to its lexicographic ordinal, and every other to None.

    States are shared by all terms whose endings agree, so the machine is minimal. An arc carries how many terms of its
    state come before those behind it; the sum along a term's path is its ordinal.
    """

    def __init__(self, arcs: list[dict[int, tuple[int, int]]], final: list[bool], root: int, size: int):
        self.arcs, self.final, self.root, self.size = arcs, final, root, size

    def ordinal(self, term: bytes) -> int | None:
        state, total, arcs = self.root, 0, self.arcs
        for byte in term:
            arc = arcs[state].get(byte)
            if arc is None:
                return None
            state = arc[0]
            total += arc[1]
        return total if self.final[state] else None

    def dumps(self) -> bytes:
        return pickle.dumps((self.arcs, self.final, self.root, self.size), protocol=5)

    @staticmethod
    def loads(data: bytes) -> Transducer:
        return Transducer(*pickle.loads(data))


def build(terms: Iterable[bytes]) -> Transducer:
    """The transducer of distinct terms that come in byte order.

    The path of the last term is kept open. When the next one leaves it, the states behind the fork can gain no more
    arcs and are frozen from the end: a state with the arcs and finality of a frozen one is replaced by that.
    """
    arcs: list[dict[int, tuple[int, int]]] = []
    final: list[bool] = []
    below: list[int] = []  # terms accepted from each frozen state
    known: dict[tuple, int] = {}

    def freeze(open_arcs: list[tuple[int, int]], ends: bool) -> int:
        shape = (ends, *open_arcs)
        state = known.get(shape)
        if state is None:
            state = known[shape] = len(arcs)
            made, total = {}, int(ends)
            for byte, target in open_arcs:
                made[byte] = (target, total)
                total += below[target]
            arcs.append(made)
            final.append(ends)
            below.append(total)
        return state

    path: list[tuple[list[tuple[int, int]], bool]] = [([], False)]  # arcs and finality of the open states
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            state = freeze(*path.pop())
            path[-1][0].append((last[len(path) - 1], state))

    for n, term in enumerate(terms):
        if n and term <= last:
            raise ValueError("terms must be distinct and in byte order")
        shared = 0
        while shared < len(last) and last[shared] == term[shared]:
            shared += 1
        close(shared)
        for _ in range(shared, len(term)):
            path.append(([], False))
        path[-1] = (path[-1][0], True)
        last = term
    close(0)
    root = freeze(*path.pop())
    return Transducer(arcs, final, root, below[root])


def packed(machines: dict[str, tuple[bytes, bytes]]) -> bytes:
    """Machines by language, each as ``dumps`` gives it, beside the numbers its ordinals stand for (int64)."""
    return pickle.dumps(machines, protocol=5)


def unpacked(data: bytes) -> dict[str, tuple[Transducer, np.ndarray]]:
    return {key: (Transducer.loads(m), np.frombuffer(o, np.int64)) for key, (m, o) in pickle.loads(data).items()}

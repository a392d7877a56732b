"""Substring dedup by collinear chaining: shared k-mer seeds, chained with gap costs in a Fenwick tree, aligned into fuzzy passages."""

from __future__ import annotations

import gc
import math
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_spark.llm.common import NO_ID
from retail_spark.llm.hashing import Words, mixed, shingles, signed, words_of
from retail_spark.session import discard, materialise

#: Words in a seed, and seeds of which the least hash is taken: any SEED + WINDOW - 1 words in common share a seed, and
#: as WINDOW is at most SEED, seeds leave no word between them out.
SEED, WINDOW = 5, 5
#: Words that a passage has at least, and the share of them that must be equal on both sides.
MIN_WORDS, MIN_EQUAL = 50, 0.8
#: A seed adds SEED to a chain; each word of the step to it, on both sides together, costs GAP. Steps of 25 words a side cost what a seed gives.
GAP = 0.1
#: Beyond the chain's ends: points for equal words and for words changed, inserted or deleted, and the loss at which the search stops.
EQUAL, OTHER, DROP = 1, -2, 16
#: A stretch between seeds of more words than this with fewer than half of them equal parts two passages.
BREAK = 25

_U = np.uint64
_TOP = _U(0xFFFFFFFFFFFFFFFF)
MATCHED, END, SHARED = 0, 1, 2
#: Words from a seed's start on that its occurrences are told apart by, besides the seed itself. Any two texts with MIN_WORDS +
#: WINDOW - 1 equal words in a row have a seed in common with at least MIN_WORDS equal words.
NEAR, LONG, WHOLE = 16, MIN_WORDS - WINDOW + 1, MIN_WORDS


# --- seeds -------------------------------------------------------------------------------------------


def minimizers(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places of the k-mers that are least in some window of WINDOW k-mers of their text.

    A k-mer equal to the one before it (one word over and over) is not taken.
    """
    if not len(hashes):
        return np.zeros(0, np.int64)
    values = hashes >> _U(1)
    values[1:][hashes[1:] == hashes[:-1]] = _TOP
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    # each text is followed by WINDOW - 1 places that are never least
    shift = np.zeros(len(sizes), np.int64)
    shift[full] = np.arange(len(full)) * (WINDOW - 1)
    at = np.arange(len(values)) + np.repeat(shift, sizes)
    padded = np.full(len(values) + len(full) * (WINDOW - 1), _TOP)
    padded[at] = values
    windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)
    picked = np.zeros(len(padded), bool)
    least = windows[at].argmin(axis=1) if len(full) > 64 else windows.argmin(axis=1)[at]
    picked[at + least] = True
    return np.flatnonzero(picked[at] & (values != _TOP))


def run_hashes(words: Words, k: int, places: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Hashes, never 0, of the k words from each place of the batch on; 0 where its text has fewer than that."""
    if len(words.hashes) < k:
        return np.zeros(len(places), _U)
    run, n, total, done = words.hashes, 1, np.zeros(len(places), _U), 0
    times = _U(0x9E3779B97F4A7C15)
    factor = times  # times ** n
    with np.errstate(over="ignore"):
        while True:
            if k & n:  # append the run of n words to the one so far
                total, done = total * factor + run[np.minimum(places + done, len(run) - 1)], done + n
            n *= 2
            if n > k:
                break
            run = run[: len(run) - n // 2] * factor + run[n // 2 :]
            factor = factor * factor
    return np.where(room >= k, mixed(total) | _U(1), _U(0))


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds of all texts: key holds 40 bits of the seed and 24 of its NEAR words, ctx 16 of its LONG and 16 of its WHOLE words."""
    for batch in batches:
        docs = batch.column(0).to_numpy()
        for words in words_of(batch.column(1).to_pylist()):
            hashes, bounds = shingles(words, SEED, short=False)
            places = minimizers(hashes, bounds)
            text = np.searchsorted(bounds, places, side="right") - 1
            at = places - bounds[text]
            start, room = words.bounds[text] + at, np.diff(words.bounds)[text] - at
            near, long, whole = (run_hashes(words, k, start, room) for k in (NEAR, LONG, WHOLE))
            bits = lambda h, n: (h & _U((1 << n) - 1))  # noqa: E731  # the last bit is set unless the run is cut off
            key = (hashes[places] >> _U(24) << _U(24)) | bits(near, 24)
            ctx = (bits(long, 16) << _U(16)) | bits(whole, 16)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(key)),
                    pa.array(ctx.astype(np.uint32).view(np.int32)),
                    pa.array(docs[words.first + text]),
                    pa.array(at.astype(np.int32)),
                ],
                names=["key", "ctx", "doc", "at"],
            )


Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # key, ctx, doc, at


def _levels(rows: Rows) -> list[np.ndarray]:
    """The number of each row's group, by WHOLE, LONG and NEAR words and by the seed; rows come in order."""
    key, ctx = rows[0], rows[1]
    changed = np.zeros(len(key), bool)
    parts = [key >> 24, key, ctx >> 16, ctx]
    out = []
    for part in parts:
        changed = changed.copy()
        changed[1:] |= part[1:] != part[:-1]
        out.append(np.cumsum(changed))
    return out[::-1]


def _least(groups: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each row the row of the smallest document so far in its group."""
    n = len(docs)
    order = np.argsort(docs, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    return order[np.minimum.accumulate(rank - groups * n) + groups * n]


def links(rows: Rows) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(row, other row) pairs to be matched among rows in order of (key, ctx, doc, at), and per level each row's least one so far.

    A row is linked with the smallest document before it that has the same WHOLE words from
    the seed on, else LONG words, else NEAR words, and the seed. The longer ones settle it only if that document is
    smaller: so at each level every row but those of the smallest document gets a smaller one.
    """
    key, ctx, doc = rows[0], rows[1], rows[2]
    valid = [(ctx & 0xFFFF) != 0, (ctx >> 16) != 0, (key & 0xFFFFFF) != 0, np.ones(len(key), bool)]
    free = np.ones(len(key), bool)
    pairs, least = [], []
    for level, (groups, long_enough) in enumerate(zip(_levels(rows), valid, strict=True)):
        least.append(_least(groups, doc))
        before = np.full(len(key), -1)
        same = np.flatnonzero(groups[1:] == groups[:-1]) + 1
        before[same] = least[-1][same - 1]
        linked = free & long_enough & (before >= 0)
        linked[linked] = doc[before[linked]] != doc[linked]
        at = np.flatnonzero(linked)
        pairs.append(np.stack([at, before[at]], axis=1))
        if level < 2:
            free[at[doc[before[at]] < doc[at]]] = False
    found = np.unique(np.concatenate(pairs), axis=0)
    return found[:, 0], found[:, 1], least


def _matched(rows: Rows, one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
    """doc, first_doc, at, first_at of linked rows; the smaller document is the first."""
    _, _, doc, at = rows
    one, two = np.where(doc[one] > doc[two], one, two), np.where(doc[one] > doc[two], two, one)
    return [doc[one], doc[two], at[one], at[two]]


def _taken(rows: Rows, places: np.ndarray) -> Rows:
    return tuple(c[places] for c in rows)


def _joined(*parts: Rows) -> Rows:
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _in_order(rows: Rows) -> Rows:
    return _taken(rows, np.lexsort((rows[3], rows[2], rows[1], rows[0])))


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches among rows in order of (key, ctx, doc, at).

    Groups may go on beyond the ends of a partition, so the smallest document of its first and last group of
    each level is left as END: linked among themselves they join the partitions.
    """
    names = ["key", "ctx", "doc", "at", "first_doc", "first_at", "fate"]

    def out(key, ctx, doc, first_doc, at, first_at, fate) -> pa.RecordBatch:
        arrays = [key, ctx, doc, at, first_doc, first_at, np.full(len(doc), fate, np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=names)

    held: Rows | None = None  # the least rows of the last groups so far
    head: Rows | None = None  # the least rows of the first groups so far
    first_open = True
    for batch in batches:
        rows = tuple(batch.column(i).to_numpy() for i in range(4))
        if not len(rows[0]):
            continue
        n = len(held[0]) if held else 0
        rows = _joined(held, rows) if held else rows
        one, two, least = links(rows)
        new = one >= n
        if new.any():
            match = _matched(rows, one[new], two[new])
            yield out(np.zeros(len(match[0]), np.int64), np.zeros(len(match[0]), np.int32), *match, MATCHED)
        if first_open:
            seen = _in_order(_joined(head, rows)) if head else rows
            places = [x[np.flatnonzero(g == g[0])[-1]] for g, x in zip(_levels(seen), links(seen)[2], strict=True)]
            first_open = (rows[0][-1] >> 24) == (seen[0][0] >> 24)
            head = _taken(seen, np.unique([0, *places]))
        held = _taken(rows, np.unique([x[-1] for x in least]))
    if held:
        ends = _in_order(_joined(head, held))
        yield out(ends[0], ends[1], ends[2], ends[2], ends[3], ends[3], END)


def _shared(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows of seeds that stand more than once. The batch's first and last seed may go on beyond it, so their rows stay."""
    seed = batch.column(0).to_numpy() >> 24
    again = seed[1:] == seed[:-1]
    kept = (seed == seed[:1]) | (seed == seed[-1:])
    kept[1:] |= again
    kept[:-1] |= again
    key, ctx, doc, at = batch.filter(pa.array(kept)).columns
    return pa.RecordBatch.from_arrays(
        [key, ctx, doc, at, doc, at, pa.array(np.full(len(doc), SHARED, np.int32))],
        names=["key", "ctx", "doc", "at", "first_doc", "first_at", "fate"],
    )


def _firsts_and_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``_firsts`` gives, and as SHARED the rows of every seed that stands more than once."""
    noted: list[pa.RecordBatch] = []

    def read() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                noted.append(_shared(batch))
            yield batch

    for out in _firsts(read()):
        yield out
        while noted:
            yield noted.pop()
    yield from noted


CHAINS = "doc bigint, first_doc bigint, points binary, sizes binary"


# --- chains ------------------------------------------------------------------------------------------


class BestBelow:
    """A Fenwick tree: the largest value, with its place, among ranks below a given one."""

    def __init__(self, n: int):
        self.n, self.best = n, [(float("-inf"), -1)] * (n + 1)

    def put(self, rank: int, value: float, place: int) -> None:
        rank += 1
        while rank <= self.n:
            if value > self.best[rank][0]:
                self.best[rank] = (value, place)
            rank += rank & -rank

    def below(self, rank: int) -> tuple[float, int]:
        found = (float("-inf"), -1)
        while rank > 0:
            if self.best[rank][0] > found[0]:
                found = self.best[rank]
            rank -= rank & -rank
        return found


def chains(xs: list[int], ys: list[int]) -> list[list[int]]:
    """Places of the seeds of each chain, of one seed or more: strictly rising on both sides, best scores first, no seed in two chains.

    The cost of a step is linear on each side, so the best seed to come from
    is a prefix maximum of score + GAP (x + y) over smaller y, among those of smaller x.
    """
    ranks = {y: r for r, y in enumerate(sorted(set(ys)))}
    tree = BestBelow(len(ranks))
    scores, came = [0.0] * len(xs), [-1] * len(xs)
    order = sorted(range(len(xs)), key=lambda i: (xs[i], ys[i]))
    waiting: list[int] = []
    for i in order:
        if waiting and xs[waiting[0]] < xs[i]:
            for j in waiting:
                tree.put(ranks[ys[j]], scores[j] + GAP * (xs[j] + ys[j]), j)
            waiting = []
        value, j = tree.below(ranks[ys[i]])
        gain = value - GAP * (xs[i] + ys[i])
        scores[i], came[i] = (SEED + gain, j) if gain > 0 else (float(SEED), -1)
        waiting.append(i)
    used, out = [False] * len(xs), []
    for i in sorted(range(len(xs)), key=lambda i: (-scores[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = came[i]
        if chain:
            out.append(chain[::-1])
    return out


def ends_of_runs(points: np.ndarray) -> np.ndarray:
    """The first and the last seed of each run of touching seeds on one diagonal: what is between is equal, too."""
    x, diagonal = points[:, 0], points[:, 1].astype(np.int64) - points[:, 0]
    order = np.lexsort((x, diagonal))
    apart = (np.diff(diagonal[order]) != 0) | (np.diff(x[order].astype(np.int64)) > SEED)
    ends = np.append(True, apart) | np.append(apart, True)
    return points[order[ends]]


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of each pair of documents, from matches in order of the pair: one row per pair that has any."""
    rows: list[tuple] = []
    held: list[tuple[np.ndarray, ...]] = []

    def close(parts) -> None:
        a, b, x, y = (np.concatenate(c) for c in zip(*parts, strict=True))
        points = ends_of_runs(np.unique(np.stack([x, y], axis=1), axis=0))  # repeated rows repeat their matches
        x, y = points[:, 0].tolist(), points[:, 1].tolist()
        found = chains(x, y)
        flat = np.array([(x[i], y[i]) for c in found for i in c], np.int32)
        rows.append((int(a[0]), int(b[0]), flat.tobytes(), np.array([len(c) for c in found], np.int32).tobytes()))

    def single(a: np.ndarray, b: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
        """Pairs of one match: that is their chain."""
        offsets = pa.py_buffer(np.arange(0, 8 * len(a) + 1, 8, dtype=np.int32).tobytes())
        flat = pa.BinaryArray.from_buffers(pa.binary(), len(a), [None, offsets, pa.py_buffer(points.tobytes())])
        sizes = pa.array([np.array([1], np.int32).tobytes()], pa.binary()).take(pa.array(np.zeros(len(a), np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), flat, sizes], names=["doc", "first_doc", "points", "sizes"])

    def out() -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        rows.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc", "first_doc", "points", "sizes"]
        )

    for batch in batches:
        a, b, x, y = (batch.column(i).to_numpy() for i in range(4))
        if not len(a):
            continue
        new = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
        cuts = np.concatenate([[0], new, [len(a)]])
        alone = np.flatnonzero(np.diff(cuts) == 1)
        alone = cuts[alone[(alone > 0) & (alone < len(cuts) - 2)]]  # the first and the last pair may go on in other batches
        if len(alone):
            points = np.stack([x[alone], y[alone]], axis=1).astype(np.int32)
            yield single(a[alone], b[alone], points)
        many = np.diff(cuts) > 1
        many[[0, -1]] = True
        for k in np.flatnonzero(many):
            s, e = int(cuts[k]), int(cuts[k + 1])
            part = (a[s:e], b[s:e], x[s:e], y[s:e])
            if held and (held[-1][0][-1] != a[s] or held[-1][1][-1] != b[s]):
                close(held)
                held = []
            held.append(part)
        if len(rows) > 2000:
            yield out()
    if held:
        close(held)
    yield out()


# --- alignment ---------------------------------------------------------------------------------------


def _slide(a: memoryview, b: memoryview, i: int, j: int) -> int:
    """Equal words of two texts from places i and j on."""
    n, start = min(len(a) - i, len(b) - j), i
    stop = i + min(n, 16)
    while i < stop and a[i] == b[j]:
        i, j = i + 1, j + 1
    if i < stop or stop - start == n:
        return i - start
    size, n = 64, n - 16
    while n:
        size = min(size * 2, n)
        other = np.flatnonzero(np.asarray(a[i : i + size]) != np.asarray(b[j : j + size]))
        if len(other):
            return i + int(other[0]) - start
        i, j, n = i + size, j + size, n - size
    return i - start


def extend(a: np.ndarray, b: np.ndarray, other: int, drop: int, whole: bool = False) -> tuple[int, int, int, bool] | None:
    """(words, words of the other side, equal words, whether a's end was tried) of the best alignment that begins where both stretches begin.

    Words may be changed, inserted or deleted: for each number of edits the furthest place on each diagonal is
    kept, and equal words are run over at once. A diagonal is left when its points, EQUAL per equal word
    and ``other`` per edit, are more than ``drop`` under the best, so the work grows with the
    edits, not with the product of the lengths. With ``whole`` the alignment ends where both stretches end, or is None.
    """
    va, vb, n, m = memoryview(a), memoryview(b), len(a), len(b)
    got = _slide(va, vb, 0, 0)
    best, end = got * EQUAL, (got, got, got)
    reach, edits, ended = {0: (got, got)}, 0, got == n  # diagonal -> place, equal words
    while reach:
        if whole and m - n in reach and reach[m - n][0] == n:
            return n, m, reach[m - n][1], True
        edits += 1
        tried: dict[int, tuple[int, int]] = {}
        for k, (i, equal) in reach.items():
            j = i + k
            for d, to in ((k, i + 1), (k + 1, i), (k - 1, i + 1)):  # a word changed, inserted, deleted
                if to <= n and to + d <= m and (i < n or j < m) and (d not in tried or tried[d] < (to, equal)):
                    tried[d] = (to, equal)
        reach = {}
        for k, (i, equal) in tried.items():
            got = _slide(va, vb, i, i + k)
            i, equal = i + got, equal + got
            score = equal * EQUAL + edits * other
            if score < best - drop:
                continue
            reach[k] = (i, equal)
            ended |= i == n
            if score > best:
                best, end = score, (i, i + k, equal)
    return None if whole else (*end, ended)


def _common_words(a: np.ndarray, b: np.ndarray) -> int | None:
    """Equal words, in order, of two stretches between seeds; None if a part of more than BREAK words has fewer than half of them equal."""
    found = extend(a, b, -EQUAL, 2 * BREAK, whole=True)
    return None if found is None else found[2]


def align(
    a: np.ndarray, b: np.ndarray, points: list[tuple[int, int]], ended: list[tuple[bool, bool]] | None = None
) -> list[tuple[int, int, int, int, int]]:
    """Passages (start, end, other start, other end, equal words) along one chain of seeds.

    Seeds are equal by their words, checked here. Stretches between them and beyond the ends are
    aligned with gaps, at every size. Poor stretches part passages. ``ended`` gets, for each, whether
    the start and the end of ``a`` were tried.
    """
    points = [p for p in points if np.array_equal(a[p[0] : p[0] + SEED], b[p[1] : p[1] + SEED]) and p[0] + SEED <= len(a)]
    if not points:
        return []
    runs = [[points[0], points[0], SEED]]
    for x, y in points[1:]:
        (x0, y0), equal = runs[-1][1], runs[-1][2]
        dx, dy = x - x0, y - y0
        if dx == dy and np.array_equal(a[x0:x], b[y0:y]):
            runs[-1][1:] = [(x, y), equal + dx]
            continue
        if dx < SEED or dy < SEED:  # seeds overlap on one side: count the step's shorter side
            runs[-1][1:] = [(x, y), equal + min(dx, dy)]
            continue
        gap = max(dx, dy) - SEED
        got = _common_words(a[x0 + SEED : x], b[y0 + SEED : y])
        if got is None or gap > BREAK and got * 2 < gap:
            runs.append([(x, y), (x, y), SEED])
        else:
            runs[-1][1:] = [(x, y), equal + got + SEED]
    out = []
    for (x0, y0), (x1, y1), equal in runs:
        left, other_left, more, at_start = extend(a[:x0][::-1], b[:y0][::-1], OTHER, DROP)
        right, other_right, after, at_end = extend(a[x1 + SEED :], b[y1 + SEED :], OTHER, DROP)
        out.append((x0 - left, x1 + SEED + right, y0 - other_left, y1 + SEED + other_right, equal + more + after))
        if ended is not None:
            ended.append((at_start, at_end))
    return out


def filled(a: np.ndarray, b: np.ndarray, passage: tuple, min_words: int, min_equal: float) -> tuple | None:
    """The passage if it has min_words words with min_equal equal ones, if need be with changed words at its ends.

    An alignment stops at its last equal word, but the words that stand beside it on both sides belong to
    a passage of min_words words as far as enough of them are equal.
    """
    x0, x1, y0, y1, equal = passage
    lacks = max(0, min_words - min(x1 - x0, y1 - y0))
    if equal + lacks < min_equal * (max(x1 - x0, y1 - y0) + lacks):
        return None
    right, left = min(lacks, len(a) - x1, len(b) - y1), min(lacks, x0, y0)
    if left + right < lacks:
        return None
    after, before = np.zeros(right + 1, np.int64), np.zeros(left + 1, np.int64)
    np.cumsum(a[x1 : x1 + right] == b[y1 : y1 + right], out=after[1:])
    np.cumsum(a[x0 - left : x0][::-1] == b[y0 - left : y0][::-1], out=before[1:])
    ways = np.arange(lacks - left, right + 1)  # words taken behind the passage; the others stand before it
    gains = after[ways] + before[lacks - ways]
    right, equal = int(ways[gains.argmax()]), equal + int(gains.max())
    left = lacks - right
    if equal < min_equal * max(x1 - x0 + lacks, y1 - y0 + lacks):
        return None
    return x0 - left, x1 + right, y0 - left, y1 + right, equal


def _deflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor()
    for batch in batches:
        texts = [pack.compress((t or "").encode()) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc", "text"])


def _hashes(text: bytes) -> np.ndarray:
    """Word hashes of a deflated text."""
    parts = [w.hashes for w in words_of([zstandard.ZstdDecompressor().decompress(text).decode()])]
    return parts[0]


FOUND = (
    ("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("source_doc_id", pa.int64()),
    ("source_start", pa.int64()), ("source_end", pa.int64()), ("equal", pa.float64()),
)


def _chain_points(row: dict) -> list[list[tuple[int, int]]]:
    points = np.frombuffer(row["points"], np.int32).reshape(-1, 2)
    ends = np.cumsum(np.frombuffer(row["sizes"], np.int32)).tolist()
    return [list(map(tuple, points[s:e].tolist())) for s, e in zip([0, *ends], ends)]  # noqa: B905


def _cut(margin: int):
    """Adds to each pair what it needs of its document's words: ``margin`` of them around a few short chains, else the text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            near, texts = [], []
            for row in batch.to_pylist():
                found = _chain_points(row)
                if margin and len(found) <= 4 and all(c[-1][0] - c[0][0] < margin for c in found):
                    key = (row["doc"], row["a"])
                    if key != last:
                        last, own = key, _hashes(row["a"]).astype(np.uint32)
                    places = [(max(0, c[0][0] - margin), min(len(own), c[-1][0] + SEED + margin)) for c in found]
                    head = np.array([len(own), *(x for p in places for x in p)], np.int32).tobytes()
                    near.append(head + b"".join(own[s:e].tobytes() for s, e in places))
                    texts.append(None)
                else:
                    near.append(None)
                    texts.append(row["a"])
            kept = [batch.column(i) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(near, pa.binary()), pa.array(texts, pa.binary())],
                names=["doc", "first_doc", "points", "sizes", "near", "a"],
            )

    return work


def _excerpts(near: bytes, n: int) -> tuple[int, list[tuple[int, np.ndarray]]]:
    """Words of the text, and (first place, word hashes) of each of n excerpts."""
    size, *places = np.frombuffer(near[: 4 * (2 * n + 1)], np.int32).tolist()
    words, out, at = np.frombuffer(near[4 * (2 * n + 1) :], np.uint32), [], 0
    for s, e in zip(places[::2], places[1::2], strict=True):
        out.append((s, words[at : at + e - s]))
        at += e - s
    return size, out


def _aligned(min_words: int, min_equal: float):
    """Passages of each pair. A pair whose alignment comes to an excerpt's end within the text is left open, to be aligned over the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, source, short = None, None, None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                key = (row["first_doc"], row["b"])
                if key != last:
                    last, source = key, _hashes(row["b"])
                    short = source.astype(np.uint32)
                found, is_open, chains_of = set(), False, _chain_points(row)
                if row["near"] is None:
                    own, other = _hashes(row["a"]), source
                    parts, size = [(0, own)] * len(chains_of), len(own)
                else:
                    size, parts = _excerpts(row["near"], len(chains_of))
                    other = short
                for chain, (first, own) in zip(chains_of, parts, strict=True):
                    ended: list[tuple[bool, bool]] = []
                    passages = align(own, other, [(x - first, y) for x, y in chain], ended)
                    is_open |= any((at_start and first > 0) or (at_end and first + len(own) < size) for at_start, at_end in ended)
                    for passage in passages:
                        whole = filled(own, other, passage, min_words, min_equal)
                        if whole:
                            x0, x1, y0, y1, equal = whole
                            share = equal / max(x1 - x0, y1 - y0)
                            found.add((row["doc"], first + x0, first + x1, row["first_doc"], y0, y1, min(1.0, share)))
                rows += [(row["doc"], None, None, row["first_doc"], None, None, None)] if is_open else sorted(found)
            columns = list(zip(*rows, strict=True)) or [[]] * len(FOUND)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, (_, t) in zip(columns, FOUND, strict=True)], names=[n for n, _ in FOUND]
            )

    return work


# --- pairs of one seed -------------------------------------------------------------------------------

def words_beyond(min_words: int, min_equal: float) -> int:
    """Equal words beside its one seed that a passage has at least, on both sides together.

    An alignment ends where its points are best, so of r words beyond that at most two thirds are equal, and n aligned equal words
    filled up to min_words have n + 2/3 (min_words - n) equal ones at most. That must reach min_equal of min_words.
    """
    return max(0, math.ceil(round((min_equal - 2 / 3) * min_words * 3, 6)) - SEED)


def edits_to(beyond: int) -> int:
    """Edits up to which so many equal words can be met before the points are DROP under 0."""
    return (beyond + DROP) // -OTHER


def _taken_apart(lone: bool):
    """The chains of one seed, a row each; or the other chains of each pair that has any."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.array([1], np.int32).tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc, first_doc, points, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sizes = np.frombuffer(sizes, np.int32)
                points = np.frombuffer(points, np.int32).reshape(-1, 2)
                single = np.repeat(sizes == 1, sizes)
                if lone:
                    out += [(doc, first_doc, p.tobytes(), one) for p in points[single]]
                elif not single.all():
                    out.append((doc, first_doc, points[~single].tobytes(), sizes[sizes > 1].tobytes()))
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc", "first_doc", "points", "sizes"]
            )

    return work


def most_equal(a: np.ndarray, b: np.ndarray, beyond: int) -> np.ndarray:
    """For each row the most equal words, up to ``beyond``, that ``extend`` can have met before it stops: never too few.

    ``a`` has as many words a row as that takes and ``b`` as many more as there are edits; places without a word hold numbers that are
    equal to none. All rows go through the edits together: for each number of edits the furthest place on every diagonal
    and its equal words.
    """
    edits_most, side = edits_to(beyond), a.shape[1]
    n = len(a)
    shifted = np.pad(b, ((0, 0), (edits_most, 0)), constant_values=-3)
    equal = np.lib.stride_tricks.sliding_window_view(shifted, 2 * edits_most + 1, axis=1)[:, :side] == a[:, :, None]
    runs = np.zeros((n, side + 2, 2 * edits_most + 1), np.int32)  # equal words from each place on, on each diagonal
    for i in range(side - 1, -1, -1):
        runs[:, i] = (runs[:, i + 1] + 1) * equal[:, i]
    row, diagonal = np.arange(n)[:, None], np.arange(2 * edits_most + 1)[None, :]
    unit = 1 << 12  # furthest place first, then equal words
    reach = np.full((n, 2 * edits_most + 1), -1, np.int32)
    got = runs[:, 0, edits_most]
    reach[:, edits_most] = got * (unit + 1)
    best = most = got
    for edits in range(1, edits_most + 1):
        live = reach >= 0
        step = np.where(live, reach + unit, -1)  # a word of a is passed
        tried = step.copy()
        tried[:, 1:] = np.maximum(tried[:, 1:], reach[:, :-1])
        tried[:, :-1] = np.maximum(tried[:, :-1], step[:, 1:])
        place = np.clip(tried // unit, 0, side)
        run = np.where(tried >= 0, runs[row, place, diagonal], 0)
        tried = np.where((tried >= 0) & (tried // unit <= side), tried + run * (unit + 1), -1)
        words = tried % unit
        points = words * EQUAL + edits * OTHER
        reach = np.where((tried >= 0) & (points >= (best - DROP)[:, None]), tried, -1)
        words = np.where(reach >= 0, reach % unit, 0)
        most = np.maximum(most, words.max(axis=1))
        best = np.maximum(best, (words * EQUAL + edits * OTHER).max(axis=1))
    return np.minimum(most, beyond)


def _beside(side: int):
    """For each pair of one seed ``side`` words before it and behind it, two bytes each: words that are equal stay equal."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            around = []
            for row in batch.to_pylist():
                if (row["doc"], row["a"]) != last:
                    last, own = (row["doc"], row["a"]), _hashes(row["a"]).astype(np.uint16)
                x = int(np.frombuffer(row["points"], np.int32)[0])
                left = own[max(0, x - side) : x]
                around.append(len(left).to_bytes(2, "little") + left.tobytes() + own[x + SEED : x + SEED + side].tobytes())
            kept = [batch.column(i) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(around, pa.binary())], names=["doc", "first_doc", "points", "around"])

    return work


def _promising(beyond: int, side: int):
    """The pairs of one seed that may have a passage: ``beyond`` words can be equal beside the seed."""
    wide = side + edits_to(beyond)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            a = np.full((2, n, side), -1, np.int32)
            b = np.full((2, n, wide), -2, np.int32)
            rows = zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True)
            for i, (first_doc, points, around, text) in enumerate(rows):
                if (first_doc, text) != last:
                    last, other = (first_doc, text), _hashes(text).astype(np.uint16)
                y = int(np.frombuffer(points, np.int32)[1])
                n_left, words = int.from_bytes(around[:2], "little"), np.frombuffer(around[2:], np.uint16)
                a[0, i, :n_left] = words[:n_left][::-1]
                a[1, i, : len(words) - n_left] = words[n_left:]
                before, after = other[max(0, y - wide) : y], other[y + SEED : y + SEED + wide]
                b[0, i, : len(before)] = before[::-1]
                b[1, i, : len(after)] = after
            kept = []
            for s in range(0, n, 1024):
                part = slice(s, s + 1024)
                kept.append(most_equal(a[0, part], b[0, part], beyond) + most_equal(a[1, part], b[1, part], beyond) >= beyond)
            chosen = batch.filter(pa.array(np.concatenate(kept)))
            yield pa.RecordBatch.from_arrays([chosen.column(i) for i in range(3)], names=["doc", "first_doc", "points"])

    return work


# --- all pairs of a seed -----------------------------------------------------------------------------

#: Rows of a seed in a block; larger seeds are cut into blocks, and pairs of blocks meet.
BLOCK = 4096
#: Rows that are held against each other at once, about, and 64-bit words of the marks that words leave.
TOGETHER, MARKS = 8192, 8

SITES = "seed bigint, doc bigint, at int, open boolean, around binary"


def _sites(side: int):
    """For each of a text's seeds ``side`` words before it and behind it, two bytes each, after the numbers of words before and of all."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for row in range(batch.num_rows):
                doc, sites, text = (batch.column(i)[row] for i in range(3))
                seed, at, is_open = (sites.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                own = _hashes(text.as_py()).astype(np.uint16)
                inside = at + SEED <= len(own)  # rows that share an id may differ in text
                seed, at, is_open = seed[inside], at[inside], is_open[inside]
                around = []
                for x in at.tolist():
                    left, right = own[max(0, x - side) : x], own[x + SEED : x + SEED + side]
                    head = np.array([len(left), x - len(left), len(own) - x - SEED - len(right)], np.int32)
                    around.append(head.tobytes() + left.tobytes() + right.tobytes())
                columns = [
                    pa.array(seed), pa.array(np.full(len(at), doc.as_py(), np.int64)), pa.array(at.astype(np.int32)),
                    pa.array(is_open), pa.array(around, pa.binary()),
                ]
                held.append(pa.RecordBatch.from_arrays(columns, names=["seed", "doc", "at", "open", "around"]))
                if sum(x.num_rows for x in held) > TOGETHER or len(held) > 1000:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return work


def _marks(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's words as bits, the second of equal words as another word, and how many words left no bit of their own."""
    n, width = words.shape
    order = np.argsort(words, axis=1, kind="stable")
    ranked = np.take_along_axis(words, order, axis=1)
    place = np.broadcast_to(np.arange(width), words.shape)
    first = np.ones(words.shape, bool)
    first[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    nth = place - np.maximum.accumulate(np.where(first, place, 0), axis=1)
    bit = mixed((ranked.astype(np.int64).astype(_U) << _U(16)) + nth.astype(_U)) % _U(64 * MARKS)
    out = np.zeros((n, 64 * MARKS), bool)
    row, column = np.nonzero(ranked >= 0)
    out[row, bit[row, column].astype(np.int64)] = True
    lost = (ranked >= 0).sum(axis=1) - out.sum(axis=1)
    return np.packbits(out, axis=1).view(_U), lost


def _common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words, at most, that rows i of a and j of b can have in common."""
    return np.bitwise_count(a[0][i] & b[0][j]).sum(axis=1, dtype=np.int64) + np.minimum(a[1][i], b[1][j])


def _around(rows: list[bytes], side: int, none: int) -> np.ndarray:
    """The words before, nearest first, and behind each seed; ``none`` where a text ends."""
    out = np.full((2, len(rows), side), none, np.int32)
    for i, raw in enumerate(rows):
        n_left, words = int.from_bytes(raw[:4], "little"), np.frombuffer(raw[12:], np.uint16)
        before, after = words[:n_left][::-1][:side], words[n_left:][:side]
        out[0, i, : len(before)] = before
        out[1, i, : len(after)] = after
    return out


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row the most words, up to 64 of a's, that both have in the same order; numbers under 0 are no words."""
    n, width = a.shape
    same = np.zeros((n, b.shape[1], 64), bool)
    same[:, :, :width] = b[:, :, None] == a[:, None, :]
    masks = np.packbits(same, axis=2, bitorder="little").view(_U)[:, :, 0]
    rest = np.full(n, _TOP)
    with np.errstate(over="ignore"):
        for k in range(b.shape[1]):
            met = rest & masks[:, k]
            rest = (rest + met) | (rest - met)
    return width - np.bitwise_count(rest & _U((1 << width) - 1)).astype(np.int64)


def _excerpt(raw: bytes) -> tuple[np.ndarray, int, bool, bool]:
    """The words around a seed and its own, its place among them, and whether the text goes on before and behind."""
    n_left, before, behind = np.frombuffer(raw[:12], np.int32).tolist()
    words = np.frombuffer(raw[12:], np.uint16).astype(np.int64)
    own = np.concatenate([words[:n_left], np.arange(SEED) + (1 << 16), words[n_left:]])  # the seed is the same on both sides
    return own, n_left, before > 0, behind > 0


def may_have_passage(a: bytes, b: bytes, min_words: int, min_equal: float) -> bool:
    """Whether the chain through a seed makes a passage of the words around it, or its alignment comes to an end of them within its text."""
    (own, x, *a_on), (other, y, *b_on) = _excerpt(a), _excerpt(b)
    runs = [np.lib.stride_tricks.sliding_window_view(w, SEED) @ (0x9E3779B1 ** np.arange(SEED) % (1 << 40)) for w in (own, other)]
    order = np.argsort(runs[1], kind="stable")
    low, high = (np.searchsorted(runs[1][order], runs[0], side=s) for s in ("left", "right"))
    xs = np.repeat(np.arange(len(runs[0])), high - low)
    ys = order[np.arange(len(xs)) - np.repeat(np.cumsum(high - low) - high, high - low)]
    points = ends_of_runs(np.stack([xs, ys], axis=1))
    n = min(len(own) - x, len(other) - y)
    after = np.append(own[x : x + n] != other[y : y + n], True).argmax()
    before = np.append(own[:x][::-1][: min(x, y)] != other[:y][::-1][: min(x, y)], True).argmax()
    linked = [[tuple(p) for p in points[c].tolist()] for c in chains(points[:, 0].tolist(), points[:, 1].tolist())]
    through = [c for c in linked if any(q - p == y - x and x - before <= p < x + after for p, q in c)]
    for seeds in [[(x, y)], *through]:  # a poor stretch that a chain bridges may spoil what the seed alone has
        ended: list[tuple[bool, bool]] = []
        found = align(own, other, seeds, ended)
        if any(p[2] < 2 * DROP and b_on[0] or p[3] > len(other) - 2 * DROP and b_on[1] for p in found):
            align(other, own, [(q, p) for p, q in seeds], ended)
        if any(filled(own, other, p, min_words, min_equal) for p in found):
            return True
        ways = [a_on] * len(found) + [b_on] * (len(ended) - len(found))
        if any(at_start and before or at_end and behind for (at_start, at_end), (before, behind) in zip(ended, ways, strict=True)):
            return True
    return False


def _meetings(min_words: int, min_equal: float):
    """(doc, first_doc): texts that may have a passage around a seed, from rows in order of (seed, low, high).

    Every pair of rows of a seed is tried whose later text has no passage there yet: by the words that both have near the seed in any order,
    in the same order, and at last by alignment of what is around the seed.
    """
    beyond = words_beyond(min_words, min_equal)
    side = beyond + edits_to(beyond) + 1
    wide = side + edits_to(beyond)

    def tried(rows: pa.Table) -> np.ndarray:
        seed, low, high, block, doc = (rows[c].to_numpy() for c in ("seed", "low", "high", "block", "doc"))
        is_open = rows["open"].to_numpy()
        n = len(seed)
        ends = np.append(np.flatnonzero((seed[1:] != seed[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1, n)
        end = ends[np.searchsorted(ends, np.arange(n), side="right")]
        raw = rows["around"].to_pylist()
        a, b = _around(raw, side, -1), _around(raw, wide, -2)
        own, other = [_marks(x) for x in a], [_marks(x) for x in b]
        found: set[tuple[int, int]] = set()
        i, d = np.arange(n), 0
        while len(i):
            d += 1
            i = i[i + d < end[i]]
            j = i + d
            late = doc[i] > doc[j]
            later, first = np.where(late, i, j), np.where(late, j, i)
            k = np.flatnonzero((doc[i] != doc[j]) & is_open[later] & ((low[i] == high[i]) | (block[i] != block[j])))
            later, first = later[k], first[k]
            k = _common(own[0], other[0], later, first) + _common(own[1], other[1], later, first) >= beyond
            later, first = later[k], first[k]
            for s in range(0, len(later), 1024):
                x, y = later[s : s + 1024], first[s : s + 1024]
                may = in_order(a[0, x], b[0, y]) + in_order(a[1, x], b[1, y]) >= beyond
                x, y = x[may], y[may]
                for p, q, pair in zip(x.tolist(), y.tolist(), zip(doc[x].tolist(), doc[y].tolist(), strict=True), strict=True):
                    if pair not in found and may_have_passage(raw[p], raw[q], min_words, min_equal):
                        found.add(pair)
        return np.array(sorted(found), np.int64).reshape(-1, 2)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            pairs = tried(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["doc", "first_doc"])

        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            mark = [batch.column(i).to_numpy() for i in range(3)]
            last = np.logical_and.reduce([m == m[-1] for m in mark])
            cut = len(last) - int(last[::-1].argmin()) if not last.all() else 0  # where the batch's last group begins
            if held and cut == 0 and any(held[-1].column(i)[-1].as_py() != mark[i][0] for i in range(3)):
                yield out(held)
                held, size = [], 0
            if size + cut >= TOGETHER and cut:
                yield out([*held, batch.slice(0, cut)])
                held, size = [], 0
                batch = batch.slice(cut)
            held.append(batch)
            size += batch.num_rows
        if held:
            yield out(held)

    return work


def _wholly_aligned(min_words: int, min_equal: float):
    """Passages of pairs of texts, from all the seeds that both have."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                texts = [zstandard.ZstdDecompressor().decompress(row[c]).decode() for c in ("b", "a")]
                pair = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(texts)], names=["doc", "text"])
                seeds = list(_seeds(iter([pair])))
                both = _in_order(tuple(np.concatenate([x.column(i).to_numpy() for x in seeds]) for i in range(4)))
                one, two, _ = links(both)
                if not len(one):
                    continue
                points = np.stack(_matched(both, one, two)[2:], axis=1).astype(np.int32)
                points = ends_of_runs(np.unique(points, axis=0)).tolist()
                own, other, found = _hashes(row["a"]), _hashes(row["b"]), set()
                for chain in chains([x for x, _ in points], [y for _, y in points]):
                    for passage in align(own, other, [tuple(points[i]) for i in chain]):
                        whole = filled(own, other, passage, min_words, min_equal)
                        if whole:
                            x0, x1, y0, y1, equal = whole
                            found.add((row["doc"], x0, x1, row["first_doc"], y0, y1, min(1.0, equal / max(x1 - x0, y1 - y0))))
                rows += sorted(found)
            columns = list(zip(*rows, strict=True)) or [[]] * len(FOUND)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, (_, t) in zip(columns, FOUND, strict=True)], names=[n for n, _ in FOUND]
            )

    return work


def _met(shared: DataFrame, found: DataFrame, texts: DataFrame, min_words: int, min_equal: float) -> DataFrame:
    """(doc, first_doc) to be aligned besides those linked: all pairs of texts that meet at a seed no passage of the later one has yet.

    Of documents with the same text the smallest stands for all. Rows of a seed meet in pairs of blocks, so a seed of any size is spread.
    """
    spans = found.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_set(F.struct("start", "end")).alias("_found"))
    alone = texts.groupBy("text").agg(F.min("doc").alias("doc"))
    held = F.exists("_found", lambda s: (s["start"] <= F.col("at")) & (s["end"] >= F.col("at") + SEED))
    rows = shared.join(alone.select("doc"), "doc", "left_semi").join(spans, "doc", "left")
    rows = materialise(rows.select("seed", "doc", "at", (~F.coalesce(held, F.lit(False))).alias("open")), "seed_rows")
    opened = (
        rows.groupBy("seed")
        .agg(F.max(F.when(F.col("open"), F.col("doc"))).alias("_open"), F.min("doc").alias("_least"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_open") > F.col("_least"))
        .select("seed", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"))
    )
    sites = materialise(
        rows.join(opened, "seed", "left_semi")
        .groupBy("doc")
        .agg(F.collect_list(F.struct("seed", "at", "open")).alias("sites"))
        .join(alone, "doc")
        .select("doc", "sites", "text")
        .mapInArrow(_sites(min_words + 2 * DROP), SITES),
        "sites",
    )
    pairs = (
        sites.join(opened, "seed")
        .withColumn("block", F.pmod(F.xxhash64("doc", "at"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select("seed", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"), "block", "doc", "open", "around")
        .repartition("seed", "low", "high")
        .sortWithinPartitions("seed", "low", "high")
        .mapInArrow(_meetings(min_words, min_equal), "doc bigint, first_doc bigint")
    )
    met = materialise(pairs.distinct(), "met")
    discard(rows)
    discard(sites)
    return met


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now: it does so when the driver's garbage is collected.

    Python's references to plans are let go of a moment after they end.
    """
    gc.collect()
    time.sleep(2)
    spark.sparkContext._jvm.System.gc()


# --- the operator ------------------------------------------------------------------------------------


def shared_passages(
    docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, min_equal: float = MIN_EQUAL
) -> DataFrame:
    """Passages that a document shares with an earlier one: doc_id, start, end, source_doc_id, source_start, source_end, equal.

    Places are words from 0, ends exclusive; words stand between ASCII white
    space, A-Z in lower case. ``equal`` is the share of equal words. A
    passage has at least ``min_words`` words on both sides; changed words at
    its ends belong to it only if it has fewer without.

    Every seed is matched with the smallest document that goes on with the same 50 words, else 46 words, else 16 words and the
    seed alone (``links``), so m documents with a passage give m - 1 rows, not all
    pairs, and a document gets a source for a passage however its pieces occur elsewhere. A run of 54 equal
    words always has a source with 50 of them; one of 50 to 53 has one with 46 of them at least, and is lost only
    if that one ends there. A passage whose seeds all stand in smaller documents that do not have it is found in a second round: every
    pair of texts that meet at a seed is tried where no passage of the later one was found (``_met``), by words near the seed that must be
    equal and then by alignment of the whole texts. Seeds are dealt out by ranges, so a seed that a third of all documents hold is spread over many
    partitions; each task streams its rows and leaves the ends of its groups, which are matched afterwards.

    Null and empty texts have no passages, nor has a document within itself.
    A null id counts as smaller than all others, and is null in the result.
    Rows that share an id are one document; if their texts differ, a passage
    stands for those of them that hold it.
    """
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), F.col(text).alias("text"))
    order = ["key", "ctx", "doc", "at"]
    fates = materialise(
        slim.mapInArrow(_seeds, "key bigint, ctx int, doc bigint, at int")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_firsts_and_shared, "key bigint, ctx int, doc bigint, at int, first_doc bigint, first_at int, fate int"),
        "seed_matches",
    )
    free_shuffles(spark)
    columns = ["doc", "first_doc", "at", "first_at"]
    ends = fates.filter(F.col("fate") == END).select(*order).distinct().toPandas()  # at most eight rows per partition
    ends = _in_order(tuple(ends[c].to_numpy(t) for c, t in zip(order, (np.int64, np.int32, np.int64, np.int32), strict=True)))
    matches = fates.filter(F.col("fate") == MATCHED).select(*columns)
    one, two, _ = links(ends)
    if len(one):
        table = pa.Table.from_arrays([pa.array(c) for c in _matched(ends, one, two)], names=columns)
        matches = matches.unionByName(spark.createDataFrame(table))
    chained = materialise(
        matches.repartition("doc", "first_doc")
        .sortWithinPartitions("doc", "first_doc")
        .mapInArrow(_chained, CHAINS),
        "chains",
    )
    wanted = chained.select("doc").unionByName(chained.select(F.col("first_doc").alias("doc"))).distinct()
    packed = slim.mapInArrow(_deflated, "doc bigint, text binary")
    texts = materialise(packed.join(wanted, "doc").dropDuplicates(["doc", "text"]), "texts")
    free_shuffles(spark)
    first = texts.select(F.col("doc").alias("first_doc"), F.col("text").alias("b"))
    # Most chains are one seed and nothing else is shared: a few words beside it tell, without sending texts.
    beyond = words_beyond(min_words, min_equal)
    side = beyond + edits_to(beyond) + 1
    beside = (
        chained.mapInArrow(_taken_apart(lone=True), CHAINS)
        .join(texts.withColumnRenamed("text", "a"), "doc")
        .select("doc", "first_doc", "points", "a")
        .mapInArrow(_beside(side), "doc bigint, first_doc bigint, points binary, around binary")
    )
    promising = materialise(
        beside.join(first, "first_doc")
        .select("doc", "first_doc", "points", "around", "b")
        .mapInArrow(_promising(beyond, side), "doc bigint, first_doc bigint, points binary")
        .distinct(),
        "promising",
    )
    free_shuffles(spark)
    one = F.lit(bytearray(np.array([1], np.int32).tobytes()))
    kept = chained.mapInArrow(_taken_apart(lone=False), CHAINS).unionByName(promising.withColumn("sizes", one))
    together = lambda name: F.aggregate(F.col("_chains"), F.lit(b""), lambda done, c: F.concat(done, c[name])).alias(name)
    pairs = (  # one row a pair again, so that no text is hashed for each chain
        kept.groupBy("doc", "first_doc")
        .agg(F.collect_list(F.struct("points", "sizes")).alias("_chains"))
        .select("doc", "first_doc", together("points"), together("sizes"))
    )

    def passages(pairs: DataFrame, margin: int) -> DataFrame:
        own = pairs.join(texts.withColumnRenamed("text", "a"), "doc").select("doc", "first_doc", "points", "sizes", "a")
        both = own.mapInArrow(_cut(margin), CHAINS + ", near binary, a binary").join(first, "first_doc")
        return both.mapInArrow(
            _aligned(min_words, min_equal),
            "doc_id bigint, start bigint, end bigint, source_doc_id bigint, source_start bigint, source_end bigint, equal double",
        )

    # most of the others are settled by the words around their seeds, without sending whole texts
    found = materialise(passages(pairs, min_words + 2 * DROP), "passages")
    free_shuffles(spark)
    is_open = found.filter(F.col("start").isNull()).select(F.col("doc_id").alias("doc"), F.col("source_doc_id").alias("first_doc"))
    found = found.filter(F.col("start").isNotNull()).unionByName(
        passages(chained.join(is_open.distinct(), ["doc", "first_doc"], "left_semi"), 0)
    )
    found = materialise(found, "found")
    free_shuffles(spark)
    shared = fates.filter(F.col("fate") == SHARED).select(F.shiftright("key", 24).alias("seed"), "doc", "at")
    met = _met(shared, found, texts, min_words, min_equal)
    discard(fates)
    free_shuffles(spark)
    more = met.join(texts.withColumnRenamed("text", "a"), "doc").join(first, "first_doc").select("doc", "first_doc", "a", "b")
    more = more.mapInArrow(_wholly_aligned(min_words, min_equal), found.schema)
    held = found.select("doc_id", F.col("start").alias("_start"), F.col("end").alias("_end"))
    within = (more["start"] >= held["_start"]) & (more["end"] <= held["_end"])
    found = found.unionByName(more.join(held, (more["doc_id"] == held["doc_id"]) & within, "left_anti"))
    for name in ("doc_id", "source_doc_id"):
        found = found.withColumn(name, F.when(F.col(name) != NO_ID, F.col(name)))
    return found.distinct()

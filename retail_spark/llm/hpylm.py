"""LM scoring: a hierarchical Pitman-Yor model in which every word has a restaurant for the words after it, seated by Gibbs sampling."""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_spark.llm.common import store_bucketed
from retail_spark.llm.hashing import mixed, seeds, words_of
from retail_spark.llm.passages import free_shuffles
from retail_spark.session import discard, materialise

#: Tokens that share one numbering of words, and documents at most.
BLOCK_TOKENS, BLOCK_DOCS = 1_000_000, 200_000
#: Tokens of the corpus for each range of hashes that a task counts at once, about.
RANGE_TOKENS = 1_000_000
#: Sweeps over all seatings; those after BURN_IN are averaged.
SWEEPS, BURN_IN = 8, 4
#: Concentrations of the context restaurants and of their parent. Discounts are estimated from the counts.
CHILD, PARENT = 0.2, 1.0
#: Up to so many customers of a dish the number of their tables is drawn from its exact conditional.
EXACT = 24

_U = np.uint64
#: Stand for the end of a text, which is a word, and for its start, which only words follow.
END, START = (int(x) for x in seeds(2, 777))


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training; a null id reads as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


# --- numbers as bytes --------------------------------------------------------------------------------


def packed(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, deflated: planes that hardly change cost hardly anything."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T) if len(x) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def rising(x: np.ndarray) -> bytes:
    """Rising numbers by their steps."""
    return packed(np.diff(x, prepend=_U(0)))


def risen(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, _U), dtype=_U)


# --- blocks ------------------------------------------------------------------------------------------

BLOCK = "block bigint, tokens bigint, docs array<bigint>, sizes array<int>, words binary, places binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as places in a rising list of word hashes, the end of each text and the start of all included."""
    docs: list = []
    hashes: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    n = 0

    def block() -> pa.RecordBatch:
        size = np.concatenate(sizes)
        words, places = np.unique(np.append(np.concatenate(hashes), _U(START)), return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([uuid.uuid4().int >> 65]),  # written once, then only read
                pa.array([int(size.sum())], pa.int64()),
                pa.array([docs], pa.list_(pa.int64())),
                pa.array([size.tolist()], pa.list_(pa.int32())),
                pa.array([rising(words)], pa.binary()),
                pa.array([packed(places[:-1].astype(np.uint32))], pa.binary()),
            ],
            names=["block", "tokens", "docs", "sizes", "words", "places"],
        )

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for words in words_of(texts):
            ends = words.bounds[1:]
            hashes.append(np.insert(words.hashes, ends, _U(END)))
            sizes.append(np.diff(words.bounds) + 1)
            docs += ids[words.first : words.first + len(ends)]
            n += len(hashes[-1])
            if n >= BLOCK_TOKENS or len(docs) >= BLOCK_DOCS:
                yield block()
                docs, hashes, sizes, n = [], [], [], 0
    if docs:
        yield block()


@dataclass
class Block:
    """A block's words, its distinct pairs of neighbours in order of their places, and where its tokens' pairs stand among them."""

    number: int
    docs: list
    sizes: np.ndarray
    words: np.ndarray
    places: np.ndarray
    training: np.ndarray  # of each token
    pairs: np.ndarray  # place of the first word times the number of words, and place of the second
    pair_of: np.ndarray | None

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


def opened(row: dict, with_pairs: bool = False) -> Block:
    words, places = risen(row["words"]), unpacked(row["places"], np.uint32).astype(np.int64)
    sizes = np.array(row["sizes"], np.int64)
    context = np.empty(len(places), np.int64)
    context[1:] = places[:-1]
    context[np.cumsum(sizes) - sizes] = np.searchsorted(words, _U(START))
    context *= len(words)
    context += places
    if with_pairs:
        pairs, pair_of = np.unique(context, return_inverse=True)
    else:
        context.sort()
        pairs = context[np.flatnonzero(np.diff(context, prepend=-1))]
        pair_of = None
    training = np.repeat(np.array([not held_out(d) for d in row["docs"]], bool), sizes)
    return Block(row["block"], row["docs"], sizes, words, places, training, pairs, pair_of)


def pair_keys(words: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Hashes of pairs of words, given by their places."""
    return mixed(words[before] * _U(0x9E3779B97F4A7C15) + mixed(words)[after])


def _cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where the ranges of hashes begin among rising keys."""
    edges = np.array([min(2**64 - 1, -(-(r << 64) // ranges)) for r in range(1, ranges)], _U)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


ASK = "range int, block bigint, keys binary, numbers binary, more binary"


def _asks(number: int, keys: np.ndarray, ranges: int, numbers: np.ndarray, more: np.ndarray | None = None) -> list[tuple]:
    """What a block says of its keys, cut by ranges."""
    cuts = _cuts(keys, ranges).tolist()
    return [
        (r, number, rising(keys[s:e]), packed(numbers[s:e]), None if more is None else packed(more[s:e]))
        for r, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))
        if e > s
    ]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


ASK_SCHEMA = pa.schema(
    [("range", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("numbers", pa.binary()), ("more", pa.binary())]
)
#: What a range answers a block: for kind PAIRS customers and whether the block owns the pair, for WORDS three numbers a word.
#: The block keeps itself: the pairs it owns with their customers, told as PAIRS again, and as SEATS their tables after a round, asked as range KEPT.
PAIRS, WORDS, SEATS = 0, 1, 2
KEPT = -1
REPLY = "block bigint, kind int, round int, range int, first binary, second binary, third binary"
REPLY_SCHEMA = pa.schema(
    [("block", pa.int64()), ("kind", pa.int32()), ("round", pa.int32()), ("range", pa.int32()), *((c, pa.binary()) for c in ("first", "second", "third"))]
)


def _pair_asks(ranges: int):
    """Every distinct pair of a block, with its occurrences in training texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = opened(row, with_pairs=True)
                counts = np.bincount(block.pair_of[block.training], minlength=len(block.pairs)).astype(np.uint64)
                keys, order = _key_order(block)
                yield _batch(_asks(block.number, keys, ranges, counts[order]), ASK_SCHEMA)

    return work


def _together(rows: pa.Table) -> tuple[pa.Table, list[int], np.ndarray, np.ndarray, np.ndarray]:
    """(rows by block, their numbers of keys, place of each key among the distinct ones, first place of each, distinct keys) of one range."""
    order = np.argsort(rows["block"].to_numpy())
    rows = rows.take(pa.array(order))
    parts = [risen(k) for k in rows["keys"].to_pylist()]
    keys = np.concatenate(parts)
    distinct, first, place = np.unique(keys, return_index=True, return_inverse=True)
    return rows, [len(p) for p in parts], place, first, distinct


def _split(x: np.ndarray, sizes: list[int]) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [packed(np.ascontiguousarray(x[e - n : e])) for n, e in zip(sizes, ends, strict=True)]


def _count_pairs(rows: pa.Table) -> pa.Table:
    """All training occurrences of each pair of a range, and one block that owns it, told to every block that has it."""
    rows, sizes, place, first, distinct = _together(rows)
    counts = np.concatenate([unpacked(x, np.uint64) for x in rows["numbers"].to_pylist()])
    total = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.uint64)
    owns = np.zeros(len(place), np.uint8)
    owns[first] = 1
    out = list(zip(rows["block"].to_pylist(), _split(total[place], sizes), _split(owns, sizes), strict=True))
    r = rows["range"][0].as_py()
    return pa.Table.from_batches([_batch([(b, PAIRS, 0, r, x, y, None) for b, x, y in out], REPLY_SCHEMA)])


# --- seating -----------------------------------------------------------------------------------------


@dataclass
class Totals:
    """Numbers over the whole corpus: fixed ones, and of the seating of one round."""

    words: int = 0  # distinct training words
    tokens: int = 0
    child: float = 0.75
    parent: float = 0.75
    customers: float = 0.0  # of the parent: all tables of the contexts
    tables: float = 0.0  # of the parent

    @property
    def base(self) -> float:
        return 1.0 / (self.words + 1)  # one more for all words that training lacks

    def parent_probability(self, customers, tables):
        """A word's predictive probability in the parent restaurant, whose customers are the contexts' tables."""
        free = (PARENT + self.parent * self.tables) * self.base
        return (np.maximum(customers - self.parent * tables, 0.0) + free) / (PARENT + self.customers)


@lru_cache(maxsize=8)
def log_stirling(discount: float, n: int = EXACT) -> np.ndarray:
    """ln S(c, t): ways to seat c customers at t tables, weighted by the discount. S(c+1, t) = S(c, t-1) + (c - t d) S(c, t)."""
    out = np.full((n + 1, n + 2), -np.inf)
    out[0, 0] = 0.0
    for c in range(n):
        for t in range(1, c + 2):
            stay = out[c, t] + math.log(c - t * discount) if t <= c and c - t * discount > 0 else -np.inf
            out[c + 1, t] = np.logaddexp(out[c, t - 1], stay)
    return out


def uniforms(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) that follow from key and salt alone, so that a task that is run again draws the same."""
    return ((mixed(keys + seeds(1, salt)[0]) >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)


#: Dishes whose tables are drawn at once: their numbers stay in the processor's cache.
CHUNK = 8192


def _drawn_exactly(c: int, first, step, u, ways: np.ndarray) -> np.ndarray:
    """Tables of dishes of c customers each, 2 to EXACT: ``first`` and ``step`` are the concentration with all other tables, and the discount, times the
    parent probability; ``ways`` the weights S(c, t) of t tables."""
    sums, weight = np.empty((c, len(u))), np.ones(len(u))
    sums[0] = ways[1]
    for t in range(2, c + 1):  # all weights are divided by that of opening the first table
        weight *= first + (t - 1) * step
        np.add(sums[t - 2], weight * ways[t], out=sums[t - 1])
    return 1 + (sums < u * sums[-1]).sum(axis=0)


def _seated_anew(customers, others, probability, concentration, discount, keys, salt) -> np.ndarray:
    """Tables of dishes of many customers, most customers first, by groups of a fifth of those seated before."""
    tables = np.ones(len(customers))
    now, step, n = 1.0, 0, len(customers)
    while n:  # the first n dishes have customers that are not seated yet; all of them have as many seated
        had, chance_of = tables[:n], probability[:n]
        full = max(1.0, math.floor(now / 5))
        step += 1
        v = uniforms(keys[:n], salt + 2 * step)
        if full == 1.0:
            new = (concentration[:n] + discount * (others[:n] + had)) * chance_of
            had += v < new / (new + np.maximum(now - discount * had, 0.0) + 1e-300)
        else:
            group = np.minimum(full, customers[:n] - now)
            rate, some, before = np.zeros(n), (group - 1) / 2, others[:n] + had
            for _ in range(2):  # at the group's middle there are more customers, and by the first rate more tables
                new = (concentration[:n] + discount * (before + rate * some)) * chance_of
                rate = new / (new + np.maximum(now + some - discount * (had + rate * some), 0.0) + 1e-300)
            mean = group * rate
            many = np.zeros(n)
            few = np.flatnonzero((mean < 3) & (group > 1))  # so many open a table by chance as a Poisson draw says
            chance, drawn, middle = np.exp(-mean[few]), v[few], mean[few]
            sum_of = chance.copy()
            for k in range(1, 12):
                beyond = np.flatnonzero(drawn > sum_of)
                if not len(beyond):
                    break
                few, chance, drawn, middle, sum_of = (x[beyond] for x in (few, chance, drawn, middle, sum_of))
                many[few] += 1
                chance = chance * (middle / k)
                sum_of = sum_of + chance
            more = np.flatnonzero(mean >= 3)
            if len(more):
                w = uniforms(keys[:n][more], salt + 2 * step + 1)
                normal = np.sqrt(-2 * np.log(v[more])) * np.cos(2 * np.pi * w)
                many[more] = np.round(mean[more] + normal * np.sqrt(mean[more] * (1 - rate[more])))
            had += np.where(group > 1, np.clip(many, 0, group), v < rate)
        now += full
        n = int(np.searchsorted(-customers, -now))  # those of more customers than that
    return tables


def draw_tables(customers, others, probability, concentration, discount, keys, salt) -> np.ndarray:
    """Tables of each dish, given its customers, the other dishes' tables in its restaurant and its parent probability.

    Seatings are summed out: t tables have weight S(c, t) x product of
    (concentration + discount (others + j)) over j < t x probability^t. That conditional is drawn from as
    it is up to EXACT customers. The rest are seated anew, in groups of a fifth of those seated
    before: of a group, so many open a table as a Poisson or normal draw of the probability at its middle says.
    """
    out = np.ones(len(customers))
    ways = np.exp(log_stirling(discount))
    order = np.argsort(np.minimum(customers, EXACT + 1).astype(np.int8), kind="stable")
    ends = np.searchsorted(customers[order].clip(max=EXACT + 1), np.arange(1, EXACT + 2), side="right")
    for c in range(2, EXACT + 1):
        for s in range(ends[c - 2], ends[c - 1], CHUNK):
            at = order[s : min(s + CHUNK, ends[c - 1])]
            chance = probability[at]
            first, step = (concentration[at] + discount * others[at]) * chance, discount * chance
            out[at] = _drawn_exactly(c, first, step, uniforms(keys[at], salt), ways[c])
    at = order[ends[EXACT - 1] :]
    at = at[np.argsort(-customers[at], kind="stable")]
    for s in range(0, len(at), CHUNK):
        part = at[s : s + CHUNK]
        out[part] = _seated_anew(*(x[part] for x in (customers, others, probability, concentration)), discount, keys[part], salt)
    return out


# --- rounds ------------------------------------------------------------------------------------------


STATE = "block bigint, words binary, tokens binary, pairs binary, customers binary"
STATE_SCHEMA = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("words", "tokens", "pairs", "customers"))])


def _key_order(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of a block's pairs in rising order, their pairs)."""
    keys = pair_keys(block.words, *np.divmod(block.pairs, len(block.words)))
    order = np.argsort(keys)
    return keys[order], order


def _in_place(order: np.ndarray, parts: list[bytes], kind) -> np.ndarray:
    """What the ranges answered of a block's pairs, in order of the pairs."""
    told = np.concatenate([unpacked(x, kind) for x in parts]).reshape(len(order), -1)
    out = np.empty_like(told)
    out[order] = told
    return out


def _states(blocks: pa.Table, replies: pa.Table) -> pa.Table:
    """What every round needs of a block, worked out once: its words with their training tokens (texts, for the start), and the
    pairs it owns with all customers, from the ranges' answers."""
    out = []
    parts = sorted(replies.to_pylist(), key=lambda r: r["range"])
    for row in blocks.to_pylist():
        block = opened(row)
        tokens = np.bincount(block.places[block.training], minlength=len(block.words))
        tokens[np.searchsorted(block.words, _U(START))] = sum(not held_out(d) for d in block.docs)
        _, order = _key_order(block)
        customers = _in_place(order, [r["first"] for r in parts], np.uint64)[:, 0]
        owned = _in_place(order, [r["second"] for r in parts], np.uint8)[:, 0].astype(bool) & (customers > 0)
        out.append((block.number, row["words"], packed(tokens.astype(np.uint64)), rising(block.pairs[owned].astype(np.uint64)), packed(customers[owned])))
    return pa.Table.from_batches([_batch(out, STATE_SCHEMA)])


@dataclass
class State:
    """A block's words and the pairs it owns, as ``_states`` left them."""

    number: int
    words: np.ndarray
    tokens: np.ndarray
    before: np.ndarray  # places of the words of the pairs
    after: np.ndarray
    customers: np.ndarray


def state_of(row: dict) -> State:
    words = risen(row["words"])
    before, after = np.divmod(risen(row["pairs"]).astype(np.int64), len(words))
    tokens, customers = (unpacked(row[c], np.uint64).astype(np.int64) for c in ("tokens", "customers"))
    return State(row["block"], words, tokens, before, after, customers)


def _word_state(replies: list[dict], number: int) -> tuple[np.ndarray, ...]:
    """(tables of all contexts, the parent's tables, tables in the word's own restaurant) of a block's words in a round; the first is training tokens in round 0."""
    parts = sorted((r for r in replies if r["kind"] == WORDS and r["round"] == number), key=lambda r: r["range"])
    return tuple(np.concatenate([unpacked(r[c], np.uint64) for r in parts]).astype(np.int64) for c in ("first", "second", "third"))


def _seats(customers: np.ndarray, replies: list[dict], number: int) -> np.ndarray:
    """Tables of the pairs a block owns after a round, as the block kept them; one a dish to begin with."""
    kept = [r["first"] for r in replies if r["kind"] == SEATS and r["round"] == number]
    return unpacked(kept[0], np.uint64).astype(np.int64) if kept else np.minimum(customers, 1)


def _seated(block: State, replies: list[dict], state: Totals, number: int) -> np.ndarray:
    """Tables of the pairs a block owns after round ``number``, drawn anew from those of the round before.

    Draws follow from a pair's key and the round alone, and from numbers that all blocks are told alike, so it does not matter
    which block owns a pair. The others that have it are told its tables once, to score their texts.
    """
    tables = _seats(block.customers, replies, number - 1)
    many = np.flatnonzero(block.customers > 1)  # a single customer sits at one table
    before, after = block.before[many], block.after[many]
    served, parent_tables, in_own = _word_state(replies, number)
    probability = state.parent_probability(served, parent_tables)[after]
    others = in_own[before] - tables[many]
    tables[many] = draw_tables(
        block.customers[many].astype(float), others.astype(float), probability, np.full(len(many), CHILD), state.child,
        pair_keys(block.words, before, after), 100_000 * number,
    )
    return tables


def _word_asks(ranges: int, totals: list[Totals], number: int):
    """What a block adds to the words of round ``number``: tables of the pairs it owns, by their second and by their first word.

    Round 0: training tokens of each word, and for the discount the owned pairs of one and of two customers.
    """

    def asked(block: State, told: list[dict]) -> list[tuple]:
        rows = []
        n = len(block.words)
        if number == 0:
            once, twice = (np.bincount(block.before[block.customers == c], minlength=n) for c in (1, 2))
            numbers, more = block.tokens, (once << 32) | twice
        else:
            if number == 1:
                tables = _seats(block.customers, told, 0)
            else:
                tables = _seated(block, told, totals[number - 1], number - 1)
                rows.append((KEPT, block.number, None, packed(tables.astype(np.uint64)), None))
            numbers, more = (np.bincount(words, weights=tables, minlength=n) for words in (block.after, block.before))
        return rows + _asks(block.number, block.words, ranges, numbers.astype(np.uint64), more.astype(np.uint64))

    def work(states: pa.Table, replies: pa.Table) -> pa.Table:
        told = replies.to_pylist()
        return pa.Table.from_batches([_batch([r for row in states.to_pylist() for r in asked(state_of(row), told)], ASK_SCHEMA)])

    return work


SUMS = ", a bigint, b bigint, c bigint, d bigint"
SUMS_SCHEMA = pa.schema([*REPLY_SCHEMA, *((c, pa.int64()) for c in "abcd")])


def _add_words(number: int, state: Totals | None):
    """Sums of each word of a range over all blocks, the parent's tables drawn from them, told to every block that has the word.

    The first row carries sums over the range: round 0 words, tokens, pairs of one and of two customers; later rounds customers
    and tables of the parent, words of one and of two customers.
    """

    def work(rows: pa.Table) -> pa.Table:
        rows, sizes, place, _, distinct = _together(rows)
        numbers = np.concatenate([unpacked(x, np.uint64) for x in rows["numbers"].to_pylist()])
        more = np.concatenate([unpacked(x, np.uint64) for x in rows["more"].to_pylist()])
        first = np.bincount(place, weights=numbers, minlength=len(distinct)).astype(np.int64)
        if number == 0:
            once = np.bincount(place, weights=(more >> _U(32)).astype(np.int64), minlength=len(distinct))
            twice = np.bincount(place, weights=(more & _U(0xFFFFFFFF)).astype(np.int64), minlength=len(distinct))
            second = third = np.zeros(len(distinct), np.int64)
            words = first[distinct != _U(START)]
            sums = (int((words > 0).sum()), int(words.sum()), int(once.sum()), int(twice.sum()))
        else:
            third = np.bincount(place, weights=more.astype(np.int64), minlength=len(distinct)).astype(np.int64)
            second = np.minimum(first, 1)
            many = np.flatnonzero(first > 1)
            if len(many):
                second[many] = draw_tables(
                    first[many].astype(float), np.full(len(many), max(state.tables - 1.0, 0.0)), np.full(len(many), state.base),
                    np.full(len(many), PARENT), state.parent, mixed(distinct[many]), 100_000 * number + 50_000,
                ).astype(np.int64)
            sums = (int(first.sum()), int(second.sum()), int((first == 1).sum()), int((first == 2).sum()))
        told = zip(rows["block"].to_pylist(), *(_split(x.astype(np.uint64)[place], sizes) for x in (first, second, third)), strict=True)
        r, none = rows["range"][0].as_py(), (0, 0, 0, 0)
        out = [(b, WORDS, number, r, *x, *(sums if i == 0 else none)) for i, (b, *x) in enumerate(told)]
        return pa.Table.from_batches([_batch(out, SUMS_SCHEMA)])

    return work


def discount(ones: int, twos: int) -> float:
    """The discount that counts of one and of two suggest."""
    return float(np.clip(ones / (ones + 2 * twos), 0.1, 0.95)) if ones + twos else 0.75


# --- scoring -----------------------------------------------------------------------------------------

SCORE = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
)


def _seat_asks(ranges: int, samples: list[int]):
    """Every distinct pair of a block, and of those it owns the customers and the tables of each sample."""

    def work(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        told, rows = replies.to_pylist(), []
        for row in blocks.to_pylist():
            block = opened(row)
            own = next(r for r in told if r["kind"] == PAIRS)
            at = np.searchsorted(block.pairs, risen(own["first"]).astype(np.int64))
            customers, seats = np.zeros(len(block.pairs), np.uint64), np.zeros((len(block.pairs), len(samples)), np.uint64)
            customers[at] = unpacked(own["second"], np.uint64)
            for i, number in enumerate(samples):
                seats[at, i] = _seats(customers[at], told, number)
            keys, order = _key_order(block)
            rows += _asks(block.number, keys, ranges, customers[order], seats[order])
        return pa.Table.from_batches([_batch(rows, ASK_SCHEMA)])

    return work


def _tell_seats(rows: pa.Table) -> pa.Table:
    """Customers and tables of each pair of a range, as its owner has them, told to every block that has it."""
    rows, sizes, place, _, distinct = _together(rows)
    told = []
    for name in ("numbers", "more"):
        numbers = np.concatenate([unpacked(x, np.uint64) for x in rows[name].to_pylist()]).reshape(len(place), -1)
        known, owner = np.zeros((len(distinct), numbers.shape[1]), np.uint64), numbers.any(axis=1)  # zeros but the owner's
        known[place[owner]] = numbers[owner]
        told.append(_split(known[place], sizes))
    r = rows["range"][0].as_py()
    out = [(b, PAIRS, 0, r, x, y, None) for b, x, y in zip(rows["block"].to_pylist(), *told, strict=True)]
    return pa.Table.from_batches([_batch(out, REPLY_SCHEMA)])


def _scored(totals: list[Totals], samples: list[int]):
    """The texts of a block: the mean over samples of each token's probability after the word before it."""

    def work(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(6)]
        told = replies.to_pylist()
        fixed = totals[0]
        for row in blocks.to_pylist():
            block = opened(row, with_pairs=True)
            before, after = np.divmod(block.pairs, len(block.words))
            parts = sorted((r for r in told if r["kind"] == PAIRS), key=lambda r: r["range"])
            _, order = _key_order(block)
            customers = _in_place(order, [r["first"] for r in parts], np.uint64)[:, 0].astype(np.int64)
            seats = _in_place(order, [r["second"] for r in parts], np.uint64).astype(np.int64)
            tokens, _, _ = _word_state(told, 0)
            # a word is followed as often as it occurs, the start of texts as often as there are texts
            context = tokens
            probability = np.zeros(len(block.pairs))
            for i, number in enumerate(samples):
                state = totals[number + 1]
                served, parent_tables, in_own = _word_state(told, number + 1)
                parent = state.parent_probability(served, parent_tables)[after]
                own = np.maximum(customers - state.child * seats[:, i], 0.0)
                room = CHILD + state.child * in_own[before]
                probability += (own + room * parent) / (CHILD + context[before])
            logs = np.log10(probability / len(samples))
            base = np.log10((tokens + 1.0) / (fixed.tokens + (fixed.words + 1.0)))
            starts = block.starts
            score = np.add.reduceat(logs[block.pair_of], starts)
            values = (
                block.docs, block.sizes, np.add.reduceat((tokens > 0)[block.places].astype(np.int64), starts),
                np.add.reduceat(base[block.places], starts), score, 10.0 ** (-score / block.sizes),
            )
            for column, value in zip(out, values, strict=True):
                column.append(value)
        docs = [d for part in out[0] for d in part]
        one = lambda parts: np.concatenate(parts) if parts else np.zeros(0)
        return pa.table(
            {
                "doc_id": pa.array(docs, pa.int64()), "held_out": pa.array([held_out(d) for d in docs], pa.bool_()),
                "n_tokens": pa.array(one(out[1]), pa.int64()), "n_known": pa.array(one(out[2]), pa.int64()),
                "train_tokens": pa.array(np.full(len(docs), fixed.tokens, np.int64)), "base_score": pa.array(one(out[3]), pa.float64()),
                "score": pa.array(one(out[4]), pa.float64()), "perplexity": pa.array(one(out[5]), pa.float64()),
            }
        )

    return work


def score_texts(docs: DataFrame, text: str = "text", sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> DataFrame:
    """Scores every text by a model trained on those that ``held_out`` leaves.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity. Tokens are words between ASCII white
    space, A-Z in lower case, and an end. The model: a restaurant for every word, and one for the start of texts, in which the words
    after it are dishes; all share one parent over single words, whose base gives each known word, and all unknown
    ones together, the same share. ``score`` is log10 of the texts' probability under the mean of the samples.

    Texts are cut into blocks once. A block tells its distinct pairs of neighbours, and its words, by ranges of their hashes; each range
    sums them over all blocks and tells the sums back. Tables are drawn pair by pair from the totals of the round
    before, as distributed Gibbs samplers do, by one block that has the pair, its owner, with numbers that follow from pair and round
    alone. So only sums by word travel between rounds; the samples' tables are told to all blocks that have a pair once, at the end. A word or pair has one row a
    block, however common it is; blocks and ranges are of like size, and more text makes more of them. What the
    driver learns of a round is four numbers. Rounds up to ``burn_in`` are forgotten once the next has gone on from them; those after it are averaged.

    Null text is an empty text: one token. Rows that share an id are texts of
    their own; a null id is trained on. Without training texts every word is unknown, and its probability 1.
    """
    spark = docs.sparkSession
    blocks = store_bucketed(docs.select(F.col("doc_id").cast("bigint"), F.col(text)).mapInArrow(_blocks, BLOCK), "block", "lm_blocks")
    tokens = blocks.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    ranges = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // RANGE_TOKENS))
    pairs = materialise(
        blocks.mapInArrow(_pair_asks(ranges), ASK).groupBy("range").applyInArrow(_count_pairs, REPLY), "lm_pairs"
    )
    states = store_bucketed(blocks.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(_states, STATE), "block", "lm_states")
    discard(pairs)
    totals: list[Totals] = []
    words: dict[int, DataFrame] = {}  # what the ranges told in a round, while a later one or the scores need it
    seats: dict[int, DataFrame] = {}
    samples = list(range(burn_in + 1, sweeps + 1))

    def told_itself(own: DataFrame, kind: int, number: int, first: str, second: str | None = None) -> DataFrame:
        """What a block keeps, as an answer to it."""
        none = F.lit(None).cast("binary")
        values = (F.lit(kind), F.lit(number), F.lit(0), F.col(first), F.col(second) if second else none, none)
        return own.select("block", *[x.alias(c) for x, c in zip(values, REPLY_SCHEMA.names[1:], strict=True)])

    def meeting(kept: DataFrame, told: list[DataFrame], work, kind: str) -> DataFrame:
        empty = spark.createDataFrame([], REPLY)
        return kept.groupBy("block").cogroup(reduce(DataFrame.unionByName, told or [empty]).groupBy("block")).applyInArrow(work, kind)

    for number in range(sweeps + 2):
        told = [part for part in (words.get(number - 1), seats.get(number - 2)) if part is not None]
        asks = materialise(meeting(states, told, _word_asks(ranges, totals, number), ASK), "lm_asks")
        answers = materialise(
            asks.filter(F.col("range") != KEPT)
            .groupBy("range")
            .applyInArrow(_add_words(number, totals[-1] if totals else None), REPLY + SUMS),
            "lm_words",
        )
        a, b, c, d = (x or 0 for x in answers.agg(*[F.sum(x) for x in "abcd"]).first())
        if number == 0:
            totals.append(Totals(a, b, child=discount(c, d)))
        else:
            fixed = totals[-1]
            parent = discount(c, d) if number == 1 else fixed.parent
            totals.append(Totals(fixed.words, fixed.tokens, fixed.child, parent, a, b))
        words[number] = answers.drop(*"abcd")
        if number > 1:
            kept = asks.filter(F.col("range") == KEPT)
            seats[number - 1] = materialise(told_itself(kept, SEATS, number - 1, "numbers"), "lm_seats")
        discard(asks)
        if number % 4 == 3:
            free_shuffles(spark)
        for held, old in ((words, [r for r in words if r < number and r and r - 1 not in samples]),
                          (seats, [r for r in seats if r < number - 1 and r not in samples])):
            for r in old:
                discard(held.pop(r))
    drawn = [told_itself(states, PAIRS, 0, "pairs", "customers"), *(seats[r] for r in samples)]
    seated = meeting(blocks, drawn, _seat_asks(ranges, samples), ASK).groupBy("range").applyInArrow(_tell_seats, REPLY)
    return meeting(blocks, [seated, *(words[r] for r in (0, *(r + 1 for r in samples)))], _scored(totals, samples), SCORE)

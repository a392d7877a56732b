"""Importance resampling towards a target: hashed word features, found by an Aho-Corasick dictionary that carries checksums."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_spark.functions.scale import number_rows
from retail_spark.llm import crc
from retail_spark.llm.common import per_worker
from retail_spark.session import discard, materialise

# Fixed values of the contract.
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7

#: Words in the dictionary at most, and bytes of one at most: what is broadcast is at most 4 MB. All other words are
#: hashed where they stand.
DICTIONARY, WORD_BYTES = 131_072, 32
#: Bytes of text that are scanned together; a longer text is scanned alone.
PART = 1 << 20
#: Distinct words that a task counts before it gives them out.
HELD = 400_000

#: A-Z lower-cased; digits, letters and all bytes beyond ASCII stay; everything else is a delimiter.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_END = b"\x00"  # stands for the end of a text between its neighbours; no word holds it

FEATURES = "doc_id bigint, n_words bigint, features binary"
FEATURE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("features", pa.binary())])


def _word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts, of words that may enter the dictionary."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def given(counts: Counter) -> pa.RecordBatch:
        kept = {w: n for w, n in counts.items() if len(w) <= WORD_BYTES}
        return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update((text or "").encode().translate(_WORDS).split())
                if len(counts) >= HELD:
                    yield given(counts)
                    counts = Counter()
        yield given(counts)

    return texts.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary_words(texts: DataFrame, size: int = DICTIONARY) -> list[bytes]:
    """The most frequent words, ``size`` at most: all that occur at least 2^k times, for the smallest k that keeps to it.

    The bound holds at every size of the corpus, and which words are in changes the speed only.
    """
    counted = materialise(_word_counts(texts).withColumn("level", F.floor(F.log2("n")).cast("int")), "word_counts")
    levels = counted.groupBy("level").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect()  # 63 at most
    least, total = 64, 0
    for r in levels:
        total += r["words"]
        if total > size:
            break
        least = r["level"]
    words = [bytes(r["word"]) for r in counted.filter(F.col("level") >= least).select("word").collect()]
    discard(counted)
    return sorted(words)


class Dictionary:
    """Words between delimiters in one automaton. A match gives the word's number, by which its payload is found:

    the checksum of the word, that of the word and a space, and its length in bytes. Number 0 is the end of a text.
    """

    def __init__(self, words: list[bytes]):
        words = [_END, *words]
        self.checks = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.opened = np.array([zlib.crc32(w + b" ") for w in words], np.uint32)
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.automaton = ahocorasick.Automaton()
        for number, word in enumerate(words):
            self.automaton.add_word(f" {word.decode('latin-1')} ", number)  # a character a byte
        self.automaton.make_automaton()

    def features(self, texts: list[bytes], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """(words, buckets of its features) of each text; ``texts`` have passed through _WORDS.

        Neighbouring words share the delimiter between them, which ends one key and begins the next. The bucket of two
        words comes from their payloads, without reading them again.
        """
        whole = b" " + b"".join(t + b" \x00 " for t in texts)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(whole.decode("latin-1"))), np.int64).reshape(-1, 2)
        space = np.frombuffer(whole, np.uint8) == 32
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        lengths = ends - starts
        known = np.searchsorted(ends, found[:, 0])
        number = np.full(len(starts), -1, np.int64)
        number[known] = found[:, 1]
        checks, opened = self.checks[number], self.opened[number]
        for i in np.flatnonzero(number < 0):  # words outside the dictionary
            checks[i] = zlib.crc32(whole[starts[i] : ends[i]])
            opened[i] = crc.continued(int(checks[i]), b" ")
        pairs = crc.joined(opened[:-1], checks[1:], np.minimum(lengths[1:], crc.TABLED))
        for i in np.flatnonzero(lengths[1:] > crc.TABLED):
            pairs[i] = crc.continued(int(opened[i]), whole[starts[i + 1] : ends[i + 1]])
        is_word = number != 0
        both = np.empty((len(starts), 2), np.uint16)
        both[:, 0] = checks % np.uint32(buckets)
        both[:-1, 1] = pairs % np.uint32(buckets)
        both[-1:, 1] = 0
        counts = np.zeros((len(starts), 2), bool)
        counts[:, 0] = is_word
        counts[:-1, 1] = is_word[:-1] & is_word[1:]
        marks = np.flatnonzero(~is_word)
        sizes = np.cumsum(counts.sum(axis=1))[marks]
        chosen = both[counts]
        begin, first = 0, 0
        for mark, size in zip(marks.tolist(), sizes.tolist(), strict=True):
            yield mark - begin, chosen[first:size]
            begin, first = mark + 1, size


def _runs(texts: list[str | None]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        raw = (text or "").encode().translate(_WORDS)
        if held and size + len(raw) > PART:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield held


def features(docs: DataFrame, words: list[bytes], buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, features): the buckets of a text's words and pairs of neighbours, two bytes each, in order."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    name = "dictionary_" + hashlib.md5(b" ".join(words)).hexdigest()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = per_worker(name, lambda: Dictionary(shared.value))
        for batch in batches:
            at = 0
            for run in _runs(batch.column(1).to_pylist()):
                n_words, found = [], []
                for n, chosen in dictionary.features(run, buckets):
                    n_words.append(n)
                    found.append(chosen.astype("<u2").tobytes())
                ids = batch.column(0).slice(at, len(run))
                at += len(run)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(found, pa.binary())], schema=FEATURE_SCHEMA)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(scan, FEATURES)


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket, over all texts: one row a bucket and task, ``buckets`` rows in the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(data, "<u2"), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    counted = found.select("features").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> list[int]:
    """1000 times the log of how much likelier a bucket is in the target than in the raw texts, rounded down; one is added to every count."""
    all_raw, all_target, n = float(raw.sum()), float(target.sum()), len(raw)
    return [
        math.floor(1000 * math.log(((float(t) + 1) * (all_raw + n)) / ((float(s) + 1) * (all_target + n))))
        for s, t in zip(raw.tolist(), target.tolist(), strict=True)
    ]


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise of a document, in thousandths, from a hash of its id; a null id is hashed as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(found: DataFrame, gains: list[int], seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of ``features``."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight", "score")])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(gains, np.int64)
        for batch in batches:
            ids, n_words, data = (c.to_pylist() for c in batch.columns)
            out = []
            for doc, n, raw in zip(ids, n_words, data, strict=True):
                buckets = np.frombuffer(raw, "<u2")
                weight = int(table[buckets].sum()) // len(buckets) if len(buckets) else 0
                out.append((doc, n, len(buckets), weight, weight + noise(doc, seed)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return found.mapInArrow(score, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def importance(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """One row per document of ``docs``: doc_id, n_features, weight, score, rank (the contract's columns).

    ``target`` has texts in ``text``. A null text has no words, weight 0, and no rank, as all documents of fewer than
    ``min_words`` words; a null id ranks before all others at equal scores. Repeated rows are documents of their own and
    may all be drawn. An empty target leaves all buckets without a count there; an empty table gives no rows. Other columns are passed over.
    """
    docs, target = docs.select("doc_id", "text"), target.select("text")
    words = dictionary_words(docs.select("text"))
    found = materialise(features(docs, words, buckets), "features")
    aimed = materialise(features(target.select(F.lit(0).alias("doc_id"), "text"), words, buckets), "target_features")
    gains = bucket_gains(bucket_counts(found, buckets), bucket_counts(aimed, buckets))
    discard(aimed)
    eligible = F.col("n_words") >= min_words
    drawn = F.call_function("div", F.lit(percent) * F.sum(eligible.cast("bigint")), F.lit(100))
    # The number of a row in the written table tells repeated rows apart; it is the same on every reading.
    scored = scores(found, gains, seed).withColumn("_row", F.monotonically_increasing_id())
    placed = number_rows(scored, [eligible.desc(), F.desc("score"), F.col("doc_id").asc_nulls_first(), "_row"], "_order", "scored")
    limit = placed.agg(F.coalesce(drawn, F.lit(0)).cast("bigint").alias("n")).scalar()
    discard(found)
    return placed.select(
        "doc_id", "n_features", "weight", "score", F.when(eligible & (F.col("_order") <= limit), F.col("_order")).alias("rank")
    )


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents drawn towards ``target``, with all their columns; rows that share a drawn id come together, rows of a null id never."""
    drawn = importance(docs, target, percent).filter(F.col("rank").isNotNull()).select("doc_id").distinct()
    return docs.join(drawn, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


IMPORTANCE_SQL = r"""
with recursive poly as (
  select range as b, list_reduce(list_prepend(range, range(8)),
         lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as entry from range(256)
), entries as (select list(entry order by b) as t from poly),
texts as (
  select 0 as kind, doc_id, coalesce(text, '') as text from documents union all select 1, item_id, coalesce(text, '') from benchmark
), numbered as (
  select kind, doc_id, row_number() over () as doc, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from texts
), places as (
  select kind, doc_id, doc, words, unnest(range(1, len(words) + 1)) as i from numbered
), feats as (
  select kind, doc_id, doc, words[i] as f from places
  union all select kind, doc_id, doc, words[i] || ' ' || words[i + 1] from places where i < len(words)
), hashed as (
  select f, (xor(list_reduce(list_prepend(4294967295::bigint, list_transform(
      string_split(regexp_replace(hex(encode(f)), '(..)', '\1 ', 'g'), ' ')[:-2], lambda h: ('0x' || h)::bigint)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::bigint) % 10000)::int as bucket
  from (select distinct f from feats), entries
), marked as (select kind, doc_id, doc, bucket from feats join hashed using (f)),
counts as (
  select bucket, count(*) filter (kind = 0) as s, count(*) filter (kind = 1) as t from marked group by bucket
), totals as (select count(*) filter (kind = 0) as s_all, count(*) filter (kind = 1) as t_all from marked),
gains as (
  select bucket, floor(1000 * ln(((t + 1)::double * (s_all + 10000)) / ((s + 1)::double * (t_all + 10000))))::bigint as gain
  from counts, totals
), weights as (
  select doc, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight
  from marked join gains using (bucket) where kind = 0 group by doc
), scored as (
  select doc_id, len(words) >= 20 as eligible, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || coalesce(doc_id::varchar, '')), 8))::bigint + 0.5)
           / 4294967296)))::bigint as score
  from numbered left join weights using (doc) where kind = 0
), placed as (
  select *, row_number() over (partition by eligible order by score desc, doc_id nulls first) as place,
         count(*) over (partition by eligible) as n from scored
)
select doc_id, n_features::bigint as n_features, weight, score,
       case when eligible and place <= 25 * n // 100 then place end as rank from placed
"""

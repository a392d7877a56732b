"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retail_spark.llm.common import NO_ID, box, runs, store_bucketed, unbox
from retail_spark.llm.components import components
from retail_spark.llm.hashing import mixed, seeds, shingles, signed, words_of
from retail_spark.llm.hpylm import packed, risen, rising, unpacked
from retail_spark.session import discard, materialise

SHINGLE = 5
SIMILARITY = 0.8
#: BANDS x ROWS samples: a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8^4)^16 = 0.9998.
BANDS, ROWS = 16, 4
#: Bands and least hashes in each by which texts are joined that count as one text for idf: of texts that share a share s of their shingles
#: two are joined with probability 1 - (1 - s^6)^6, and a group by any of its members.
COUNT_BANDS, COUNT_ROWS = 6, 6
#: A group of more than this share of all texts is no group of copies but what the corpus is made of: its texts count one by one.
COMMON = 0.1
#: Characters of texts whose shingles are asked for together, and texts at most.
BLOCK_CHARS, BLOCK_TEXTS = 3_000_000, 50_000
#: Shingles of the corpus for each range of hashes that a task counts at once, about.
RANGE_SHINGLES = 1_000_000
#: Texts of a bucket that one task holds; larger buckets are cut into blocks, and pairs of blocks meet.
BLOCK = 512

_U = np.uint64


# --- weights -----------------------------------------------------------------------------------------


def tf_idf(counts: np.ndarray, df: np.ndarray, texts: int) -> np.ndarray:
    """(1 + ln tf) x idf of shingles that stand in ``df`` of all counted texts."""
    return (1.0 + np.log(counts)) * idf_of(texts, df)


def idf_of(texts: float, df: np.ndarray) -> np.ndarray:
    """The smooth idf 1 + ln((N + 1) / (df + 1)) as a share of what it is for a shingle of one text, or of none that counts."""
    df = np.maximum(df, 1)
    idf = (1.0 + np.log((texts + 1.0) / (df + 1.0))) / (1.0 + np.log((texts + 1.0) / 2.0))
    return np.where(df == 1, 1.0, idf)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller weights over sum of the larger ones; a text is (sorted hashes, weights), not empty."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    least = np.minimum(a[1][same], b[1][at[same]]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


def weigh(text: str, df: bytes, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """A text as (sorted shingle hashes, weights); ``df`` has the counts of its distinct shingles in that order."""
    parts = [shingles(w, SHINGLE)[0] for w in words_of([text])]
    own, counts = np.unique(parts[0], return_counts=True)
    return own, tf_idf(counts, unpacked(df, np.uint32), texts)


# --- sampling ----------------------------------------------------------------------------------------


def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """2^16 draws of (r, ln c, beta) as consistent weighted sampling needs them, in order of the value they give weight 1.

    A shingle's draw for a sample is picked by the top bits of its hash for
    that sample. As the draws are in order, the least hash has the least value
    among shingles of weight 1, and only other weights need the formula.
    """
    n = 1 << 16
    u = (seeds(5 * n, 5000) >> _U(11)).astype(np.float64) / float(1 << 53) + 2.0**-54
    u1, u2, v1, v2, beta = u.reshape(5, n)
    r, ln_c = -np.log(u1 * u2), np.log(-np.log(v1 * v2))
    order = np.argsort(ln_c - r * (1 - beta), kind="stable")
    return r[order], ln_c[order], beta[order]


def samples(hashes: np.ndarray, weights: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """n consistent weighted samples of each text (none empty): two texts agree in one with their weighted Jaccard probability.

    For a shingle of weight S and a draw (r, c, beta): t = floor(ln S / r + beta),
    ln a = ln c - r (t - beta + 1); the shingle of least a is sampled, together with its t.
    """
    r, ln_c, beta = _draws()
    at_one = ln_c - r * (1 - beta)
    plain = weights == 1.0
    other = np.flatnonzero(~plain)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[other]
    log_w = np.log(weights[other])
    top = _U(0xFFFFFFFFFFFFFFFF)
    has_other = np.unique(text)
    other_bounds = np.searchsorted(text, has_other)
    out = np.empty((len(bounds) - 1, n), _U)
    for k, seed in enumerate(seeds(n, 9000)):
        h = mixed(hashes ^ seed)
        best = np.minimum.reduceat(np.where(plain, h, top), bounds[:-1])
        sampled, steps = best.copy(), np.zeros(len(best))  # at weight 1, t is 0
        if len(other):
            own = h[other]
            pick = (own >> _U(48)).astype(np.int64)
            t = np.floor(log_w / r[pick] + beta[pick])
            a = ln_c[pick] - r[pick] * (t - beta[pick] + 1)
            least = np.minimum.reduceat(a, other_bounds)
            sizes = np.diff(np.append(other_bounds, len(a)))
            first = np.where(a == np.repeat(least, sizes), own, top)
            chosen = np.minimum.reduceat(first, other_bounds)
            at = other_bounds + _first_equal(first, np.repeat(chosen, sizes), other_bounds)
            plain_best = best[has_other]
            plain_a = np.where(plain_best == top, np.inf, at_one[(plain_best >> _U(48)).astype(np.int64)])
            wins = (least < plain_a) | ((least == plain_a) & (chosen < plain_best))
            sampled[has_other] = np.where(wins, chosen, plain_best)
            steps[has_other] = np.where(wins, t[at], 0.0)
        out[:, k] = mixed(sampled + (steps + 1000.0).astype(np.int64).astype(_U) * _U(0x9E3779B97F4A7C15))
    return out


def _first_equal(values: np.ndarray, wanted: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each segment, the place in it of the first value that is the wanted one."""
    hits = np.flatnonzero(values == wanted)
    return hits[np.searchsorted(hits, bounds)] - bounds


# --- tasks -------------------------------------------------------------------------------------------


def _key(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _keys(texts: list[str | None]) -> list[bytes]:
    return [_key(x.hashes[a:b].tobytes()) for x in words_of(texts) for a, b in zip(x.bounds, x.bounds[1:])]  # noqa: B905


def _keyed(with_text: bool):
    """Documents with their keys (128 bits of their words)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array(_keys(batch.column(1).to_pylist()), pa.binary())
            columns = [batch.column(0), keys, *([batch.column(1)] if with_text else [])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "node", "text"][: len(columns)])

    return work


def _per_text(hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a, b in zip(bounds.tolist(), bounds.tolist()[1:]):  # noqa: B905
        yield np.unique(hashes[a:b], return_counts=True)


TEXTS = "block bigint, size bigint, chars bigint, nodes array<binary>, texts array<string>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with a word, in blocks."""
    nodes, texts, size = [], [], 0
    none = _key(b"")

    def block() -> pa.RecordBatch:
        columns = [
            pa.array([uuid.uuid4().int >> 65]),  # written once, then only read
            pa.array([len(texts)], pa.int64()), pa.array([size], pa.int64()),
            pa.array([nodes], pa.list_(pa.binary())), pa.array([texts], pa.list_(pa.string())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["block", "size", "chars", "nodes", "texts"])

    for batch in batches:
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node == none:
                continue
            nodes.append(node)
            texts.append(text)
            size += len(text)
            if size >= BLOCK_CHARS or len(texts) >= BLOCK_TEXTS:
                yield block()
                nodes, texts, size = [], [], 0
    if texts:
        yield block()


def _counted(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text its distinct shingles, sorted, and how often it has them."""
    return [x for words in words_of(texts) for x in _per_text(*shingles(words, SHINGLE))]


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, node): of each text COUNT_BANDS values of COUNT_ROWS least hashes of its shingles."""
    factors = seeds(COUNT_BANDS * COUNT_ROWS, 7000) | _U(1)
    for batch in batches:
        for row in batch.to_pylist():
            found = _counted(row["texts"])
            value = np.zeros((len(found), COUNT_BANDS), _U)
            for at in range(0, len(found), 256):
                part = found[at : at + 256]
                hashes, starts = np.concatenate([own for own, _ in part]), np.cumsum([0, *(len(own) for own, _ in part[:-1])])
                for k, factor in enumerate(factors):
                    rows = slice(at, at + len(part)), k % COUNT_BANDS
                    value[rows] = mixed(value[rows] * _U(31) + np.minimum.reduceat(hashes * factor, starts))
            value += np.arange(COUNT_BANDS, dtype=_U)[None, :] * _U(0x9E3779B97F4A7C15)
            nodes = pa.array(row["nodes"], pa.binary()).take(pa.array(np.repeat(np.arange(len(found)), COUNT_BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(signed(value.ravel())), nodes], names=["bucket", "node"])


ASK = "range int, block bigint, keys binary, counts binary"
REPLY = "block bigint, range int, counts binary"


def _asks(ranges: int):
    """Every distinct shingle of a block with the number of its counted texts that have it, cut by ranges of hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                owns, counted = [own for own, _ in _counted(row["texts"])], np.ones(len(row["texts"]), bool)
                counted[row["copies"] or []] = False
                keys, place = np.unique(np.concatenate(owns), return_inverse=True)
                counts = np.bincount(place, np.repeat(counted, [len(own) for own in owns]), len(keys)).astype(np.uint32)
                edges = np.searchsorted(_range_of(keys, ranges), np.arange(ranges + 1))
                cuts = [(r, a, b) for r, (a, b) in enumerate(zip(edges.tolist(), edges.tolist()[1:], strict=False)) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r for r, _, _ in cuts], pa.int32()), pa.array([row["block"]] * len(cuts), pa.int64()),
                        pa.array([rising(keys[a:b]) for _, a, b in cuts], pa.binary()),
                        pa.array([packed(counts[a:b]) for _, a, b in cuts], pa.binary()),
                    ],
                    names=["range", "block", "keys", "counts"],
                )

    return work


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Ranges by the upper half of a hash, which rise with it."""
    return (((keys >> _U(32)) * _U(ranges)) >> _U(32)).astype(np.int64)


def _added(rows: pa.Table) -> pa.Table:
    """How many counted texts have each shingle of a range, told to every block that has it."""
    keys = [risen(x) for x in rows["keys"].to_pylist()]
    counts = np.concatenate([unpacked(x, np.uint32) for x in rows["counts"].to_pylist()])
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=counts).astype(np.uint32)[place]
    ends = np.cumsum([len(k) for k in keys]).tolist()
    told = [packed(np.ascontiguousarray(total[e - len(k) : e])) for k, e in zip(keys, ends, strict=True)]
    return pa.table({"block": rows["block"], "range": rows["range"], "counts": pa.array(told, pa.binary())})


SIGNED = "node binary, text string, df binary, bands array<bigint>"


def _sign(n: int):
    """Of each of the ``n`` texts the document counts of its distinct shingles, and its band values."""

    def work(block: pa.Table, told: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        answers = sorted(zip(told["range"].to_pylist(), told["counts"].to_pylist(), strict=True))
        df = np.concatenate([unpacked(x, np.uint32) for _, x in answers])
        found = _counted(row["texts"])
        keys = np.unique(np.concatenate([own for own, _ in found]))
        dfs = [df[np.searchsorted(keys, own)] for own, _ in found]
        values = []
        for at in range(0, len(found), 256):
            part = list(zip(found[at : at + 256], dfs[at : at + 256], strict=True))
            ends = np.cumsum([0, *(len(own) for (own, _), _ in part)])
            weights = np.concatenate([tf_idf(counts, k, n) for (_, counts), k in part])
            drawn = samples(np.concatenate([own for (own, _), _ in part]), weights, ends, BANDS * ROWS)
            value = np.zeros((len(part), BANDS), _U)
            for r in range(ROWS):
                value = mixed(value * _U(31) + drawn[:, r::ROWS])
            values.append(value + np.arange(BANDS, dtype=_U)[None, :] * _U(0x9E3779B97F4A7C15))
        flat = pa.array(signed(np.concatenate(values).ravel()))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS), flat)
        return pa.table(
            {
                "node": pa.array(row["nodes"], pa.binary()), "text": pa.array(row["texts"], pa.string()),
                "df": pa.array([packed(k) for k in dfs], pa.binary()), "bands": lists,
            }
        )

    return work


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order to pairs of neighbours in a bucket. A partition's first and last rows are given out too, with no neighbour."""
    names = ["bucket", "band", "next", "after", "u", "v"]
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        alone = rows.slice(0, 1) if last is None else None
        rows = rows if last is None else pa.concat_tables([last, rows]).combine_chunks()
        last = rows.slice(rows.num_rows - 1, 1)
        bucket = rows["bucket"].to_numpy()
        at = np.flatnonzero(bucket[1:] == bucket[:-1])
        head = rows.take(pa.array(at))
        later = rows["node"].take(pa.array(at + 1)).combine_chunks()
        columns = [head[c].combine_chunks() for c in ("bucket", "band", "next", "after", "node")]
        yield pa.RecordBatch.from_arrays([*columns, later], names=names)
        if alone is not None:
            yield _edge(alone, names)
    if last is not None:
        yield _edge(last, names)


def _edge(row: pa.Table, names: list[str]) -> pa.RecordBatch:
    columns = [row[c].combine_chunks() for c in ("bucket", "band", "next", "after", "node")]
    return pa.RecordBatch.from_arrays([*columns, pa.nulls(1, pa.binary())], names=names)


def _similar(n: int, least: float):
    """Keeps the pairs of the ``n`` texts whose weighted Jaccard similarity is at least ``least``. A pair's last text is often the one before's."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, weighed = None, None
        for batch in batches:
            u, v, a, b, df_a, df_b = (batch.column(i).to_pylist() for i in range(6))
            keep = []
            for i in range(len(u)):
                if v[i] != last:
                    last, weighed = v[i], weigh(b[i], df_b[i], n)
                if weighted_jaccard(weigh(a[i], df_a[i], n), weighed) >= least - 1e-12:
                    keep.append(i)
            yield _pairs([(u[i], v[i]) for i in keep])

    return verify


def _pairs(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in found], pa.binary()), pa.array([p[1] for p in found], pa.binary())], names=["u", "v"]
    )


def _joining(n: int, least: float):
    """Links between texts of one bucket that are not in one group yet, from rows in order of (bucket, low, high).

    Every pair of the two blocks is tried, unless a link found here has joined
    its groups, the weights differ too much for the similarity, or the pair shares an earlier band, in whose bucket it is tried.
    """

    def links(rows: dict[str, list], low: int, high: int) -> list[tuple[bytes, bytes]]:
        order = sorted(range(len(rows["node"])), key=lambda i: rows["node"][i])
        node, block = [rows["node"][i] for i in order], np.array([rows["block"][i] for i in order])
        names = {g: i for i, g in enumerate(set(rows["group"]))}
        group = np.array([names[rows["group"][i]] for i in order])
        bands = np.array([rows["bands"][i] for i in order], np.int64)[:, : rows["band"][0]]
        texts = [weigh(rows["text"][i], rows["df"][i], n) for i in order]
        total = np.array([w.sum() for _, w in texts])
        found = []
        for i in range(1, len(node)):
            fits = np.minimum(total[:i], total[i]) >= (least - 1e-12) * np.maximum(total[:i], total[i])
            others = np.flatnonzero((group[:i] != group[i]) & fits & ((block[:i] != block[i]) | (low == high)))
            others = others[~(bands[others] == bands[i]).any(axis=1)]
            for j in others.tolist():
                if group[j] != group[i] and weighted_jaccard(texts[i], texts[j]) >= least - 1e-12:
                    found.append((node[i], node[j]))
                    group[group == group[j]] = group[i]
        return found

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, low, high), rows in runs(batches, ["bucket", "low", "high"]):
            yield _pairs(links(rows, low, high))

    return work


# --- the operator ------------------------------------------------------------------------------------


def _groups(docs: DataFrame, text: str, similarity: float) -> DataFrame:
    """(doc, node, group) of every document; see ``near_duplicates``."""
    slim = _slim(docs, text)
    members = materialise(slim.mapInArrow(_keyed(False), "doc bigint, node binary"), "members")
    bands, n = _signed_texts(slim, members)
    neighbours = _in_buckets(bands)
    entries = materialise(
        neighbours.select("bucket", "band", F.explode(F.array("u", "v")).alias("node")).distinct(), "entries"
    )
    texts = materialise(bands.join(entries.select("node").distinct(), "node", "left_semi"), "texts")
    near = _verified(neighbours.select("u", "v").distinct(), texts, n, similarity)
    links = materialise(near, "links")
    rest = _rest(entries, components(links), texts).mapInArrow(_joining(n, similarity), "u binary, v binary")
    groups = components(links.unionByName(materialise(rest, "links")))
    discard(texts)
    grouped = members.join(groups, "node", "left").select("doc", "node", F.coalesce("group", "node").alias("group"))
    return materialise(grouped, "groups")


def _signed_texts(slim: DataFrame, members: DataFrame) -> tuple[DataFrame, int]:
    """(node, text, df, bands) of every distinct text with a word, and the number of those counted.

    Documents are counted over distinct texts, and of near copies over one (``_copies``), so that copies weigh nothing twice. Texts are cut into blocks once. A block
    tells its distinct shingles by ranges of their hashes; each range adds them up over all blocks and tells the counts back. A
    shingle has one entry a block, however common it is, and ranges grow in number, not in size, with the corpus.
    """
    spark = slim.sparkSession
    chosen = members.groupBy("node").agg(F.min("doc").alias("doc"))
    keyed = slim.mapInArrow(_keyed(True), "doc bigint, node binary, text string")  # rows that share an id may differ in text
    distinct = keyed.join(chosen, ["doc", "node"], "left_semi").dropDuplicates(["doc", "node"])
    blocks = store_bucketed(distinct.select("node", "text").mapInArrow(_blocks, TEXTS), "block", "near_blocks")
    n, chars = (x or 0 for x in blocks.agg(F.sum("size"), F.sum("chars")).first())
    copies = _copies(blocks, n)
    n -= copies.count()
    places = blocks.select("block", F.posexplode("nodes").alias("place", "node")).join(copies, "node")
    copied = places.groupBy("block").agg(F.collect_list("place").alias("copies"))
    ranges = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // (6 * RANGE_SHINGLES)))
    asks = blocks.join(copied, "block", "left").select("block", "texts", "copies").mapInArrow(_asks(ranges), ASK)
    told = materialise(asks.groupBy("range").applyInArrow(_added, REPLY), "near_counts")
    signs = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_sign(n), SIGNED)
    bands = materialise(signs, "bands")
    discard(told)
    discard(copies)
    discard(blocks)
    return bands, n


def _copies(blocks: DataFrame, n: int) -> DataFrame:
    """(node) of the texts that don't count for idf: of each group of near copies all but one.

    Groups are joined by least hashes of their shingles, whatever those weigh. Members of a large group would otherwise weigh
    what they share ever less, and their own edits would part them.
    """
    rows = materialise(blocks.select("nodes", "texts").mapInArrow(_least, "bucket bigint, node binary"), "near_least")
    first = rows.groupBy("bucket").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("bucket", "v")
    groups = components(rows.join(first, "bucket").select(F.col("node").alias("u"), "v").distinct())
    small = groups.groupBy("group").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= F.lit(COMMON * n)).select("group")
    copies = materialise(groups.join(small, "group").filter(F.col("node") != F.col("group")).select("node"), "near_copies")
    discard(rows)
    return copies


def _in_buckets(bands: DataFrame) -> DataFrame:
    """Pairs of neighbours in the buckets: (bucket, band, u, v), in order of the next two bands' values.

    Texts that agree on those too are likely similar, so neighbours of a large bucket soon
    join its copies to one group. The rows are dealt out by ranges of that order, so that a bucket may spread over
    many partitions; pairs across their borders are added from the rows at the ends, two per partition.
    """
    value = lambda step: F.element_at("bands", (F.col("band") + step) % BANDS + 1)
    rows = bands.select("node", "bands", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")).select(
        value(0).alias("bucket"), "band", value(1).alias("next"), value(2).alias("after"), "node"
    )
    order = ["bucket", "next", "after", "node"]
    found = materialise(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_neighbours, "bucket bigint, band int, next bigint, after bigint, u binary, v binary"),
        "neighbours",
    )
    before = Window.partitionBy("bucket").orderBy("next", "after", "u")
    across = (
        found.filter(F.col("v").isNull())
        .withColumn("_before", F.lag("u").over(before))
        .filter(F.col("_before") != F.col("u"))
        .select("bucket", "band", F.col("_before").alias("u"), F.col("u").alias("v"))
    )
    return found.filter(F.col("v").isNotNull()).select("bucket", "band", "u", "v").unionByName(across)


def _rest(entries: DataFrame, groups: DataFrame, texts: DataFrame) -> DataFrame:
    """The buckets with texts of several groups, with all that is needed to try them, in pairs of blocks of BLOCK texts."""
    placed = entries.join(groups, "node", "left").select(
        "bucket", "band", "node", F.coalesce("group", "node").alias("group")
    )
    opened = (
        placed.groupBy("bucket")
        .agg(F.min("group").alias("_a"), F.max("group").alias("_b"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_a") != F.col("_b"))
        .select("bucket", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"))
    )
    block = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    return (
        placed.join(opened, "bucket")
        .withColumn("block", block)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(
            "bucket", "band", "node", "group", "block",
            F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"),
        )
        .join(texts, "node")
        .repartition("bucket", "low", "high")
        .sortWithinPartitions("bucket", "low", "high")
    )


def _slim(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), F.col(text).alias("text")
    )


def near_duplicates(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, and class_id, the smallest id in its group of near-duplicates.

    Texts are lower-cased (A-Z) and cut at white space into shingles of five words; a text of one to four
    words is one shingle; texts without a word, null ones included, are copies
    of each other. Copies are joined by 128 bits of their words first. Of the rest each text is sampled and banded, and
    similar texts that share a bucket are in one group. A null id is smaller than all
    others and gives a null class. Rows that share an id are documents of their own.

    No bucket emits all its pairs. First only neighbours in an order by further samples are held against each
    other, which makes one group of nearly all copies, however many. Then the buckets with texts of
    several groups are closed: blocks of their texts meet in a task, and every pair whose groups differ
    is tried there. So no link between groups is given up, and only links are emitted.
    """
    grouped = _groups(docs, text, similarity)
    smallest = grouped.groupBy("group").agg(F.min("doc").alias("_smallest"))
    real = lambda name: F.when(F.col(name) != NO_ID, F.col(name))
    return grouped.join(smallest, "group").select(real("doc").alias("doc_id"), real("_smallest").alias("class_id"))


def _verified(pairs: DataFrame, texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """Those of the pairs that are similar."""
    first = texts.select(F.col("node").alias("u"), F.col("text").alias("a"), F.col("df").alias("df_a"))
    last = texts.select(F.col("node").alias("v"), F.col("text").alias("b"), F.col("df").alias("df_b"))
    both = pairs.join(first, "u").join(last, "v").select("u", "v", "a", "b", "df_a", "df_b")
    return both.mapInArrow(_similar(n, similarity), "u binary, v binary")


def drop_near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Of each group of near-duplicates one document: the one with the smallest id; of rows that share it, one."""
    boxed = box(docs, text)
    schema = T.StructType([*boxed.schema.fields, T.StructField("node", T.BinaryType())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array(_keys(batch.column(1).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=["row", "text", "node"])

    best = _groups(docs, text, SIMILARITY).groupBy("group").agg(F.min(F.struct("doc", "node")).alias("best"))
    rows = boxed.mapInArrow(keyed, schema)
    rows = rows.withColumn("doc", F.coalesce(F.col("row.doc_id").cast("bigint"), F.lit(NO_ID)))
    kept = rows.join(best.select("best.doc", "best.node"), ["doc", "node"], "left_semi").dropDuplicates(["doc", "node"])
    return unbox(kept, docs, F.lit(False), text)

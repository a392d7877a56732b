"""Exact top-k search by vector-approximation files: bounds from quantised cells, exact vectors in the order of the bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retail_spark.session import discard, materialise

# Fixed values of the contract.
SCALE = 64
EVERY = 20
K = 20

#: Bits of a cell: each component is told apart to one of 2**BITS steps between its least and largest value in the block.
BITS = 8
#: Vectors in a block of the file, about, queries in a block of queries, and queries whose bounds are held at once.
VECTORS, QUERIES, HELD = 16384, 1024, 64
#: Exact vectors that each query reads first, those of the highest bounds.
READ = 64
#: What rounding may change in a bound, as a share of the largest products it is made of, for each component.
ROUNDING = 2.0**-50

FILE = pa.schema(
    [(n, t) for n, t in (("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("places", pa.binary()), ("low", pa.binary()), ("step", pa.binary()), ("cells", pa.binary()))]
)


def whole_numbers(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): each component x as floor(64 x). Rows with a null id, vector or component, or a component that is not finite, go."""
    def whole(x):  # floor() gives a bigint; beyond 2**53 a double has no fraction
        y = x.cast("double") * SCALE
        return F.when(F.abs(y) < F.lit(2.0**53), F.floor(y).cast("double")).otherwise(y)

    v = F.transform(F.col(vector), whole)
    finite = F.forall(
        F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    return (
        vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector).alias(vector))
        .filter(F.col("vec_id").isNotNull() & F.col(vector).isNotNull())
        .filter(F.coalesce(finite, F.lit(False)))
        .select("vec_id", v.alias("v"))
    )


def _blocks(rows: pa.Table) -> pa.Table:
    """The rows of one deal to a block per dimension: ids, places in the table, per component the least value and the step, and the cells."""
    out = []
    lengths = np.array([len(v) for v in rows["v"].to_pylist()])
    ids, places = rows["vec_id"].to_numpy(), rows["place"].to_numpy()
    for dim in np.unique(lengths).tolist():
        chosen = np.flatnonzero(lengths == dim)
        exact = rows["v"].take(pa.array(chosen)).combine_chunks().flatten().to_numpy().reshape(len(chosen), dim)
        low, top = exact.min(axis=0), exact.max(axis=0)
        with np.errstate(all="ignore"):
            step = np.maximum(np.floor(top / 2**BITS - low / 2**BITS) + 1, (top / 2**BITS - low / 2**BITS) * (1 + ROUNDING))
            cells = np.clip(np.floor((exact - low) / step), 0, 2**BITS - 1).astype(np.uint8)
        numbers = (ids[chosen], places[chosen], low, step, cells)
        out.append((rows["block"][0].as_py(), dim, *(x.tobytes() for x in numbers)))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), FILE, strict=True)], schema=FILE)


def bounds(queries: np.ndarray, low: np.ndarray, step: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest inner product that each cell leaves open with each query, rounding included.

    Components are whole numbers, so the largest of a cell is the next cell's least one less; one that holds a single number leaves nothing open.
    """
    with np.errstate(all="ignore"):
        least = low + cells * step
        largest = np.maximum(np.abs(low), np.abs(low + 2**BITS * step))
        most = least + np.where((step == np.floor(step)) & (largest < 2.0**53), step - 1, step)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        off = (np.abs(queries) @ largest)[:, None] * (ROUNDING * (queries.shape[1] + 4))
        below, above = up @ least.T + down @ most.T - off, up @ most.T + down @ least.T + off
    # Where products pass the range of doubles nothing is known.
    return np.where(np.isnan(below), -np.inf, below), np.where(np.isnan(above), np.inf, above)


def _scan(batches: Iterator[pa.RecordBatch], give) -> Iterator[pa.RecordBatch]:
    """Meetings of a block of queries with a block of cells, a few queries at a time; ``give`` makes the rows of one query."""
    for batch in batches:
        for pair in batch.to_pylist():
            if pair["dim"] != pair["q_dim"]:
                continue
            dim, whole, real = pair["dim"], *(lambda name, t=t: np.frombuffer(pair[name], t) for t in (np.int64, np.float64))  # noqa: B023
            ids, places, rows, q_ids = (whole(name) for name in ("ids", "places", "q_rows", "q_ids"))
            cells = np.frombuffer(pair["cells"], np.uint8).reshape(len(ids), dim)
            queries, floors = real("q_exact").reshape(len(q_ids), dim), real("q_floor")
            out: list[tuple] = []
            for start in range(0, len(q_ids), HELD):
                least, most = bounds(queries[start : start + HELD], real("low"), real("step"), cells)
                for i in range(len(least)):
                    q = start + i
                    out += give(rows[q], np.flatnonzero(ids != q_ids[q]), least[i], most[i], floors[q], places)
            yield out


def _lower_bounds(k: int):
    """(row, bound): for each query the k largest lower bounds of a block."""

    def give(row, others, least, most, floor, places):
        bound = least[others]
        if len(bound) > k:
            bound = np.partition(bound, len(bound) - k)[len(bound) - k :]
        return [(row, x) for x in bound.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _scan(batches, give):
            rows, bound = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(bound, pa.float64())], names=["row", "bound"])

    return run


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, place, most): the vectors that may be among a query's best."""

    def give(row, others, least, most, floor, places):
        kept = others[most[others] >= floor]
        return list(zip([row] * len(kept), places[kept].tolist(), most[kept].tolist(), strict=True))

    for out in _scan(batches, give):
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        types = (pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["row", "place", "most"])


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact inner products: in doubles where all sums stay under 2**53, in whole numbers of any size elsewhere."""
    for batch in batches:
        a, b = batch.column(4), batch.column(5)
        n = batch.num_rows
        lengths = pc.list_value_length(a).to_numpy(zero_copy_only=False)
        scores = np.zeros(n, object)
        for dim in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == dim)
            x, y = (c.take(pa.array(at)).flatten().to_numpy().reshape(len(at), dim) for c in (a, b))
            with np.errstate(over="ignore"):
                small = (np.abs(x) * np.abs(y)).sum(axis=1) < 2.0**53
            scores[at[small]] = (x[small] * y[small]).sum(axis=1).astype(np.int64)
            for i in np.flatnonzero(~small):
                scores[at[i]] = sum(int(p) * int(q) for p, q in zip(x[i].tolist(), y[i].tolist(), strict=True))
        if any(not -(2**63) <= s < 2**63 for s in scores):
            raise OverflowError("a score is no bigint")
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(scores.tolist(), pa.int64())], names=["row", "query_id", "vec_id", "most", "score"])


def _query_block(rows: pa.Table) -> pa.Table:
    """The queries of one deal as one row per dimension."""
    out = []
    by_dim: dict[int, list] = {}
    for row in rows.to_pylist():
        by_dim.setdefault(len(row["v"]), []).append(row)
    for dim, members in by_dim.items():
        out.append(
            {
                "q_block": members[0]["q_block"],
                "q_dim": dim,
                "q_rows": np.array([m["row"] for m in members], np.int64).tobytes(),
                "q_ids": np.array([m["vec_id"] for m in members], np.int64).tobytes(),
                "q_exact": np.array([m["v"] for m in members], np.float64).tobytes(),
                "q_floor": np.array([m["floor"] for m in members], np.float64).tobytes(),
            }
        )
    schema = pa.schema(
        [("q_block", pa.int64()), ("q_dim", pa.int32()), *((n, pa.binary()) for n in ("q_rows", "q_ids", "q_exact", "q_floor"))]
    )
    return pa.Table.from_pylist(out, schema=schema)


def _meet(file: DataFrame, queries: DataFrame, q_blocks: int, blocks: int) -> DataFrame:
    """Every block of queries beside every block of cells: a grid of equal keys, each meeting a row of its own."""
    dealt = (
        queries.withColumn("q_block", F.pmod(F.xxhash64("vec_id", "row"), F.lit(q_blocks)))
        .groupBy("q_block")
        .applyInArrow(_query_block, "q_block bigint, q_dim int, q_rows binary, q_ids binary, q_exact binary, q_floor binary")
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    )
    grid = file.withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(q_blocks - 1).cast("bigint"))))
    return grid.join(by_merging(dealt), ["q_block", "block"])


def by_merging(df: DataFrame) -> DataFrame:
    """``df`` for a join that sorts and merges: files of vectors and bounds are many times larger in memory, so Spark would send them to the driver."""
    return df.hint("merge")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, vector: str = "embedding") -> DataFrame:
    """For each vector whose id is divisible by ``every``: the k others of highest integer inner product, exactly at every size.

    Three passes. The first meets blocks of queries with blocks of cells, a stated query set against all rows, and leaves
    the k largest lower bounds of each query and block; the k-th of all is a floor that k vectors are certain to reach. The
    second meets them again and leaves the vectors whose upper bound reaches the query's floor. Exact vectors are read in
    the third only, by their place in the table, for those left: first the READ of highest bounds, whose k-th score is a higher
    floor, then the others that may still reach it. Cells alone travel in the first two passes.

    Of rows with the same vector, however many, only those of the k + 1 smallest ids can be among the best, as a
    query's own id takes one of them at most, and of each id k rows. The rest are left out of the file by rank
    limits before it is built. No join sends a table to the driver. All rows with a query's own id are its own. A score that is no bigint is an error, as in SQL. Repeated query rows are answered
    each. Vectors of different length do not meet. Ties go to the smaller id.
    """
    numbers = whole_numbers(vectors, vector=vector)
    repeated = Window.partitionBy("v", "vec_id").orderBy("vec_id")
    same = Window.partitionBy("v").orderBy("vec_id")
    few = numbers.withColumn("_n", F.row_number().over(repeated)).filter(F.col("_n") <= k)
    distinct = materialise(few.withColumn("_n", F.dense_rank().over(same)).filter(F.col("_n") <= k + 1).drop("_n"), "va_vectors")
    placed = distinct.withColumn("place", F.monotonically_increasing_id())  # the same on every reading of the written table
    blocks = max(1, -(-distinct.count() // VECTORS))
    stored = (
        placed.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)))
        .groupBy("block")
        .applyInArrow(_blocks, "block bigint, dim int, ids binary, places binary, low binary, step binary, cells binary")
    )
    file = materialise(stored, "va_file")
    queries = materialise(
        numbers.filter(F.col("vec_id") % every == 0).withColumn("row", F.monotonically_increasing_id()), "va_queries"
    )
    q_blocks = max(1, -(-queries.count() // QUERIES))

    lowest = F.lit(float("-inf"))
    lower = _meet(file, queries.withColumn("floor", lowest), q_blocks, blocks).mapInArrow(_lower_bounds(k), "row bigint, bound double")
    highest = Window.partitionBy("row").orderBy(F.desc("bound"))
    floors = (
        lower.withColumn("_n", F.row_number().over(highest))
        .filter(F.col("_n") <= k)
        .groupBy("row")
        .agg(F.when(F.count(F.lit(1)) >= k, F.min("bound")).otherwise(lowest).alias("floor"))
    )
    aimed = queries.join(by_merging(floors), "row", "left").withColumn("floor", F.coalesce("floor", lowest))
    left = materialise(
        _meet(file, aimed, q_blocks, blocks).mapInArrow(_candidates, "row bigint, place bigint, most double"), "va_candidates"
    )
    discard(file)

    def read(chosen: DataFrame) -> DataFrame:
        return (
            chosen.join(by_merging(placed.withColumnRenamed("v", "_v")), "place")
            .join(by_merging(queries.select("row", F.col("vec_id").alias("query_id"), "v")), "row")
            .select("row", "query_id", "vec_id", "most", "v", "_v")
            .mapInArrow(_scores, "row bigint, query_id bigint, vec_id bigint, most double, score bigint")
        )

    order = Window.partitionBy("row").orderBy(F.desc("most"), "place")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    first = left.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max(READ, k)).drop("_n")
    early = materialise(read(first), "va_scores")
    certain = (
        early.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") == k).select("row", F.col("score").alias("_floor"))
    )
    last = early.groupBy("row").agg(F.min("most").alias("_last"))  # no vector beyond those read has a higher bound
    rest = left.join(by_merging(certain), "row").join(by_merging(last), "row").filter((F.col("most") >= F.col("_floor")) & (F.col("most") <= F.col("_last")))
    late = read(rest.join(by_merging(first.select("row", "place")), ["row", "place"], "left_anti").select("row", "place", "most"))
    return (
        early.unionByName(late)
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


TOP_K_SQL = """
with numbers as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::hugeint) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id,
         list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from numbers q join numbers c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id
)
select query_id, rank, vec_id, score
from (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from scored)
where rank <= 20
"""

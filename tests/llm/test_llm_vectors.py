"""Exact top-k search over repeated rows and large components."""

from retail_spark.llm import vafile
from retail_spark.llm.vafile import top_k


def brute(rows, query, k=20):
    from math import floor

    whole = [(i, [floor(64 * x) for x in v]) for i, v in rows]
    own = next(v for i, v in whole if i == query)
    scored = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in whole if i != query)
    return [(n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]


def found(spark, rows, query):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    return sorted((r.rank, r.vec_id, r.score) for r in set(top_k(frame).collect()) if r.query_id == query)


def test_own_rows_do_not_use_up_the_cut(spark):
    rows = [(20, [1.0, 2.0])] * 25 + [(21, [1.0, 2.0])] * 23 + [(22, [1.0, 2.0])] + [(30 + i, [0.5, 0.25 + i]) for i in range(9)]
    got = found(spark, rows, 20)
    assert got == brute(rows, 20) and (1, 38, 4096 // 2 + 8 * 128 * 64 + 128 * 16) in got
    rows = [(20, [1.0, 2.0])] * 25 + [(21, [1.0, 2.0])] + [(30, [0.5, 0.5])]
    assert [x[1] for x in found(spark, rows, 20)] == [21, 30]


def test_large_finite_components_stay(spark):
    rows = [(20, [2.0**-3, 1.0]), (21, [2.0**41, 0.0]), (22, [2.0**44, -3.0]), (23, [1.0, 1.0]), (24, [float("inf"), 1.0])]
    assert found(spark, rows, 20) == brute(rows[:4], 20)


def test_scores_beyond_doubles_are_exact(spark):
    """Sums that a double can't hold: components of 2**27 + 1 and 2**31 after scaling, with signs that cancel."""
    big, huge = (2**27 + 1) / 64, 2.0**31 / 64
    rows = [(20, [big, huge, 1.0]), (21, [big, 0.0, 0.0]), (22, [big, 0.0, 1 / 64]), (23, [big, -huge / 2**4, huge])]
    rows += [(100 + i, [big - i / 64, i / 64, -1.0]) for i in range(40)]
    got = found(spark, rows, 20)
    assert got == brute(rows, 20) and (2**27 + 1) ** 2 in {s for _, _, s in got} | {x[2] for x in brute(rows, 20, 99)}


def test_many_blocks_equal_brute_force(spark, monkeypatch):
    import random

    rnd = random.Random(2)
    for name, value in (("VECTORS", 50), ("QUERIES", 3), ("HELD", 2), ("READ", 5)):
        monkeypatch.setattr(vafile, name, value)
    rows = [(i, [rnd.gauss(0, 1 if i % 3 else 9) for _ in range(5)]) for i in range(300)]
    rows += [(i, [float(i % 4), 1.0]) for i in range(300, 345)]  # another length
    for query in (0, 40, 280):
        assert found(spark, rows, query) == brute(rows[:300], query)
    assert found(spark, rows, 320) == brute(rows[300:], 320)


def test_no_exact_vector_travels_before_candidates_are_known(spark):
    """The blocks of the file hold cells, a byte a component; the tables of bounds hold no vector."""
    names = [f.name for f in vafile.FILE]
    assert "exact" not in names and names[-1] == "cells"


def test_no_table_is_sent_to_the_driver(spark, monkeypatch):
    """Files of whole numbers are small and their rows are not, so no join may go by the size of a file."""
    plans, write = [], vafile.materialise
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(vafile, "materialise", lambda df, label: plans.append(plan(df)) or write(df, label))
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(200)]
    plans.append(plan(top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))))
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)


def test_a_cell_of_one_whole_number_leaves_nothing_open():
    import numpy as np

    queries, low, step = np.array([[3.0, -2.0]]), np.array([-4.0, 10.0]), np.array([1.0, 3.0])
    least, most = vafile.bounds(queries, low, step, np.array([[5, 2]], np.uint8))
    assert np.allclose(least, 3 * 1 - 2 * 18) and np.allclose(most, 3 * 1 - 2 * 16)

"""Source divergence, importance resampling and fingerprints: their parts, and odd rows against SQL or plain Python."""

import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_llm_edges import ROWS
from test_llm_queries import check_fingerprints

from retail_spark.llm import crc, divergence, fingerprints, parsing, resampling, transducer

SCHEMA = "doc_id bigint, text string, lang string, source string, ordinal string, _order string, place string, tie string"
LANGS = [("en", "a"), ("en", "b"), ("en", None), (None, "a"), ("en", ""), ("é", "Z"), ("é", "é"), ("é", "a")]


def odd_rows():
    """The odd texts, three times over under changing languages and sources, with columns whose names clash."""
    out = []
    for k in range(3):
        for i, (doc, text, other) in enumerate(ROWS):
            lang, source = LANGS[(i + 3 * k) % len(LANGS)]
            out.append((doc if doc is None else doc + 100 * k, text, lang, source, other, other, other, other))
    # a language without kept terms
    return [*out, (900, "single", "de", "a", *[None] * 4), (901, None, "de", "b", *["x"] * 4)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


def by_sql(sql, rows, benchmark=()):
    connection = duckdb.connect()
    names = ["doc_id", "text", "lang", "source"]
    frame = pd.DataFrame([r[:4] for r in rows], columns=names, dtype=object)
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    connection.register("rows_in", frame)
    connection.execute(
        "create table documents as select doc_id::bigint as doc_id, text::varchar as text, lang::varchar as lang, "
        "source::varchar as source from rows_in"
    )
    connection.execute("create table benchmark (item_id bigint, text varchar)")
    for i, text in enumerate(benchmark):
        connection.execute("insert into benchmark values (?, ?)", [i, text])
    found = connection.execute(sql)
    names = [c[0] for c in found.description]
    return sorted((dict(zip(names, r, strict=True)) for r in found.fetchall()), key=repr)


def as_dicts(df, like):
    names = list(like[0]) if like else df.columns
    return sorted(({n: r[n] for n in names} for r in df.collect()), key=repr)


# --- parts ------------------------------------------------------------------------------------


def test_transducer_numbers_terms_in_byte_order():
    rnd = random.Random(5)
    terms = sorted({"".join(rnd.choice("abé\U0001f642z") for _ in range(rnd.randrange(1, 7))).encode() for _ in range(3000)})
    machine = transducer.Transducer.loads(transducer.build(terms).dumps())
    assert [machine.ordinal(t) for t in terms] == list(range(len(terms))) and machine.size == len(terms)
    assert machine.ordinal(b"") is None and machine.ordinal(terms[7] + b"\x01") is None
    assert transducer.build([]).ordinal(b"") is None
    with pytest.raises(ValueError):
        transducer.build([b"b", b"a"])


def test_transducer_is_minimal():
    """As many states as there are different sets of endings."""
    terms = sorted(a + b for a in (b"", b"un", b"re") for b in (b"do", b"doing", b"tie", b"tying"))
    prefixes = {t[:i] for t in terms for i in range(len(t) + 1)}
    endings = {frozenset(t[len(p) :] for t in terms if t.startswith(p)) for p in prefixes}
    assert len(transducer.build(terms).arcs) == len(endings)


def test_checksums_of_joined_texts():
    rnd = random.Random(3)
    pairs = [(rnd.randbytes(rnd.randrange(9)), rnd.randbytes(rnd.randrange(65))) for _ in range(500)]
    first, second = (np.array([zlib.crc32(p[i]) for p in pairs], np.uint32) for i in (0, 1))
    got = crc.joined(first, second, np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


@pytest.mark.parametrize("words", [[], [b"the", b"w1", "é".encode()], None])
def test_features_do_not_depend_on_the_dictionary(words):
    texts = ["", "the the", "The,w1 é-x", "y" * 70 + " the " + "z" * 200, None, " ", "a\x00b"]
    plain = []
    for t in texts:
        found = (t or "").encode().translate(resampling._WORDS).split()
        both = [zlib.crc32(w) for w in found], [zlib.crc32(b" ".join(p)) for p in zip(found, found[1:])]
        plain.append((len(found), sorted(x % 997 for part in both for x in part)))
    if words is None:
        words = sorted({w for t in texts for w in (t or "").encode().translate(resampling._WORDS).split()})
    (run,) = resampling._runs(texts)
    got = resampling.Dictionary(words).features(run, 997)
    assert [(n, sorted(f.tolist())) for n, f in got] == plain


def test_small_dictionary_gives_the_same_rows(spark, odd, monkeypatch):
    target = spark.createDataFrame([("word1 word2 é",)], "text string")
    whole = sorted(map(tuple, resampling.importance(odd, target).collect()), key=repr)
    assert 0 < len(resampling.dictionary_words(odd, 1000)) <= 1000 < len(resampling.dictionary_words(odd))
    monkeypatch.setattr(resampling.dictionary_words, "__defaults__", (0,))
    assert sorted(map(tuple, resampling.importance(odd, target).collect()), key=repr) == whole


def names_at(text, level):
    found = list(parsing.levels([text]))
    return found[min(level, len(found)) - 1].names.tolist()


@pytest.mark.parametrize("shift", [1, 2, 7, 50])
def test_equal_stretches_share_their_inner_phrases(shift):
    rnd = random.Random(shift)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    before = "".join(rnd.choice("xyz") for _ in range(shift))
    for level in (1, 2, 3):
        a, b = names_at(text, level), names_at(before + text, level)
        common = 0
        while common < min(len(a), len(b)) and a[-1 - common] == b[-1 - common]:
            common += 1
        assert len(a) - common <= 6  # but for a few names at the edited end


def test_parsing_of_runs_and_alone_as_together():
    texts = ["", "a", "aa", "aaaa", "ab" * 40, "a" * 100_000, "abc", "😀é" * 9, "ab" * 40]
    together = fingerprints.fingerprints(texts)
    assert together == [fingerprints.fingerprints([t])[0] for t in texts]
    assert together[0] == b"" and together[4] == together[8] and len(set(together)) == len(texts) - 1
    for level in parsing.levels([t for t in texts if t]):
        assert np.bincount(level.owners(), level.spans()).tolist() == [len(t) for t in texts if t]


def test_likeness():
    a, b, c = fingerprints.fingerprints(["some words that are the same in both of these texts, but not all", "other things", ""])
    assert fingerprints.likeness(a, a) == fingerprints.likeness(c, c) == 1.0
    assert fingerprints.likeness(a, c) == fingerprints.likeness(c, b) == fingerprints.likeness(a, b) == 0.0


# --- whole operators --------------------------------------------------------------------------


def test_divergence_of_odd_rows(odd):
    expected = by_sql(divergence.AUDIT_SQL, odd_rows())
    assert {r["part"] for r in expected} == {"pair", "term"} and any(r["value"] == 0 for r in expected)
    assert as_dicts(divergence.divergences(odd), expected) == expected


def test_divergence_in_many_slices_and_tiles(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [
        (i, " ".join(f"t{chr(97 + rnd.randrange(26))}{chr(97 + int(rnd.random() ** 3 * 26))}" for _ in range(30)), "en", f"s{i % 7}")
        for i in range(150)
    ]
    expected = by_sql(divergence.AUDIT_SQL, rows)
    for name, value in (("SLICE", 20), ("CHUNK", 50), ("TILE", 3), ("HELD", 100), ("WORDS", 200), ("COMPACT", 50), ("ROWS", 7)):
        monkeypatch.setattr(divergence, name, value)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(4)
    assert as_dicts(divergence.divergences(df), expected) == expected


def test_divergence_of_a_hot_source_and_equal_values(spark):
    rows = [(i, "alpha beta gamma " + ("delta " if i % 3 else "epsilon "), "en", "hot" if i % 3 else f"s{i % 4}") for i in range(300)]
    expected = by_sql(divergence.AUDIT_SQL, rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(8)
    assert as_dicts(divergence.divergences(df), expected) == expected


def test_scaled_is_exact_for_large_counts(spark):
    rows = [(0, 1), (0, 7), (10**12, 3 * 10**13 + 1), (8 * 10**15, 9 * 10**15), (5, 6)]
    df = spark.createDataFrame(rows, "c bigint, d bigint")
    df = df.select("c", "d", divergence.scaled(F.col("c"), F.col("d")).alias("p"))
    for c, d, p in df.collect():
        assert p == 1 + 10**9 * (c + 1) // d
        assert divergence._scaled(np.array([c]), np.array([d])).tolist() == [p]


def test_resampling_of_odd_rows(spark, odd):
    texts = ["word1 word2 word3", None, "", "the word59 and café", "w1 w2"]
    target = spark.createDataFrame([(t, "x") for t in texts], "text string, doc_id string")
    expected = by_sql(resampling.IMPORTANCE_SQL, odd_rows(), texts)
    assert as_dicts(resampling.importance(odd, target), expected) == expected
    drawn = {r["doc_id"] for r in expected if r["rank"]} - {None}
    kept = resampling.resample(odd, target)
    assert drawn and {r.doc_id for r in kept.collect()} == drawn and kept.columns == odd.columns


def test_empty_tables(spark, odd):
    empty, target = odd.limit(0), spark.createDataFrame([], "text string")
    assert divergence.divergences(empty).collect() == []
    assert resampling.importance(empty, target).collect() == []
    assert fingerprints.fingerprint_report(empty).collect() == []
    assert len(resampling.importance(odd, target).collect()) == odd.count()


def test_fingerprints_of_odd_rows(odd):
    """Rows of one id may follow each other either way: the expected order is found by their fingerprints' hash."""
    rows = [r[:2] for r in odd_rows()]
    single = {d: t for d, t in rows if d is not None and d % 100 != 8}
    ordered = sorted(single.items(), reverse=True)
    check_fingerprints(fingerprints.fingerprint_report(odd.filter("doc_id is not null and doc_id % 100 <> 8")).collect(), ordered)
    found = fingerprints.fingerprint_report(odd).collect()
    assert sorted(((r.doc_id, r.n_chars) for r in found), key=repr) == sorted(((d, len(t or "")) for d, t in rows), key=repr)
    twice = [r for r in found if r.doc_id == 208]
    assert len(twice) == 2 and max(r.near_next for r in twice) == 1.0


def test_fingerprints_across_partitions(spark):
    rows = [(i, f"text {i} " * (i % 11)) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    check_fingerprints(fingerprints.fingerprint_report(df).collect(), rows[::-1])
    (one,) = fingerprints.fingerprint_report(df.filter("doc_id = 3")).collect()
    assert one.near_next == 1.0


def test_fingerprint_columns(spark):
    df = spark.createDataFrame([("one text here", "x"), (None, "y")], "text string, print string")
    made = fingerprints.with_fingerprints(df)
    rows = made.select("print", fingerprints.near("fingerprint", "fingerprint").alias("n")).collect()
    assert [tuple(r) for r in rows] == [("x", 1.0), ("y", 1.0)]

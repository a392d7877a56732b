"""The registered queries over the small data set, against SQL twins or plain Python."""

import hashlib
import math
import os
import zlib
from collections import defaultdict

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from __spark_entry__ import oracle_sql, queries
from retail_spark.llm import fingerprints
from retail_spark.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def result(spark):
    kept = {}

    def run(key):
        if key not in kept:
            kept[key] = QUERIES[key](spark, FOLDER).collect()
        return kept[key]

    return run


def picked(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


def test_all_are_registered():
    names = sorted(k for k in queries() if k.startswith("op") or k == "pipeline")
    assert sorted(n.split("_")[0] for n in names) == sorted([*(f"op{n}" for n in range(1, 14)), "pipeline"])
    assert set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_same_rows_as_sql(spark, result, key):
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.execute(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    found = connection.execute(ORACLE[key])
    names = sorted(c[0] for c in found.description)
    order = [[c[0] for c in found.description].index(n) for n in names]
    theirs = sorted((tuple(row[i] for i in order) for row in found.fetchall()), key=repr)
    assert picked(result(key), *names) == theirs
    assert sorted(QUERIES[key](spark, FOLDER).columns) == names


def test_near_duplicates(result, documents):
    assert {r.doc_id: r.class_id for r in result("op1_near_duplicates")} == brute.near_classes(documents)


def test_license_base(result, documents):
    found = picked(result("op2_license_scan"), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert found == sorted(((d, *brute.license_base(t)) for d, t in documents), key=repr)
    for r in result("op2_license_scan"):
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


def test_secret_base(spark):
    folder = "/root/testdata/sf0.01"  # the smallest table that holds secrets of every kind
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = QUERIES["op3_secret_scan"](spark, folder).collect()
    assert sum(r.n_assign for r in rows) and sum(r.n_hex for r in rows)
    found = picked(rows, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert found == sorted(((d, *brute.secret_base(t)) for d, t in documents), key=repr)
    for r in rows:
        base = [s for s in r.spans.split(",") if s and not s.startswith("entropy")]
        assert brute.sha(",".join(base)) == r.base_sha256


def test_bpe_equals_the_library(result, documents):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for d, t in documents:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        listed = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        expected.append((d, len(ids), listed, brute.sha(tok.decode(ids, skip_special_tokens=False))))
    found = picked(result("op5_bpe_round_trip"), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert found == sorted(expected, key=repr)


def test_lm_base_and_gain(result, documents):
    expected = {e[0]: e for e in brute.lm_base(documents)}
    base = model = 0.0
    for r in result("op6_lm_scores"):
        e = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == e[1:5]
        assert math.isclose(r.base_score, e[5], rel_tol=1e-9)
        if r.held_out:
            base, model = base + r.base_score, model + r.score
    assert model > base  # held-out texts are likelier under the model


def test_quality_base(result, documents):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    found = picked(result("op8_quality_rules"), "doc_id", *names)
    assert found == sorted(((d, *brute.quality_base(t)) for d, t in documents), key=repr)
    kept = {r.doc_id: r.kept for r in result("op8_quality_rules")}
    assert kept == {d: brute.cleaned(t) is not None for d, t in documents}


def test_shared_passages_cover_all_common_windows(result, documents):
    covered = defaultdict(set)
    for r in result("op9_shared_passages"):
        assert r.doc_id > r.source_doc_id and r.end - r.start >= 50 and r.equal >= 0.8
        covered[r.doc_id].update(range(r.start, r.end))
    for d, places in brute.shared_windows(documents).items():
        assert all({i, i + 49} <= covered[d] for i in places)


def check_fingerprints(rows, ordered):
    """``ordered``: (doc_id, text), each followed by the next, the last by the first."""
    texts = [t or "" for _, t in ordered]
    after = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 3] + a[: len(t) // 3] for t, a in zip(texts, after, strict=True)]
    prints, edits, nexts = map(fingerprints.fingerprints, (texts, edited, after))
    expected = [
        (d, len(t), brute.sha(e), p.hex(), q.hex(), fingerprints.likeness(p, q), fingerprints.likeness(p, n))
        for (d, _), t, e, p, q, n in zip(ordered, texts, edited, prints, edits, nexts, strict=True)
    ]
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert picked(rows, *names) == sorted(expected, key=repr)


def test_fingerprints(result, documents):
    rows = result("op13_fingerprints")
    check_fingerprints(rows, sorted(documents, reverse=True))
    long = [r for r in rows if r.n_chars >= 300]
    assert np.mean([r.near_edited for r in long]) > 0.4 and np.mean([r.near_next for r in long]) < 0.05


def check_packing(rows, documents):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert set(pieces) == {d for d, _ in documents}
    for d, t in documents:
        ids, at = tok.encode(t or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part))
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for members in windows.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 2048 - at if at & (at - 1) else 0
        total += at
    return padding / (padding + total)


def test_packing(result, documents):
    assert check_packing(result("op10_packing"), documents) < 0.05

"""The pipeline's stages, each against plain Python over what the stage before kept."""

import re

import brute
import pytest
from test_llm_queries import check_packing

import corpus_pipeline
from retail_spark.llm import secrets

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, input rows, output rows) of every stage."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs.collect(), after.collect(), after.columns))
        docs = after
    return {x[0]: x[1:] for x in out}


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_order_and_columns(stages):
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "secret_scan", "packing"]
    for name in list(stages)[:-1]:
        assert stages[name][2] == COLUMNS
        assert all(r.n_chars == len(r.text) for r in stages[name][1])


def test_quality(stages):
    before, after, _ = stages["quality_rules"]
    assert texts(after) == {d: t for d, t in ((d, brute.cleaned(t)) for d, t in texts(before).items()) if t is not None}


def test_lines(stages):
    before, after, _ = stages["line_dedup"]
    expected = {d: digest for d, _, _, digest in brute.line_dedup(list(texts(before).items()))}
    assert {d: brute.sha(t) for d, t in texts(after).items()} == expected


def test_near(stages):
    before, after, _ = stages["near_dedup"]
    assert set(texts(after)) == set(brute.near_classes(list(texts(before).items())).values())


def test_secrets(spark):
    folder = "/root/testdata/sf0.01"  # the smallest table that holds secrets
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = dict(corpus_pipeline.STAGES)["secret_scan"](spark, docs, folder).collect()
    found = secrets.secrets(docs).collect()
    hits = 0
    for r in found:
        gone = sorted({i for s in r["_secrets"] for i in range(s["start"], s["end"])})
        marked = "".join("\0" if i in set(gone) else c for i, c in enumerate(r.text)) if gone else r.text
        hits += bool(gone)
        assert re.sub("\0+", "[secret]", marked) == texts(after)[r.doc_id]
    assert hits and len(found) == len(after)


def test_packing(stages):
    before, after, _ = stages["packing"]
    assert check_packing(after, list(texts(before).items())) < 0.05


def test_run_gives_the_last_stage(spark, stages):
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(
        tuple(r[n] for n in names) for r in stages["packing"][1]
    )

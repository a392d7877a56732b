"""Keys that hold a run of one character."""

import random

import brute

from retail_spark.llm import secrets


def test_a_run_clears_only_the_windows_it_touches(spark):
    key = "b3BlbnNzaC1rZXktdjEAAAAABG5vbmUAAAAEbm9uZQAAAAAAAAABAAABlwAAAAdzc2gtcn"
    tail = "AbC9xQ2zLm7RtY4uVw8Kp1Ne"
    texts = ["00000000" + tail, tail + "aaaaaaaa" + tail, "0000000012ab34cd56ef7", key, "x_" + "0" * 40 + "1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("entropy")] for r in secrets.secret_report(df).collect()}
    assert found[0] == ["entropy_base64:8:32"]
    assert found[1] == ["entropy_base64:0:24", "entropy_base64:32:56"]  # no span holds the run
    assert found[2] == found[4] == [] and found[3]
    for doc, spans in found.items():
        assert spans == [f"{kind}:{a}:{b}" for kind, a, b in brute.entropy_spans(texts[doc])]


def test_stretches_equal_window_by_window(spark):
    """The test table, and strings of every make: keys around runs, counting strings, both classes, all lengths."""
    rnd = random.Random(7)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="
    parts = ["a" * 9, "0" * 8, "0123456789", "abcdefghij", "xxxxxx", "deadbeef"]
    texts = []
    for n in range(120):
        pick = "0123456789abcdef" if n % 3 == 0 else letters[: rnd.choice([5, 12, 30, 67])]
        pieces = [rnd.choice(parts) if rnd.random() < 0.3 else "".join(rnd.choices(pick, k=rnd.randrange(5, 45))) for _ in range(rnd.randrange(1, 6))]
        texts.append("é key " + "".join(pieces) + " end " + rnd.choice(pieces))
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    hits = 0
    for r in secrets.secret_report(df).collect():
        expected = [f"{kind}:{a}:{b}" for kind, a, b in brute.entropy_spans(texts[r.doc_id])]
        found = [s for s in r.spans.split(",") if s.startswith("entropy")]
        assert sorted(found) == sorted(expected), texts[r.doc_id][:300]
        hits += len(found)
    assert hits > 60

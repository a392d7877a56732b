"""Near-duplicates: idf over the whole range of document counts, against plain Python."""

import math
import random

import brute
import numpy as np
import pytest

from retail_spark.llm import neardup


def classes(rows):
    """rows: (doc_id, text), ids distinct, none without a word -> {doc_id: smallest id of its group}, with an idf of its own."""
    counts = {d: brute.words5(t) for d, t in rows}
    distinct = {tuple(brute.ascii_lower(t).split()): counts[d] for d, t in rows}
    df = {}
    for c in distinct.values():
        for x in c:
            df[x] = df.get(x, 0) + 1
    weights = {
        d: {x: (1 + math.log(k)) * (1 + math.log((len(distinct) + 1) / (df[x] + 1))) for x, k in c.items()} for d, c in counts.items()
    }
    group = {d: d for d in counts}
    for a in sorted(counts):
        for b in sorted(counts):
            x, y = weights[a], weights[b]
            least = sum(min(w, y[k]) for k, w in x.items() if k in y)
            if b < a and least >= 0.8 * (sum(x.values()) + sum(y.values()) - least):
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    return group


def random_rows():
    """A notice in a fifth of 100 texts, copies, and pairs of texts with a word or two changed."""
    draw = random.Random(5)
    words = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    notice = words(100)
    texts = [notice + words(8) for _ in range(20)] + [words(60) for _ in range(50)]
    for text in texts[20:35]:
        changed = list(text)
        changed[draw.randrange(60)] = "x"
        texts.append(changed)
    texts += texts[20:25] + texts[:10]
    return [(i + 1, " ".join(t)) for i, t in enumerate(texts)]


def test_a_notice_in_a_fifth_of_all_texts_weighs_less_than_a_text_of_its_own(spark):
    rows = random_rows()
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len({found[d] for d in range(1, 21)}) == 20  # with an idf of 1 they are one group
    assert found == classes(rows)


def test_document_counts_do_not_depend_on_blocks_or_ranges(spark, monkeypatch):
    docs = spark.createDataFrame(random_rows(), "doc_id bigint, text string").repartition(3).cache()
    whole = sorted(neardup.near_duplicates(docs).collect())
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 3)
    monkeypatch.setattr(neardup, "RANGE_SHINGLES", 20)
    assert sorted(neardup.near_duplicates(docs).collect()) == whole


@pytest.mark.parametrize("texts", [1, 2, 100, 10**9])
def test_idf_falls_with_every_document(texts):
    df = np.unique(np.linspace(1, texts, 50).astype(int))
    idf = neardup.idf_of(texts, df)
    assert idf[0] == 1 and (idf > 0).all() and (np.diff(idf) < 0).all()


def test_a_large_group_of_near_copies_stays_one(spark):
    """Forty copies of a text, one word changed in each, among 600 others: what they share weighs as if one text had it."""
    draw = random.Random(9)
    words = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    base = words(60)
    copies = [[*base[:i], "x", *base[i + 1 :]] for i in range(8, 48)]
    rows = [(i + 1, " ".join(t)) for i, t in enumerate([base, *copies, *(words(20) for _ in range(600))])]
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(found[d] == (1 if d <= 41 else d) for d, _ in rows)

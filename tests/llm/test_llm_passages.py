"""Shared passages that are patched together, edited or shifted."""

import random

import numpy as np

from retail_spark.llm import passages
from retail_spark.llm.hashing import Words, shingles
from retail_spark.llm.passages import SEED, align


def noise(rng, n):
    return [rng.getrandbits(63) for _ in range(n)]


def arrays(*words):
    return [np.array(w, np.uint64) for w in words]


def test_one_inserted_word_does_not_end_a_passage():
    rng = random.Random(1)
    for place in (12, 14, 16, 30):
        passage = noise(rng, 60)
        a, b = arrays(noise(rng, 30) + passage + noise(rng, 30), noise(rng, 9) + passage[:place] + noise(rng, 1) + passage[place:] + noise(rng, 40))
        x = place + 2  # one seed, behind the inserted word
        assert align(a, b, [(30 + x, 10 + x)]) == [(30, 90, 9, 70, 60)]


def test_long_stretches_are_compared_word_by_word():
    rng = random.Random(2)
    same = noise(rng, 400)
    edited = [w if i % 7 else rng.getrandbits(63) for i, w in enumerate(same)]
    del edited[200]
    a, b = arrays(same[1:9] + same + same[11:19], same[1:9] + edited + same[11:19])
    assert len(a) == len(b) + 1 and SEED <= 8
    equal = sum(x == y for x, y in zip(same[:200], edited[:200])) + sum(x == y for x, y in zip(same[201:], edited[200:]))  # noqa: B905
    assert align(a, b, [(0, 0), (408, 407)]) == [(0, 416, 0, 415, equal + 16)]


def seeds(words):
    texts = Words(0, np.array(words, np.uint64), np.array([0, len(words)]), np.zeros(0))
    hashes, bounds = shingles(texts, SEED, short=False)
    return {int(hashes[i]): int(i) for i in passages.minimizers(hashes.copy(), bounds)}


def is_found(a, b):
    x, y = seeds(a), seeds(b)
    points = np.array([(x[s], y[s]) for s in x if s in y], np.int32).reshape(-1, 2)
    if not len(points):
        return False
    points = [tuple(p) for p in passages.ends_of_runs(points).tolist()]
    a, b = arrays(a, b)
    found = [align(a, b, [points[i] for i in c]) for c in passages.chains(*map(list, zip(*points)))]  # noqa: B905
    return any(passages.filled(a, b, p, 50, 0.8) for ps in found for p in ps)


def test_recall_of_edited_passages():
    """Every planted pair is a passage by brute force: so many words, so many of them equal."""
    for n, share, least in ((50, 0.88, 0.9), (50, 0.92, 0.97), (60, 0.84, 0.9), (80, 0.8, 0.95), (100, 0.8, 0.95)):
        rng, found = random.Random(n), 0
        for _ in range(100):
            passage = noise(rng, n)
            edited = list(passage)
            for i in rng.sample(range(n), int(n * (1 - share) + 1e-9)):
                edited[i] = rng.getrandbits(63)
            found += is_found(noise(rng, 40) + passage + noise(rng, 40), noise(rng, 30) + edited + noise(rng, 50))
        assert found >= 100 * least, (n, share, found)


def test_a_passage_has_a_source_though_its_pieces_stand_in_earlier_documents(spark):
    rng, rows = random.Random(5), []
    word = lambda n: " ".join(f"w{rng.getrandbits(40):x}" for _ in range(n))
    for trial in range(24):
        n, passage = 2 + trial % 3, word(60).split()
        step = 60 // n
        pieces = [" ".join(passage[max(0, i * step - 5) : (i + 1) * step + 5]) for i in range(n)]  # each run of ten words is in one
        own = [f"{word(20)} {p} {word(20)}" for p in pieces]
        own += [f"{word(30)} {' '.join(passage)} {word(30)}" for _ in range(2)]
        rows += [(100 * trial + i, t) for i, t in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {(r.doc_id, r.source_doc_id, r.start, r.end) for r in passages.shared_passages(docs).collect()}
    for trial in range(24):
        n = 2 + trial % 3
        assert (100 * trial + n + 1, 100 * trial + n, 30, 90) in found, trial


def test_links_do_not_depend_on_batches_or_partitions():
    """At every level every document but the smallest is led to a smaller one, wherever the rows are cut."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n = 3000
    key = (rng.integers(0, 12, n) << 24) | rng.integers(1, 4, n)
    ctx = ((rng.integers(1, 3, n) << 16) | rng.integers(1, 3, n)).astype(np.int32)
    rows = passages._in_order((key, ctx, rng.integers(0, 400, n), rng.integers(0, 1000, n).astype(np.int32)))
    for parts, size in ((1, 5000), (1, 7), (9, 100), (40, 13)):
        out, ends = [], []
        for places in np.array_split(np.arange(n), parts):
            cut = [pa.RecordBatch.from_arrays([pa.array(c[places[i : i + size]]) for c in rows], names=list("kcda")) for i in range(0, len(places), size)]
            for batch in passages._firsts(iter(cut)):
                for r in batch.to_pylist():
                    (ends if r["fate"] == passages.END else out).append(r)
        ends = passages._in_order(tuple(np.array([r[c] for r in ends], t) for c, t in (("key", "i8"), ("ctx", "i4"), ("doc", "i8"), ("at", "i4"))))
        one, two, _ = passages.links(ends)
        pairs = {(r["doc"], r["at"], r["first_doc"], r["first_at"]) for r in out}
        pairs |= {(int(a), int(c), int(b), int(d)) for a, b, c, d in zip(*passages._matched(ends, one, two))}  # noqa: B905
        to = {}
        for a, x, b, y in pairs:
            assert b < a
            to.setdefault((a, x), set()).add((b, y))
        groups = {}
        for k, c, d, a in zip(*(x.tolist() for x in rows)):  # noqa: B905
            groups.setdefault((k, c), []).append((d, a))
        for members in groups.values():
            least = min(d for d, _ in members)
            for m in members:
                assert m[0] == least or any(o in members for o in to.get(m, ())), (parts, size, m)


def test_the_probe_never_counts_too_few_words():
    """Stretches with changed, inserted and deleted words, few different words or many: no less than the alignment itself finds."""
    rng, beyond = random.Random(11), passages.words_beyond(50, 0.8)
    side = beyond + passages.edits_to(beyond) + 1
    wide = side + passages.edits_to(beyond)
    assert beyond == 15
    cases = []
    for trial in range(600):
        kinds = rng.choice([3, 12, 1 << 16])
        a = [rng.randrange(kinds) for _ in range(rng.randrange(90))]
        b = []
        for w in a:
            change = rng.random() / rng.choice([0.15, 0.3, 0.6])
            b += [] if change < 0.3 else [rng.randrange(kinds)] if change < 0.6 else [rng.randrange(kinds), w] if change < 0.8 else [w]
        cases.append((a, b + [rng.randrange(kinds) for _ in range(40)]))
    rows_a, rows_b = np.full((len(cases), side), -1, np.int32), np.full((len(cases), wide), -2, np.int32)
    for i, (a, b) in enumerate(cases):
        rows_a[i, : min(side, len(a))] = a[:side]
        rows_b[i, : min(wide, len(b))] = b[:wide]
    bound = passages.most_equal(rows_a, rows_b, beyond)
    found = [passages.extend(*arrays(a, b), passages.OTHER, passages.DROP)[2] for a, b in cases]
    assert all(x >= min(y, beyond) for x, y in zip(bound, found, strict=True))
    assert sum(x < beyond for x in bound) > 50 and sum(y >= beyond for y in found) > 50


def test_recall_through_the_operator(spark):
    """Edited passages among texts with common phrases: pairs of documents, each pair's passage edited its own way."""
    rng = random.Random(21)
    word = lambda: f"w{rng.getrandbits(30):x}"
    phrases = [" ".join(word() for _ in range(rng.randrange(5, 9))) for _ in range(12)]
    filler = lambda n: " ".join(rng.choice(phrases) if rng.random() < 0.15 else word() for _ in range(n))
    rows, planted = [], {}
    for n, share in ((50, 0.84), (50, 0.9), (60, 0.84), (80, 0.8), (100, 0.8)):
        for _ in range(40):
            passage = [word() for _ in range(n)]
            edited = list(passage)
            for i in rng.sample(range(n), int(n * (1 - share) + 1e-9)):
                edited[i] = word()
            first = len(rows)
            rows.append((first, f"{filler(30)} {' '.join(passage)} {filler(40)}"))
            rows.append((first + 1, f"{filler(45)} {' '.join(edited)} {filler(20)}"))
            planted[first + 1] = (first, n, share)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = {(r.doc_id, r.source_doc_id) for r in passages.shared_passages(docs).collect()}
    for case in sorted({x[1:] for x in planted.values()}):
        mine = [d for d, x in planted.items() if x[1:] == case]
        assert sum((d, planted[d][0]) in found for d in mine) >= 0.97 * len(mine), case
    assert all(d in planted and planted[d][0] == s for d, s in found)  # a common phrase makes no passage


def test_runs_of_fifty_words_and_a_few_more(spark):
    """Exact runs of 50 to 53 words, in three documents each."""
    rng, rows = random.Random(8), []
    word = lambda n: " ".join(f"w{rng.getrandbits(40):x}" for _ in range(n))
    for n in (50, 51, 52, 53) * 15:
        run = word(n)
        rows += [(len(rows) + i, f"{word(12 + i)} {run} {word(9)}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id for r in passages.shared_passages(docs).collect()}
    assert len(found) == 2 * 60


def test_an_edited_passage_has_a_source_though_all_its_seeds_stand_in_earlier_documents(spark):
    """Ten words, one changed, ten words: no sixteen in a row are equal, and the ten stand in smaller documents among other words."""
    rng, rows = random.Random(31), []
    word = lambda n: [f"w{rng.getrandbits(40):x}" for _ in range(n)]
    passages_of = []
    for trial in range(3):
        pieces = [word(10) for _ in range(6)]
        rows += [(1000 * trial + i, " ".join(word(30) + pieces[i % 6] + word(30))) for i in range(240)]
        for i in (250, 251):
            text = word(i - 180) + [w for p in pieces for w in [*p, *word(1)]] + word(15)
            rows.append((1000 * trial + i, " ".join(text)))
        passages_of.append((1000 * trial + 251, 1000 * trial + 250))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {(r.doc_id, r.source_doc_id): (r.start, r.end, r.source_start, r.source_end) for r in passages.shared_passages(docs).collect()}
    assert found == {p: (71, 136, 70, 135) for p in passages_of}


def test_pairs_of_a_seed_do_not_depend_on_batches_or_blocks(monkeypatch):
    """Rows of equal and other surroundings: those pairs alone that may have a passage, an open text's, however the rows are cut."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    wide = 50 + 2 * passages.DROP
    kinds = rng.integers(0, 1 << 16, (6, 2 * wide)).astype(np.uint16)
    rows, wanted = [], set()
    for seed in range(5):
        for doc in range(12):
            kind, is_open = int(rng.integers(0, 6)), bool(rng.integers(0, 2))
            around = np.array([wide, 7, 9], np.int32).tobytes() + kinds[kind].tobytes()
            wanted |= {(doc, d) for s, _, d, o, k in rows if s == seed and is_open and k == kind}
            rows.append((seed, around, doc, is_open, kind))
    for blocks, size, together in ((1, 1000, 1000), (3, 7, 20), (2, 1, 1)):
        monkeypatch.setattr(passages, "TOGETHER", together)
        out = [
            (s, min(d % blocks, o), max(d % blocks, o), d % blocks, d, is_open, around)
            for s, around, d, is_open, _ in rows for o in range(blocks)
        ]
        out.sort(key=lambda r: r[:3])
        names = ["seed", "low", "high", "block", "doc", "open", "around"]
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out[i : i + size])], names=names) for i in range(0, len(out), size)]  # noqa: B905
        found = {(r["doc"], r["first_doc"]) for b in passages._meetings(50, 0.8)(iter(batches)) for r in b.to_pylist()}
        assert found == wanted


def test_quick_bounds_are_never_too_low():
    """The words that two rows have in common, in any order and in the same one, against counting them one by one."""
    from collections import Counter

    rng = np.random.default_rng(6)
    for kinds in (3, 20, 1 << 16):
        a, b = rng.integers(0, kinds, (300, 31)), rng.integers(0, kinds, (300, 46))
        b[:, 8:30:3] = a[:, 3:25:3]
        a[::3, 20:], b[::4, 30:] = -1, -2
        n = np.arange(len(a))
        marked, ordered = passages._common(passages._marks(a), passages._marks(b), n, n), passages.in_order(a, b)
        for i in n.tolist():
            x, y = a[i][a[i] >= 0].tolist(), b[i][b[i] >= 0].tolist()
            longest = [0] * (len(y) + 1)
            for w in x:
                before = 0
                for j, v in enumerate(y, 1):
                    before, longest[j] = longest[j], before + 1 if v == w else max(longest[j], longest[j - 1])
            assert ordered[i] == longest[-1] and marked[i] >= sum((Counter(x) & Counter(y)).values())

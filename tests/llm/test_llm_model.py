"""The language model: seatings against enumeration, and held-out perplexity against a plain interpolated bigram model."""

import math
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

from retail_spark.llm import hpylm
from retail_spark.llm.hashing import mixed
from retail_spark.session import materialise

FOLDER = "/root/testdata/sf0.01"


def seatings(customers, others, probability, concentration, discount):
    """Chances of each number of tables, by seating customer after customer in every way."""
    weights = Counter({(1,): (concentration + discount * others) * probability})
    for _ in range(customers - 1):
        more = Counter()
        for tables, weight in weights.items():
            for i, n in enumerate(tables):
                more[tuple(sorted([*tables[:i], n + 1, *tables[i + 1 :]]))] += weight * (n - discount)
            more[tuple(sorted([*tables, 1]))] += weight * (concentration + discount * (others + len(tables))) * probability
        weights = more
    total = sum(weights.values())
    chances = Counter()
    for tables, weight in weights.items():
        chances[len(tables)] += weight / total
    return chances


@pytest.mark.parametrize("customers,others,probability", [(2, 0, 0.3), (3, 5, 0.01), (5, 2, 0.4), (7, 40, 0.2)])
def test_tables_are_drawn_as_enumeration_says(customers, others, probability):
    n = 40_000
    keys = mixed(np.arange(n, dtype=np.uint64))
    full = lambda x: np.full(n, float(x))
    drawn = hpylm.draw_tables(full(customers), full(others), full(probability), full(0.7), 0.6, keys, 3)
    for tables, chance in seatings(customers, others, probability, 0.7, 0.6).items():
        assert abs((drawn == tables).mean() - chance) < 0.012, (tables, chance)


def test_many_customers_are_seated_about_as_one_by_one():
    rng = np.random.default_rng(4)
    for customers, others, probability in ((60, 30, 0.05), (400, 100, 0.2)):
        tables = np.ones(4000)
        for seated in range(1, customers):
            new = (0.7 + 0.6 * (others + tables)) * probability
            tables += rng.random(4000) < new / (new + seated - 0.6 * tables)
        n = 4000
        keys = mixed(np.arange(n, dtype=np.uint64) + np.uint64(99))
        full = lambda x: np.full(n, float(x))
        drawn = hpylm.draw_tables(full(customers), full(others), full(probability), full(0.7), 0.6, keys, 8)
        assert abs(drawn.mean() / tables.mean() - 1) < 0.08


def bigram_perplexity(rows):
    """Held-out perplexity of interpolated Kneser-Ney with one discount of 0.75; unknown words share one place."""
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    texts = [(d, [*brute.ascii_lower(t or "").split(), None]) for d, t in rows]
    after, known = defaultdict(Counter), set()
    for d, words in texts:
        if not held(d):
            for u, w in zip([0, *words], words):  # noqa: B905
                after[u][w] += 1
                known.add(w)
    contexts = Counter(w for counts in after.values() for w in counts)
    kinds, total, logs = sum(contexts.values()), {u: sum(c.values()) for u, c in after.items()}, []
    for d, words in texts:
        if held(d):
            for u, w in zip([0, *words], words):  # noqa: B905
                p = (max(contexts[w] - 0.75, 0) + 0.75 * len(contexts) / (len(known) + 1)) / kinds
                if u in after:
                    p = (max(after[u][w] - 0.75, 0) + 0.75 * len(after[u]) * p) / total[u]
                logs.append(math.log(p))
    return math.exp(-sum(logs) / len(logs))


def test_held_out_texts_are_as_likely_as_under_a_plain_bigram_model(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = hpylm.score_texts(docs).collect()
    held = [r for r in rows if r.held_out]
    n = sum(r.n_tokens for r in held)
    model, base = (10 ** (-sum(r[c] for r in held) / n) for c in ("score", "base_score"))
    assert model <= bigram_perplexity([(r.doc_id, r.text) for r in docs.collect()]) and model < base / 3
    for r in rows:
        assert math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9)


def test_scores_do_not_depend_on_blocks_or_ranges(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = {r.doc_id: r.score for r in hpylm.score_texts(docs.repartition(1)).collect()}
    monkeypatch.setattr(hpylm, "BLOCK_TOKENS", 3000)
    monkeypatch.setattr(hpylm, "RANGE_TOKENS", 2000)
    cut = {r.doc_id: r.score for r in hpylm.score_texts(docs.repartition(5)).collect()}
    assert whole.keys() == cut.keys() and all(math.isclose(whole[d], cut[d], rel_tol=1e-9) for d in whole)


def test_texts_seen_in_training_are_likelier(spark):
    rows = [(i, " ".join(f"w{(i * 37 + k * k) % 400}" for k in range(60))) for i in range(80)]
    copied, fresh = next(i for i in range(500, 600) if hpylm.held_out(i)), next(i for i in range(600, 700) if hpylm.held_out(i))
    trained = next(t for i, t in rows if not hpylm.held_out(i))
    shuffled = " ".join(sorted(trained.split(), key=lambda w: zlib.crc32(w.encode())))
    df = spark.createDataFrame([*rows, (copied, trained), (fresh, shuffled)], "doc_id bigint, text string")
    scores = {r.doc_id: r.score for r in hpylm.score_texts(df).collect()}
    assert scores[copied] > scores[fresh] + 20  # the same words in another order


def test_numbers_pack_and_rise():
    x = np.sort(mixed(np.arange(1000, dtype=np.uint64)))
    assert (hpylm.risen(hpylm.rising(x)) == x).all() and len(hpylm.risen(hpylm.rising(x[:0]))) == 0
    cuts = hpylm._cuts(x, 7)
    assert cuts[0] == 0 and cuts[-1] == len(x) and all((int(k) * 7) >> 64 == r for r in range(7) for k in x[cuts[r] : cuts[r + 1]])


def test_the_first_sweeps_are_not_averaged():
    assert hpylm.BURN_IN > 0 and hpylm.SWEEPS - hpylm.BURN_IN >= 4


def test_only_rounds_still_needed_are_kept(spark, monkeypatch):
    kept = []

    def watched(df, label):
        kept.append((label, materialise(df, label)))
        return kept[-1][1]

    monkeypatch.setattr(hpylm, "materialise", watched)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scores = hpylm.score_texts(docs, sweeps=5, burn_in=3)

    def left(label):
        found = []
        for number, df in enumerate(df for name, df in kept if name == label):
            try:
                df.count()
                found.append(number)
            except Exception:
                pass
        return found

    assert left("lm_asks") == [] and left("lm_words") == [0, 5, 6] and left("lm_seats") == [3, 4]  # of rounds 4 and 5
    assert all(r.score < 0 for r in scores.collect())


def test_rounds_go_on_from_what_was_worked_out_once(monkeypatch):
    """A round needs no tokens of a block, only its pairs with all customers, whatever the blocks and ranges."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 23}" for k in range(30))) for i in range(60)]
    monkeypatch.setattr(hpylm, "BLOCK_TOKENS", 400)
    texts = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    blocks = pa.Table.from_batches(hpylm._blocks(texts.slice(s, 5) for s in range(0, 60, 5)))
    asks = pa.Table.from_batches(hpylm._pair_asks(3)(iter(blocks.to_batches())))
    answers = pa.concat_tables([hpylm._count_pairs(asks.filter(pc.equal(asks["range"], r))) for r in range(3)])
    numbers = blocks["block"].to_pylist()
    assert len(numbers) > 2
    states = [hpylm._states(blocks.slice(i, 1), answers.filter(pc.equal(answers["block"], b))) for i, b in enumerate(numbers)]
    expected = Counter()
    for i, text in rows:
        if not hpylm.held_out(i):
            hashes = [hpylm.START, *next(hpylm.words_of([text])).hashes.tolist(), hpylm.END]
            expected.update(zip(hashes, hashes[1:]))  # noqa: B905
    owned = Counter()
    for state in states:
        s = hpylm.state_of(state.to_pylist()[0])
        pairs = list(zip(s.words[s.before].tolist(), s.words[s.after].tolist()))  # noqa: B905
        assert s.customers.tolist() == [expected[p] for p in pairs]
        owned.update(pairs)
    assert set(owned.values()) == {1} and set(expected) == set(owned)  # each pair is drawn by one block

    def no_tokens(*_):
        raise AssertionError("a round opened the tokens of a block")

    monkeypatch.setattr(hpylm, "opened", no_tokens)
    asked = pa.concat_tables([hpylm._word_asks(3, [], 1)(s, answers.slice(0, 0)) for s in states]).to_pylist()
    tables = sum(int(hpylm.unpacked(r["numbers"], np.uint64).sum()) for r in asked)
    assert tables == len(expected)  # one for each pair to begin with

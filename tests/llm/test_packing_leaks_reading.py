import pickle
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import leaks as lk
from graphloom.llm import packing as pk
from graphloom.llm import reading as rd


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_packing_uses_every_item_once(histogram):
    patterns = pk.pack_histogram(histogram, 64)
    used = {}
    for n, pattern in patterns:
        assert n > 0 and sum(pattern) <= 64
        for x in pattern:
            used[x] = used.get(x, 0) + n
    assert used == histogram
    slots = pk.slots_of(patterns)
    for length in histogram:
        own = sorted((r, c) for x, r, c in zip(slots["length"], slots["rank"], slots["count"]) if x == length)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))


def test_pack_documents(spark):
    rng = random.Random(0)
    texts = [(i, " ".join(["box"] * rng.randint(1, 90)), "clash") for i in range(400)] + [(900, "box " * 500, "x"), (901, "", "x"), (902, None, "x"), (5, "same id", "x")]
    rows = pk.pack(spark.createDataFrame(texts, "doc_id bigint, text string, tokens string"), "doc_id", "text", capacity=100).collect()
    assert {r.id for r in rows if r.container_id is None} == {901, 902}
    by = {}
    for r in rows:
        if r.container_id is not None:
            by.setdefault(r.container_id, []).append((r.start, r.tokens))
    for items in by.values():
        at = 0
        for start, n in sorted(items):
            assert start == at
            at += n
        assert at <= 100
    assert set(by) == set(range(len(by)))
    total = sum(r.tokens for r in rows)
    assert len(by) <= 1.03 * total / 100 + 1
    assert all(r.pieces == 1 for r in rows if r.id < 900) and sum(r.tokens for r in rows if r.id == 900) > 400
    assert pk.pack(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0


def brute_leaks(docs, items, k):
    out = {}
    for d, t in docs:
        w = lk.words_of(t)
        for i, u in items:
            v = lk.words_of(u)
            best = 0
            for a in range(len(w)):
                for b in range(len(v)):
                    n = 0
                    while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                        n += 1
                    best = max(best, n)
            if best >= k and d is not None and i is not None:
                out[d, i] = max(best, out.get((d, i), 0))
    return out


@pytest.mark.parametrize("shard_words", [30, 10_000])
def test_leaks_against_brute_force(spark, shard_words):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(4)]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(12)) for i in range(6)] + [(7, None), (8, "short"), (None, text(12)), (0, "w1 w2 w3 w1 w1")]
    docs = [(d, text(rng.randint(0, 40))) for d in range(40)] + [(50, None), (51, ""), (None, items[0][1]), (52, "X " + items[0][1].upper() + "! y"), (53, items[1][1]), (53, items[1][1])]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.words for r in lk.leaks(d, "doc_id", "text", i, "item_id", "text", 5, shard_words, block_words=30).collect()}
    assert got == brute_leaks(docs, items, 5)
    assert lk.leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0
    assert lk.leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


@pytest.mark.parametrize("values", [1, 2, 3, 200])
def test_suffix_array_is_sorted(values):
    s = np.random.RandomState(0).randint(0, values, 300)
    keys = [tuple(s[i:]) for i in lk.suffix_array(s)]
    assert keys == sorted(keys) and len(keys) == 300
    assert len(lk.suffix_array(s[:0])) == 0 and list(lk.suffix_array(s[:1])) == [0]


def test_texts_that_repeat_themselves(monkeypatch):
    """Only the places at which a match begins are followed, so a word said 3,000 times costs no 9 million."""
    shard = lk.Shard.build([(1, ["a"] * 3000), (2, ["b"] + ["a"] * 40 + ["c"])])
    shard = lk.Shard.unpacked(*shard.packed())
    assert sorted(shard.leaks([(7, ["a"] * 500 + ["c"]), (8, ["z"] * 20)], 13)) == [(1, 7, 500, 0, 0), (2, 7, 41, 1, 460)]
    monkeypatch.setattr(lk, "AT_ONCE", 3)
    assert sorted(shard.leaks([(7, ["a"] * 500 + ["c"])], 13)) == [(1, 7, 500, 0, 0), (2, 7, 41, 1, 460)]


def test_two_blocks_of_items_read_the_corpus_once(spark):
    """The plan of the matches reads shards and blocks that are written, not the texts."""
    d = spark.createDataFrame([(i, f"w{i} " * 40) for i in range(20)], "doc_id bigint, text string")
    plan = lk.leaks(d, "doc_id", "text", d, "doc_id", "text", 5, 100, 50)._jdf.queryExecution().optimizedPlan().toString()
    assert "suffixes" in plan and "text#" not in plan


def corpus(n, seed):
    rng = random.Random(seed)
    tiers = [[f"t{k}word{i}" for i in range(12)] for k in range(1, 6)]
    docs = []
    for i in range(n):
        level = rng.randint(1, 5)
        words = []
        for _ in range(rng.randint(45, 120)):
            words.append(rng.choice(tiers[min(4, max(0, level - 1 + rng.choice([0, 0, 0, -1, 1])))]))
            if rng.random() < 0.3 / level:
                words[-1] += "."
        docs.append((i, "en", " ".join(words), level))
    return docs


def test_levels_of_held_out_documents(spark):
    docs = corpus(500, 0)
    d = spark.createDataFrame([(i, lang, t, "clash") for i, lang, t, _ in docs] + [(900, "en", None, ""), (901, "en", "", ""), (902, None, "!?", "")], "doc_id bigint, lang string, text string, level string")
    rng = random.Random(9)
    labels = [(i, "r", min(5, max(1, level + (rng.choice([-1, 1]) if rng.random() < 0.1 else 0)))) for i, _, _, level in docs[:250]] + [(3, "s", None), (None, "s", 2), (7777, "s", 2), (901, "s", 1)]
    model = rd.train(d, spark.createDataFrame(labels, "doc_id bigint, rater string, level int"))
    got = {r.doc_id: r.level for r in rd.score(d, model).collect()}
    assert np.mean([got[i] == level for i, _, _, level in docs[250:]]) >= 0.85
    assert got[900] is None and got[901] is None and len(got) == 503


def test_no_labels_and_no_documents(spark):
    d = spark.createDataFrame([(1, "en", "a b c")], "doc_id bigint, lang string, text string")
    labels = spark.createDataFrame([], "doc_id bigint, rater string, level int")
    assert rd.score(d, rd.train(d, labels)).first().level is None
    assert rd.score(d.limit(0), rd.train(d, labels)).count() == 0


def test_all_labelled_documents_and_words_are_learned_from(spark):
    """2,400 labelled documents and 17,001 words in three of them each: every token is counted, every word is known, against plain Python."""
    words = [f"w{i}" for i in range(17_000)] * 3
    texts = [" ".join(words[i::2400]) + " end." for i in range(2400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    levels = [1 + i % 5 for i in range(2400)]
    model = rd.train(docs, spark.createDataFrame([(i, "r", k) for i, k in enumerate(levels)], "doc_id bigint, rater string, level int")).models
    assert model.total.sum() == sum(len(t.split()) + 1 for t in texts) and model.size == 17_000 + 2 + 1
    want = Counter()
    for t, k in zip(texts, levels):
        own = [0, 0, *(model.words.ids[w] for w in rd.tokens_of(t))]
        want.update((a, b, w, k - 1) for a, b, w in zip(own, own[1:], own[2:]))
    for own in (model, pickle.loads(pickle.dumps(model))):
        a, b, w, level = np.array(list(want)).T
        at = own.trigrams.find(own._trigram(own.pairs.find(own.words.key(a, b)), w))
        assert (own.abw[at, level] == list(want.values())).all()
        assert own.abw.sum() == own.ab.sum() == own.bw.sum() == own.b.sum() == own.w.sum() == own.total.sum()


def test_regression_in_parts_is_that_of_the_whole(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 6)) * [1, 2, 3, 4, 5, 0] + 7
    y = np.clip(np.round(3 + (x[:, 0] - 7) + (x[:, 1] - 7) / 4 + rng.normal(size=700) / 2), 1, 5)
    rows = spark.createDataFrame([(float(v), r.tolist()) for v, r in zip(y, x)], "level double, x array<double>").repartition(7)
    mean, spread, weights, ends, steps = rd.fitted(rows)
    assert np.allclose(mean, x.mean(0)) and np.allclose(spread, x.std(0) + 1e-9)
    z = np.c_[np.clip((x - x.mean(0)) / (x.std(0) + 1e-9), -5, 5), np.ones(700)]
    assert np.allclose(weights, np.linalg.solve(z.T @ z + 30 * np.eye(7), z.T @ y))
    assert np.allclose(np.interp(z @ weights, ends, steps), np.interp(z @ weights, *rd.isotonic(z @ weights, y)))


def test_isotonic_is_monotone_least_squares():
    x, y = rd.isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([2.0, 1.0, 3.0, 4.0]))
    assert list(x) == [1, 2, 3, 4] and list(y) == [1, 2.5, 2.5, 4]

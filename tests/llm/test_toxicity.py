import zlib

import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from curbline.llm.toxicity import maximal_segments, score_documents, train


def plain_maximal(scores):
    """By definition: the best segment, the shortest among equals, then the same on both sides of it."""

    def best(lo, hi):
        found = None
        for a in range(lo, hi):
            for b in range(a + 1, hi + 1):
                s = sum(scores[a:b])
                if s > 0 and (found is None or (s, a - b) > (found[2], found[0] - found[1])):
                    found = (a, b, s)
        return found

    def cut(lo, hi):
        top = best(lo, hi)
        return cut(lo, top[0]) + [top] + cut(top[1], hi) if top else []

    return cut(0, len(scores))


@given(st.lists(st.integers(-5, 5), max_size=14))
@settings(max_examples=200, deadline=None)
def test_maximal_segments(scores):
    got = maximal_segments(np.array(scores, float))
    want = plain_maximal(scores)
    assert got == want


def test_maximal_segments_of_a_book_in_linear_time():
    rng = np.random.default_rng(1)
    for scores in (np.tile([1.0, -1.0, -1.0], 333_334), np.tile([1.0, -0.5, 1.0, -2.0], 250_000), rng.choice([1.0, -1.0, -1.5], 1_000_000), rng.normal(0.02, 1, 1_000_000)):
        began = time.process_time()
        found = maximal_segments(scores)
        assert found and time.process_time() - began < 6
    assert len(maximal_segments(np.tile([1.0, -1.0, -1.0], 1000))) == 1000


def corpus(spark, n=900, seed=4):
    rng = np.random.default_rng(seed)
    words, bad = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)], ["vile", "rotten", "awful", "nasty"]
    docs, labels = [], []
    for i in range(n):
        own = list(rng.choice(words, int(rng.integers(20, 200))))
        toxic = int(rng.random() < 0.2)
        for _ in range(4 * toxic):
            own.insert(int(rng.integers(len(own))), str(rng.choice(bad)))
        docs.append((i, " ".join(own), 9))
        if rng.random() < 0.6:
            labels.append((i, toxic))
    docs += [(n, None, 1), (n + 1, "", 1), (None, "vile rotten awful nasty", 1), (3, docs[3][1], 9)]
    labels += [(5, 7), (None, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, toxic int"), spark.createDataFrame(labels, "doc_id long, toxic int"), bad


def test_held_out_accuracy(spark):
    docs, labels, bad = corpus(spark)
    model = train(docs, labels)
    assert {f"={w}" for w in bad} <= {w for w, x in model.weights.items() if x > 0}
    got = score_documents(docs, model).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: any(w in (r.text or "") for w in bad) for r in docs.collect()}
    held = [r for r in got if r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.predicted == 0 for r in got if r.doc_id in (900, 901))


def test_rare_exclusive_words_of_a_large_vocabulary(spark):
    """Words that only toxic rows use keep their weight however rare they are, and unseen inflections of a stem count."""
    rng = np.random.default_rng(8)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    words = np.array(["".join(rng.choice(letters, int(rng.integers(2, 9)))) for _ in range(20_000)])
    bad = ["scoundrel", "villain", "wretch", "knave", "cad"]
    docs, labels = [], []
    for i in range(1500):
        own, toxic = list(rng.choice(words, 150)), int(i % 8 == 0)
        for _ in range(2 * toxic):
            own.insert(int(rng.integers(len(own))), str(rng.choice(bad)) if i % 16 else "zqxjk" + "".join(rng.choice(letters, 2)))
        docs.append((i, " ".join(own)))
        labels.append((i, toxic))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = train(docs, labels)
    assert {f"={w}" for w in bad} <= model.weights.keys() and model.weight("zqxjkww") > 1
    held = [r for r in score_documents(docs, model).collect() if r.held_out]
    assert np.mean([r.predicted for r in held if r.doc_id % 8 == 0]) >= 0.9
    assert np.mean([r.predicted for r in held if r.doc_id % 8]) <= 0.02


def test_very_long_text_and_clashing_names(spark):
    """A long text is one row like any other; columns named as results are not looked at."""
    docs, labels, bad = corpus(spark)
    model = train(docs, labels)
    rows = spark.createDataFrame([(1, "wa " * 300_000 + "vile rotten nasty awful", 9.0, 7), (1, "wa " * 300_000, 9.0, 7)], "doc_id long, text string, score double, unit int")
    got = score_documents(rows, model).orderBy("predicted").collect()
    assert [r.predicted for r in got] == [0, 1] and got[1].segments[-1].end == 300_004


def test_one_label_only_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    none = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert all(r.score < 0.5 for r in score_documents(docs, train(docs, none)).collect())
    assert score_documents(docs.limit(0), train(docs, none.limit(0))).count() == 0


def test_query_against_a_plain_version(spark):
    """Scores of whole texts, recomputed by definition: stems looked up one by one, best segments by trying all, their expectations summed."""
    import math

    docs, labels, bad = corpus(spark, 500)
    model = train(docs, labels)
    texts = ["wa wb vile wc rotten rotten wd", "vilest wx " + "wb " * 40 + "awful", "wc wd we", "", None, "nasty", "Vile " * 12 + "we " * 12]
    got = {r.doc_id: r for r in score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        tokens = (text or "").lower().split()
        weights = []
        for t in tokens:
            names = ["=" + t, *(t[:k] for k in range(12, 3, -1) if k <= len(t))]
            weights.append(next((model.weights[n] for n in names if n in model.weights), 0.0) - model.drift)
        evidence = 0.0
        for a, b, s in plain_maximal(weights):
            e = model.k * len(tokens) * math.exp(-model.lam * s)
            evidence += -math.log(max(e, 1e-12) / 0.5) if e < 0.5 else 0.0
        want = 1 / (1 + math.exp(-(model.intercept + model.slope * math.log1p(evidence))))
        assert abs(got[i].score - want) < 1e-9 and got[i].predicted == int(want >= 0.5), text
    assert got[0].predicted == got[6].predicted == 1 and got[2].predicted == got[3].predicted == 0

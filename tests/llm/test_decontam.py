import numpy as np

from curbline.llm.decontam import contained_items, remove_contaminated


def words_of(text):
    return [w for w in __import__("re").split(r"[\x09-\x0d ]+", (text or "").lower()) if w]


def brute(docs, items, t=0.8):
    shingles = {}
    for i, text in items:
        w = words_of(text)
        if w:
            k = min(5, len(w))
            shingles.setdefault(i, set()).update(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    out = set()
    for d, text in docs:
        w = words_of(text)
        if text is None:
            continue
        for i, own in shingles.items():
            held = {s for s in own if any(tuple(w[j : j + len(s)]) == s for j in range(len(w) - len(s) + 1))}
            if len(held) >= t * len(own) - 1e-9:
                out.add((d, i, len(own), len(held), round(len(held) / len(own), 6)))
    return out


def case(seed=3):
    rng = np.random.default_rng(seed)
    vocab = [f"v{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(vocab, int(rng.integers(5, 60))))) for i in range(30)]
    items += [(100, "one two three"), (101, None), (102, ""), (103, "Exactly five words are here"), (5, items[5][1])]
    docs = []
    for i in range(120):
        own = list(rng.choice(vocab, int(rng.integers(0, 400))))
        if i % 3 == 0:
            w = items[int(rng.integers(30))][1].split()
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(len(w)))] = "changed"
            at = int(rng.integers(len(own) + 1))
            own[at:at] = w
        docs.append((i, " \n".join(own)))
    docs += [(500, None), (501, ""), (502, "say ONE\ttwo three now"), (None, "x exactly five words are here y"), (3, docs[3][1]), (3, "another text")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = case()
    d = spark.createDataFrame([(*r, "n", 1, 2) for r in docs], "doc_id long, text string, item_id string, bad_id int, h int")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in contained_items(d, i).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items) and len(got) > 15
    bad = {r[0] for r in got}
    kept = remove_contaminated(d, i)
    assert kept.columns == d.columns
    kept = [r.doc_id for r in kept.collect()]
    assert sorted(map(str, kept)) == sorted(str(k) for k, _ in docs if k not in bad)


def test_no_python_in_the_plan_and_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    i = spark.createDataFrame([], "item_id long, text string")
    found = contained_items(d, i)
    assert found.count() == 0 and "Python" not in found._jdf.queryExecution().toString()
    assert remove_contaminated(d, i).count() == 0


def test_sketches_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr("curbline.llm.decontam.BROADCAST_ROWS", 0)
    docs, items = case(4)
    got = contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == brute(docs, items)


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 300_000 + "a fine small test item of eight words"), (2, "word " * 300_000)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "A fine small test item of eight words")], "item_id long, text string")
    assert [tuple(r) for r in contained_items(docs, items).collect()] == [(1, 7, 4, 4, 1.0)]

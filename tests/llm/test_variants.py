import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from curbline.llm import variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(docs):
    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def case(seed=2):
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list("abcdeéß"), int(rng.integers(5, 10)))) for _ in range(60)]
    vocab = []
    for w in base:
        vocab += [w] * int(rng.integers(1, 120))
        for _ in range(4):
            k, c = int(rng.integers(len(w))), str(rng.choice(list("abé")))
            vocab += [str(rng.choice([w[:k] + c + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + c + w[k:]]))] * int(rng.integers(1, 12))
    vocab += ["aaaaaaaa"] * 900 + ["aaaaaaab"] * 130 + ["aaaaaabb"] * 20 + ["aaaabbbb"] * 5 + ["abcdefghij" * 30] * 6 + ["abcdefghij" * 30 + "x"] * 40
    rng.shuffle(vocab)
    docs = [(i, " ".join(w.capitalize() if rng.random() < 0.2 else w for w in vocab[i * 40 : (i + 1) * 40])) for i in range(len(vocab) // 40 + 1)]
    return [*docs, (900, None), (901, ""), (None, "Lonely-words ÉCOLES écoles ÉCOLES! " * 9), (3, docs[3][1]), (3, docs[3][1]), (902, "日本語 ×÷×÷×÷ x" * 8)]


def frame(spark, docs):
    return spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, word string, n int")


def found(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


@pytest.mark.parametrize("size", [variants.SHARD, 7])
def test_against_brute_force(spark, size):
    docs = case()
    want = brute(docs)
    got = found(variants.group_variants(frame(spark, docs), shard=size, block=size + 3))
    assert got == want and sum(1 for w in want if w[1]) > 15 and any(w[1] and w[1] != w[2] for w in want)


def test_pairs_in_small_parts(monkeypatch):
    monkeypatch.setattr(variants, "PAIRS", 5)
    rng = np.random.default_rng(5)
    for a, b in ((6, 6), (7, 6), (6, 7), (9, 9), (8, 6)):
        words, others = (sorted({"".join(rng.choice(list("ab"), n)) for _ in range(80)}) for n in (a, b))
        i, j = variants.Shard(others).near(words)
        assert sorted(zip(i, j, strict=True)) == sorted((x, y) for x, w in enumerate(words) for y, v in enumerate(others) if one_edit(w, v))


def test_damaged_run():
    hit = [f"word{i}" for i in range(3000) if zlib.crc32(f"7:word{i}".encode()) % 199 == 0]
    assert hit and all(len(variants.damaged_run("7", w)) == len(w) - 1 for w in hit) and variants.damaged_run("7", "word0") in ("word0", *(("word0"[:k] + "word0"[k + 1 :]) for k in range(5)))


def test_sql_says_the_same(spark):
    docs = case(4)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(d) for d in docs])
    names = ("word", "form", "root", "n", "n_near", "form_n")
    rel = con.execute(variants.ORACLE)
    order = [[c[0] for c in rel.description].index(n) for n in names]
    want = sorted((r[order[0]], r[order[1]] or "", r[order[2]], r[order[3]], r[order[4]], -1 if r[order[5]] is None else r[order[5]]) for r in rel.fetchall())
    assert found(variants.group_variants(frame(spark, docs))) == want


def test_empty_and_very_long(spark):
    assert variants.group_variants(frame(spark, [])).count() == 0
    text = "Some words repeat without end " * 50_000 + "y" * 200_000
    got = {r.word: r.n for r in variants.group_variants(frame(spark, [(1, text)])).collect()}
    assert set(got) <= {"repeat", "without"} and set(got.values()) <= {50_000}

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from curbline.llm import divergence


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(docs, min_docs, top=50):
    held, docs_of, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text or "")))
        held[lang, source] += terms
        docs_of[lang].update(list(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs_of[lang].items() if n >= min_docs]
        own = sorted(s for x, s in groups if x == lang)
        total = Counter()
        for s in own:
            total += held[lang, s]

        def vector(c):
            whole = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // whole for t in kept}

        q, p = vector(total), {s: vector(held[lang, s]) for s in own}
        for s in own:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if held[lang, s][t] and p[s][t] > q[t])[:top]
            for part, rows in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(rows)]
    return sorted(out)


def case(n=400, sources=13):
    rng = np.random.default_rng(7)
    vocab = [f"{a}{b}{c}" for a in "abé" for b in "cdß" for c in ("x", "yy", "Ω", "日")]
    docs = []
    for i in range(n):
        s = int(rng.integers(sources))
        odds = np.roll(1.0 / (1 + np.arange(len(vocab))), s)
        words = rng.choice(vocab, int(rng.integers(0, 60)), p=odds / odds.sum())
        docs.append((" ".join(w.upper() if rng.random() < 0.3 else w for w in words) + " 12_x", ["en", "de"][i % 2], f"s{s}"))
    docs += [(None, "en", "quiet"), ("", None, None), ("alone words", None, "b"), ("x", "one", "only"), (docs[0][0], "en", "s0"), (docs[0][0], "en", "s0")]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(*r, 1, 2) for r in docs], "text string, lang string, source string, term int, value int")


def found(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


@pytest.mark.parametrize("segment,block", [(divergence.SEGMENT, divergence.BLOCK), (5, 2), (3, 1)])
def test_against_brute_force(spark, segment, block):
    docs = case()
    want = brute(docs, 30)
    assert found(divergence.audit(frame(spark, docs), segment=segment, block=block)) == want
    assert len([w for w in want if w[2] == "term"]) > 50 and max(w[4] for w in want) > 10**8


def test_every_block_meets_every_other_once(spark):
    for n in (1, 2, 3, 6, 7, 12):
        players = n + n % 2
        rows = spark.range(players).selectExpr("id as block", f"cast({players} as long) as players")
        met = [tuple(sorted(r)) for t in range(players - 1) for r in rows.select("block", divergence.partner(rows.block, rows.players, t)).collect()]
        assert Counter(met) == {(a, b): 2 for b in range(players) for a in range(b)}


def test_shares_are_exact():
    counts = np.array([0, 1, 7, 10**12, 4 * 10**15 - 5], np.int64)
    for whole in (5, 9, 10**13 + 7, 4 * 10**15):
        fits = counts[counts + 5 <= whole]
        assert divergence.shares(fits, whole).tolist() == [1 + 10**9 * (int(c) + 5) // whole for c in fits]


def test_sql_says_the_same(spark):
    docs = case(300, 5)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [list(d) for d in docs])
    assert sorted(con.execute(divergence.ORACLE).fetchall()) == found(divergence.audit(frame(spark, docs))) == brute(docs, 30)


def test_empty_long_and_small_tallies(spark, monkeypatch):
    assert divergence.audit(frame(spark, [])).count() == 0
    monkeypatch.setattr(divergence, "HELD", 10)
    docs = case(120, 3) + [("Same words " * 100_000, "en", "s1")]
    assert found(divergence.audit(frame(spark, docs), min_docs=4)) == brute(docs, 4)

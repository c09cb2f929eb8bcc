import hashlib

import numpy as np
import pyarrow as pa
import pytest

from curbline.llm import doubling, substring
from curbline.llm.substring import remove_repeats


def brute(rows, n=100):
    """rows in order: (doc_id, text); the same row again is the same document."""
    seen, done, out = set(), {}, []
    for d, text in rows:
        b = (text or "").encode()
        if (d, b) not in done:
            gone = np.zeros(len(b), bool)
            for p in range(len(b) - n + 1):
                w = b[p : p + n]
                if w in seen:
                    gone[p : p + n] = True
                seen.add(w)
            spans = int(np.sum(gone & ~np.r_[False, gone[:-1]])) if len(b) else 0
            left = bytes(np.frombuffer(b, np.uint8)[~gone]) if len(b) else b""
            done[d, b] = (len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
        out.append((str(d), *done[d, b]))
    return sorted(out)


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    text = lambda k: "".join(rng.choice(list("abcdeé \n"), k))
    base = [text(int(rng.integers(150, 900))) for _ in range(6)]
    rows = []
    for i in range(n):
        own = text(int(rng.integers(0, 300)))
        for _ in range(int(rng.integers(0, 3))):
            b = base[int(rng.integers(6))]
            a = int(rng.integers(0, 60))
            own += b[a : a + int(rng.integers(80, 400))] + text(int(rng.integers(0, 40)))
        rows.append((i, own))
    rows += [(n, "x" * 350), (n + 1, "ab" * 220), (n + 2, "x" * 99), (n + 3, None), (n + 4, ""), (n + 5, "x" * 101), (n + 6, base[0] * 3), (n + 6, base[0] * 3), (n + 7, rows[3][1]), (None, base[1])]
    return rows


@pytest.mark.parametrize("seed,segment", [(1, None), (2, None), (3, 256)])
def test_against_brute_force(spark, seed, segment):
    rows = corpus(seed)
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, low long").repartition(5)
    found = remove_repeats(frame, segment=segment or substring.SEGMENT)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()) == brute(rows)


def test_short_segments_on_the_worker():
    """The pieces of a long text give the same windows as the whole."""
    rng = np.random.default_rng(9)
    data = bytes(rng.integers(97, 101, 3000, dtype=np.uint8))
    whole, parts = list(substring._pieces([data])), list(substring._pieces([data], 500))
    windows = lambda pieces: {(p + off) for d, spans, s, e in pieces for (_, off), lo, hi in zip([spans[i] for i in substring.block_anchors(d, s, e)[0]], *substring.block_anchors(d, s, e)[1:3]) for p in range(lo, hi + 1)}
    assert windows(whole) == windows(parts) == set(range(2901))


def test_different_texts_of_one_id_and_empty(spark):
    a, b = "".join(chr(97 + i % 23) + str(i) for i in range(60)), "q" * 5
    frame = spark.createDataFrame([(1, a), (1, a + b), (2, a)], "doc_id long, text string")
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in remove_repeats(frame).collect()]
    assert sorted(got)[-1] == (2, len(a), len(a)) and sum(r[2] > 0 for r in got) == 2
    assert remove_repeats(frame.limit(0)).count() == 0


def test_null_ids_come_after_the_largest(spark):
    a = "".join(chr(97 + i % 23) + str(i) for i in range(80))
    rows = [(None, a), ((1 << 63) - 1, a), (-(1 << 63), "x" + a)]
    got = {r.doc_id: r.n_removed for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {None: len(a), (1 << 63) - 1: len(a), -(1 << 63): 0}


@pytest.mark.parametrize("seed", [1, 4])
def test_prefix_doubling_of_every_position(spark, seed):
    rows = corpus(seed)
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, rank long").repartition(5)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in doubling.remove_repeats(frame).collect())
    assert got == brute(rows)
    assert doubling.remove_repeats(frame.limit(0)).count() == 0


def lined(n, line=73):
    rng = np.random.default_rng(4)
    shared = "".join(rng.choice(list("abcdefgh "), line))
    text = lambda k: "".join(rng.choice(list("ijklmnop \n"), k))
    return [(i, text(int(rng.integers(40, 200))) + shared + text(int(rng.integers(40, 200)))) for i in range(n)]


def test_a_line_in_every_document_is_dealt_by_class():
    rows = lined(600)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([0] * len(rows)), pa.array([r[1].encode() for r in rows])], ["doc", "tie", "text"])
    plain = next(substring._anchor_rows([batch])).to_pandas()
    counts = plain["deal"].value_counts()
    assert counts.iloc[0] > 500
    split = next(substring._anchor_rows([batch], heavy=tuple(int(g) for g in counts[counts > 0.005 * len(plain)].index))).to_pandas()
    assert len(split) == len(plain) and split["deal"].value_counts().iloc[0] < 0.01 * len(split)


def test_heavy_ranks_change_no_result(spark, monkeypatch):
    monkeypatch.setattr(substring, "SAMPLE", 1)
    monkeypatch.setattr(substring, "HEAVY", 10_000)
    rows = lined(120) + [(1000 + i, t) for i, t in corpus(6) if i is not None] + [(2000 + i, t) for i, t in lined(30, 97)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = remove_repeats(frame)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()) == brute(rows)


def test_alternating_runs_have_hashes_of_their_own():
    """Thue-Morse runs cancel in a polynomial over bytes modulo a power of two."""
    one = np.array([bin(i).count("1") % 2 for i in range(64)], np.uint8)
    data = np.concatenate([97 + one, 98 - one])
    a, b = substring.Block(data).hash(np.array([0, 64]), 64)
    assert (a ^ b) & np.uint64(0xFFFFFFFF) and (a ^ b) >> np.uint64(32)


def test_very_long_text(spark):
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdefghij"), 1_300_000))
    got = remove_repeats(spark.createDataFrame([(1, text), (2, text[700_000:] + "end")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in got] == [(1_300_000, 0, 0), (600_003, 600_000, 1)]

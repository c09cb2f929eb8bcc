import zlib

import numpy as np
import pytest

from curbline.llm import lang_id
from curbline.llm.lang_id import CONTEXT, CORE, UNDETERMINED, fit, identify, keep_identified, train

PARTS = {"xx": "ba ke lo mu ri".split(), "yy": "sch ung ein öt zur".split(), "zz": "çon née aux ois ê".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang], int(rng.integers(1, 4)))) for _ in range(n))


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    return [(i, text(rng, lang := str(rng.choice(list(PARTS))), int(rng.integers(3, 200))), lang) for i in range(n)]


@pytest.fixture(scope="module")
def small():
    rows = corpus(300, 1)
    return fit([t for _, t, _ in rows], [lang for *_, lang in rows], steps=250)


def test_held_out_accuracy(small):
    rows = corpus(200, 2)
    got = small.documents([t for _, t, _ in rows])
    assert np.mean([g[0] == lang for g, (*_, lang) in zip(got, rows)]) > 0.97
    assert all(0 <= s <= 1 for _, s in got)


def test_gradients_by_differences():
    """Backpropagation through time against finite differences, inside the gates' straight parts."""
    from curbline.llm.lang_id import _fresh

    rng = np.random.default_rng(3)
    cell = _fresh(rng, ["a", "b"], 3).ahead
    for x in cell.arrays():
        x *= 0.2
    cell.gates += 0.4
    data = rng.integers(0, 256, (6, 4)).astype(np.uint8)
    target = (rng.normal(size=(6, 4, 3)) * 1e-4).astype(np.float32)
    out, kept = cell.forward(data)
    assert np.allclose(out, cell.run(data), atol=1e-6)
    grads = cell.backward(data, kept, target)
    for x, g in zip(cell.arrays(), grads):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, step = float(x[at]), 1e-2
        x[at] = old + step
        up = float((cell.forward(data)[0].astype(float) * target).sum())
        x[at] = old - step
        down = float((cell.forward(data)[0].astype(float) * target).sum())
        x[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 0.03 * abs(g[at]) + 1e-7


def test_whole_texts_in_segments(small):
    """A text's result does not depend on the texts beside it, and every part of a long one counts."""
    rng = np.random.default_rng(4)
    long = text(rng, "xx", 40) + " " + text(rng, "yy", 3000)
    assert small.documents([long])[0][0] == "yy"
    alone = small.documents(["keba lomu", long, "née aux"])
    for i, x in enumerate(["keba lomu", long, "née aux"]):
        assert np.allclose(alone[i][1], small.documents([x])[0][1], atol=1e-4)
    exact = "b" * (CORE - CONTEXT), "b" * CORE, "b" * (CORE + 1), "b" * 2 * CORE
    assert all(0 < s <= 1.0001 for _, s in small.documents(list(exact)))


def test_queries(spark):
    rows = corpus(400, 5)
    more = [(900, None, "xx"), (901, "", "xx"), (902, "123 !? 45", "yy"), (None, rows[0][1], "zz"), (903, rows[1][1], None), (3, rows[3][1], rows[3][2])]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows + more], "doc_id long, text string, lang string, score double")
    model = train(docs)
    got = identify(docs, model).collect()
    assert len(got) == len(rows) + len(more)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(r.lang_pred, rows[r.doc_id][2]) for r in got if r.held_out and r.doc_id < 400]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) > 0.97
    assert all((by[i].lang_pred, by[i].score) == (UNDETERMINED, 0.0) for i in (900, 901, 902))
    kept = keep_identified(docs, model)
    assert kept.columns == docs.columns and {900, 901, 902}.isdisjoint(r.doc_id for r in kept.collect())


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in identify(docs, train(docs)).collect()] == [(UNDETERMINED, 0.0)]
    assert identify(docs.limit(0), train(docs)).count() == 0


def test_kept_rows_of_an_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([(i, ("the of and to " if i % 2 else "der die und das ") * 30, "ab"[i % 2], 1.0, "x") for i in range(60)] + [(99, None, "a", 0.0, "y")], "doc_id long, text string, lang string, score double, lang_pred string")
    model = train(docs)
    kept = keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id = 99").count() == 0 and kept.count() > 0
    assert keep_identified(docs.limit(0), model).count() == 0


def plain_pass(model, text):
    """Label probabilities pooled over the letters of a text, byte by byte in plain Python, the whole text at once."""
    body = text.lower().encode()

    def states(cell, data):
        h, out = [0.0] * cell.u_cand.shape[0], []
        for byte in data:
            n = len(h)
            gate = [min(1.0, max(0.0, float(cell.gates[byte, j]) + sum(h[i] * float(cell.u_gates[i, j]) for i in range(n)))) for j in range(2 * n)]
            new = [min(1.0, max(-1.0, float(cell.cand[byte, j]) + gate[n + j] * sum(h[i] * float(cell.u_cand[i, j]) for i in range(n)))) for j in range(n)]
            h = [new[j] + gate[j] * (h[j] - new[j]) for j in range(n)]
            out.append(h)
        return out

    ahead, back = states(model.ahead, body), states(model.back, body[::-1])[::-1]
    pooled = np.zeros(len(model.langs))
    for byte, a, b in zip(body, ahead, back, strict=True):
        if 97 <= byte <= 122 or byte >= 128:
            logits = np.array(a) @ model.w_ahead + np.array(b) @ model.w_back + model.bias
            e = np.exp(logits - logits.max())
            pooled += e / e.sum()
    return pooled / pooled.sum()


def test_against_a_plain_pass_over_whole_texts():
    rng = np.random.default_rng(12)
    word = lambda letters: "".join(rng.choice(list(letters), int(rng.integers(2, 8))))
    text = lambda letters, n: " ".join(word(letters) for _ in range(n))
    alphabets = {"aa": "abcdef", "bb": "defghé", "cc": "ghijkß"}
    model = lang_id.fit([text(a, 60) for a in alphabets.values() for _ in range(20)], [k for k in alphabets for _ in range(20)], steps=40)
    short = [text(a, int(rng.integers(3, 60))) + " 12!" for a in [*alphabets.values()] * 3]
    for t, (lang, score) in zip(short, model.documents(short), strict=True):  # one segment: the same numbers
        p = plain_pass(model, t)
        assert lang == model.langs[int(p.argmax())] and abs(score - p.max()) < 2e-4
    long = [text(a, 260) for a in alphabets.values()]  # several segments, whose context stands for what lies further off
    for t, (lang, score) in zip(long, model.documents(long), strict=True):
        p = plain_pass(model, t)
        assert lang == model.langs[int(p.argmax())] and abs(score - p.max()) < 0.02

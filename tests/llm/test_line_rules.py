import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from curbline.llm import line_rules

BLANK = r"[\x20\x09-\x0d]+"
COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines")


def norm(line):
    return re.sub(r"[\x20\x09-\x0d0-9]+", "", line).lower()


def lines_of(text):
    return [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]


def brute(docs, min_docs, share):
    docs = [(i, t or "", h) for i, t, h in docs]
    size, held = Counter(h for _, _, h in docs), defaultdict(int)
    for _, t, h in docs:
        for x in {norm(x) for x in lines_of(t)}:
            held[h, x] += 1
    bad = {k for k, n in held.items() if n > min_docs and n > share * size[k[0]]}
    out = []
    for i, t, h in docs:
        words, lines = [w for w in re.split(BLANK, t) if w], lines_of(t)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        twice = {w for w, n in Counter(windows).items() if n > 1}
        covered = {k + j for k, w in enumerate(windows) if w in twice for j in range(5)}
        total, lost = sum(len(norm(x)) for x in lines), sum(len(norm(x)) for x in lines if (h, norm(x)) in bad)
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        removed = sum((h, norm(x)) in bad for x in lines)
        out.append((i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed, not failed and total - lost >= 0.5 * total, removed))
    return out, bad


def case():
    rng = np.random.default_rng(11)
    vocab = [f"w{chr(97 + i % 26)}{i}é" for i in range(300)] + ["#", "<b>", "a|b"]
    common = ["Subscribe to our News letter 12", "subscribe to our  news letter 7", "All rights reserved", "Menu \t home"]
    docs = []
    for i in range(160):
        lines = [" ".join(rng.choice(vocab, int(rng.integers(1, 15)))) for _ in range(int(rng.integers(1, 8)))]
        lines += [common[int(rng.integers(4))] for _ in range(int(rng.integers(0, 4)))]
        if i % 9 == 0:
            lines += [lines[0]] * 3
        docs.append((i, "\n".join(rng.permutation(lines)), ["a", "a", "b", None][i % 4]))
    docs += [(500, None, "a"), (501, "", "a"), (502, " \n\t\n \x0b", "b"), (503, "one two three four five six seven eight nine ten", None), (504, "x y z w v " * 20, "b"), (None, docs[3][1], "a"), (3, docs[3][1], docs[3][2]), (3, docs[3][1], docs[3][2])]
    docs += [(600 + k, "\n".join(common), "a") for k in range(3)] + [(700, "1 2\n3 4\n" * 10, "b")]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, source string, h string, row int")


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("most", [line_rules.BROADCAST_ROWS, 0])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(line_rules, "BROADCAST_ROWS", most)
    docs = case()
    want, bad = brute(docs, 5, 0.05)
    got = line_rules.judge(frame(spark, docs), min_docs=5, share=0.05)
    assert found(got) == sorted(want, key=str) and len(bad) > 4 and len({r[7] for r in want}) == 2
    assert "Python" not in got._jdf.queryExecution().toString()
    assert found(got.where("n_words > 20 and not base_failed")) == sorted((r for r in want if r[1] > 20 and not r[6]), key=str)


def test_sql_says_the_same(spark, monkeypatch):
    docs = case() * 6
    con = duckdb.connect()
    con.register("rows", frame(spark, docs).toPandas())
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM rows")
    want = sorted((tuple(None if isinstance(x, float) else x for x in r) for r in con.execute(line_rules.ORACLE).fetchall()), key=str)
    assert found(line_rules.judge(frame(spark, docs))) == want == sorted(brute(docs, 20, 0.01)[0], key=str)


def test_cleaned_texts(spark):
    docs = case()
    want, bad = brute(docs, 5, 0.05)
    cleaned = line_rules.clean(frame(spark, docs), min_docs=5, share=0.05)
    assert cleaned.columns == ["doc_id", "text", "source", "h", "row"]
    left = [(i, "\n".join(x for x in t.split("\n") if (h, norm(x)) not in bad), h) for (i, t, h), w in zip(docs, want, strict=True) if w[7]]
    assert sorted(((r.doc_id, r.text, r.source) for r in cleaned.collect()), key=str) == sorted(left, key=str)
    assert any(t != dict((d[0], d[1]) for d in docs)[i] for i, t, _ in left)


def test_empty_and_very_long(spark):
    assert line_rules.judge(frame(spark, [])).count() == 0 and line_rules.clean(frame(spark, [])).count() == 0
    long = " ".join(f"v{i}" for i in range(400_000))
    r = line_rules.judge(frame(spark, [(1, long, "a"), (2, "again and again it says " * 100_000, "a")])).orderBy("doc_id").collect()
    assert [(x.n_words, x.n_repeat_words, x.kept) for x in r] == [(400_000, 0, True), (500_000, 500_000, False)]

import hashlib
import math
import re

import numpy as np

from curbline.llm import queries
from curbline.llm.secrets import MASK, Automaton, Scorer, candidates, redact, rule_spans, scan, train

HEX40 = "0123456789abcdef0123456789abcdef01234567"


def plain_base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


CASES = [
    None, "", "nothing here", f'x token = "{HEX40}" y', "PassWord:abc12345 secret=short1", "api_key='ABCDEFGH.1' apikey=12345678",
    "AKIA" + "A1" * 6 + " AKIAshort", "é🙂 token:abcdefgh", f"{HEX40} and {HEX40.upper()}", "secret = token = abcdefghij", "paſſword=abcdefgh toKen=abcdefgh", "f" * 31 + " " + "f" * 32,
]


def test_rules():
    for text in CASES:
        assert [s[:3] for s in rule_spans(text or "")] == plain_base(text or "")


def rows_with_secrets(n=300, seed=1):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("etaoinshr"), int(rng.integers(2, 20))))
    rows = []
    for i in range(n):
        words = [word() for _ in range(40)]
        if i % 2:
            words[7] = 'token = "' + "".join(rng.choice(list("0123456789abcdef"), 40)) + '"'
        rows.append((i, " ".join(words)))
    return rows


def secret(rng):
    return "ghx_" + "".join(rng.choice(list("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), 24))


ORDINARY = "2024-01-01 averyveryverylongordinaryword mail6.example.com 7831179344661714 555-34680 126.40.69.100 well-known-thing ghx_short x=1234567 thndblest.77"


def test_scan_and_learned_spans(spark):
    """Values of a labelled format are found without their keyword, at a sentence's end or after another keyword; ordinary tokens are not."""
    rng = np.random.default_rng(3)
    rows = [*rows_with_secrets(), *((1000 + i, t) for i, t in enumerate(CASES)), (1003, CASES[3])]
    rows += [(2000 + i, f'some words token = "{secret(rng)}" and {ORDINARY}') for i in range(100)]
    bare = [(3000 + i, f"{ORDINARY}. \u00e9 {('', 'key=', '')[i % 3]}{secret(rng)}{'.' * (i % 2)} {ORDINARY}") for i in range(60)] + [(None, f"a {secret(rng)}")]
    docs = spark.createDataFrame([(*r, "x") for r in rows + bare], "doc_id long, text string, spans string")
    got = scan(docs).collect()
    assert len(got) == len(rows + bare)
    by = {(r.doc_id, r.base_sha256) for r in got}
    for i, t in rows + bare:
        named = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in plain_base(t or ""))
        assert (i, hashlib.sha256(named.encode()).hexdigest()) in by
    spans = {r.doc_id: r.spans for r in got}
    want = {i: f"format:{(at := re.search('ghx_[A-Za-z0-9]{24}', t).start())}:{at + 28}" for i, t in bare}
    assert np.mean([spans[i] == w for i, w in want.items()]) >= 0.9
    assert all(r.n_format == 0 for r in got if r.doc_id is not None and r.doc_id < 3000)
    assert all(r.spans == ",".join(x for x in (r.spans.split(",") if r.spans else []) if x.split(":")[0] in ("assign", "access", "hex", "format")) for r in got)


def test_automata_learn_length_and_head():
    rng = np.random.default_rng(2)
    values = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(300)]
    own = Automaton(values)
    assert own.size == 41  # one state a place: the length is known
    assert all(own.log_likelihood(v[:39]) + 5 < own.log_likelihood(v) and own.log_likelihood(v + "0") + 5 < own.log_likelihood(v) for v in values[:20])
    keys = Automaton(["AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 16)) for _ in range(80)])
    assert keys.surprise("AKIA" + "Q7" * 8) < 1 and keys.surprise("BKIA" + "Q7" * 8) > 5
    loose = Automaton(["".join(rng.choice(list("abcdefgh"), int(rng.geometric(0.2)) + 7)) for _ in range(500)])
    assert loose.size < 20  # states of a tail of any length are one


def test_too_few_labelled_values_are_no_format():
    assert not Scorer({2: [HEX40] * 9}, ["ordinary"] * 50).formats


def test_redaction(spark):
    docs = spark.createDataFrame([(1, f'a token = "{HEX40}" b', 3), (2, None, 4), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in redact(docs).orderBy("doc_id").collect()] == [(1, f'a {MASK}" b', 3), (2, None, 4), (3, "clean", 5)]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert scan(none).count() == 0 and redact(none).count() == 0


def test_very_long_text_and_clashing_names(spark):
    rows = [(i, f"token = {secret(np.random.default_rng(i))}", 1) for i in range(40)] + [(None, "word " * 400_000 + f"token={HEX40} end", 2), (7, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind int")
    got = {r.doc_id: r.spans for r in scan(docs).collect()}
    assert got[None] == f"assign:2000000:{2000000 + 46},hex:{2000000 + 6}:{2000000 + 46}"
    clean = redact(docs).collect()
    assert len(clean) == len(rows) and {r.kind for r in clean} == {1, 2, 3}


def test_every_token_of_the_labelled_alphabet_is_a_candidate():
    text = f"abcdefgh a.b=c/d1 short password=abcdefgh Zq8xKw2p{HEX40}WJ4kT9mRs7 Xy{HEX40}"
    taken = [(s[0], s[2]) for s in rule_spans(text)]
    assert [v for _, _, v in candidates(text, taken)] == ["abcdefgh", "a.b=c/d1", "Zq8xKw2p", "WJ4kT9mRs7"]
    assert all(text[a:b] == v for a, b, v in candidates(text, taken))


def test_ordinary_tokens_are_learnt_from_whole_texts(spark):
    docs = spark.createDataFrame([(1, " ".join(["the"] * 100 + ["ordinary-\u00e9-token"])), (2, f"token={HEX40}")], "doc_id long, text string")
    assert math.exp(train(docs).ordinary.log_likelihood("ordinary")) > math.exp(Automaton([]).log_likelihood("ordinary"))


def test_query_finds_keyless_values(spark, tmp_path):
    """The registered query over a table whose unlabelled values have no keyword: the spans come from the automata alone."""
    rng = np.random.default_rng(6)
    rows = [(5000 + i, t, "en", "s", 1) for i, t in rows_with_secrets()]  # ordinary words, of which there are most in any corpus
    rows += [(i, f'note token = "{secret(rng)}" and {ORDINARY}', "en", "s", 1) for i in range(120)]
    rows += [(1000 + i, f"{ORDINARY} {secret(rng)} {ORDINARY}", "en", "s", 1) for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op9_secrets(spark, str(tmp_path)).collect()}
    found = [got[i].spans == f"format:{len(ORDINARY) + 1}:{len(ORDINARY) + 29}" for i in range(1000, 1050)]
    assert np.mean(found) >= 0.9 and all(got[i].n_assign == 1 and "format" not in got[i].spans for i in range(120))

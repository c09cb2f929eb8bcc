import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken

from curbline.llm.bpe import chunk_spans, encode_documents

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None, "", " ", "plain words, and more.", "don't we'll\n\n  spaces   \t end  ", "naïve Öl 中文 🙂 12345 x=1;;", "<|endoftext|> stays text",
    "a" * 900, " " * 700 + "x", "word " * 400 + "\n" * 50 + "1 2 3 " * 100, "é🙂ß" * 300, "the end. " * 300, "the end. " * 300,
]


@pytest.mark.parametrize("chunk,overlap", [(1 << 20, 64), (120, 30), (64, 16)])
def test_equals_the_library_and_round_trips(spark, reference, chunk, overlap):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(11, TEXTS[11], "again"), (None, "null id " * 30, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_documents(docs, RANKS, P.PATTERN, chunk=chunk, overlap=overlap).collect())
    want = []
    for i, t, _ in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i if i is not None else -1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_ids_and_bytes(spark, reference):
    docs = spark.createDataFrame([(1, "two words " * 40)], "doc_id long, text string")
    row = encode_documents(docs, RANKS, P.PATTERN, chunk=100, overlap=30, output="ids").first()
    assert row.ids == reference.encode_ordinary("two words " * 40)
    assert bytes(row.decoded) == ("two words " * 40).encode()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert encode_documents(docs, RANKS, P.PATTERN).count() == 0


def test_spans_cover():
    for n in (0, 1, 99, 100, 101, 170, 1000):
        spans = chunk_spans(n, 100, 30)
        assert spans[0][0] == 0 and spans[-1][1] == n
        assert all(b[0] == a[1] - 30 for a, b in zip(spans, spans[1:]))

import public_tokenizers as P
from tests.llm import test_decontam, test_simhash

import corpus_pipeline
from curbline.llm import bpe, lang_id, secrets, simhash

HEX40 = "0123456789abcdef0123456789abcdef01234567"


def test_one_row_of_each_component(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(9, long), (4, long.upper()), (4, long.upper()), (None, long), (7, "other words here"), (7, "different thing altogether now"), (None, "alone"), (None, "alone"), (1, None), (2, "")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    kept = sorted((str(r.doc_id), r.text or "") for r in simhash.keep_one(docs).collect())
    assert kept == sorted([("4", long.upper()), ("7", "other words here"), ("7", "different thing altogether now"), ("None", "alone"), ("1", "")])


def test_against_a_plain_version(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(900, "12345 ??", "en", "x", 8), (901, None, "en", "x", 0), (902, f'the of and to token = "{HEX40}" thing er', "en", "x", 70)], source.schema)
    source.unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    rows = {r.doc_id: r.text for r in docs.collect()}
    model = lang_id.train(docs)
    found = dict(zip(rows, model.documents(list(rows.values()))))
    left = {d: t for d, t in rows.items() if found[d][0] != "und" and found[d][1] >= lang_id.ACCEPT}
    least = {d: c for d, _, c in test_simhash.brute(list(left.items()), corpus_pipeline.RADIUS, corpus_pipeline.SEEDS)}
    left = {d: t for d, t in left.items() if least[str(d)] == d}
    items = [tuple(r) for r in spark.read.parquet(str(tmp_path / "benchmark.parquet")).collect()]
    bad = {r[0] for r in test_decontam.brute(list(left.items()), items)}
    left = {d: t for d, t in left.items() if d not in bad}
    scorer = secrets.train(spark.createDataFrame(list(left.items()), "doc_id long, text string"))
    left = {d: secrets._masked(t, scorer, secrets.THRESHOLD) for d, t in left.items()}
    assert 900 not in got and 901 not in got and 902 in got and len(bad) > 0
    assert set(got) == set(left) and len(got) < len(rows)
    own = bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for d, t in left.items():
        assert got[d] == own.digests(own.encode(t)), d


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns, name

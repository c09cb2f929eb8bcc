import csv
import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from curbline.sources import annotations, archives, documents, gps, sinks


def test_unknown_fields_stay(spark):
    docs = [("a", '{"items":[{"id":"1","status":"new","odd":{"x":[1,null,"y"]},"note":null},{"id":"2","status":"new"}],"other":5}'), ("b", '{"discrepancies":[{"id":"7","n":1.5}]}'), ("c", '{"reviews":{"9":{"decision":"no_sign","z":true}}}')]
    rows = documents.entries(spark.createDataFrame(docs, "doc string, value string"), "doc")
    e = F.col("entry")
    got = {r.id: r for r in rows.select("doc", "kind", "id", documents.state(e, "note").alias("s"), documents.field(e, "n", "double").alias("n"), F.to_json("entry").alias("j")).collect()}
    assert {k: (r.doc, r.kind, r.s) for k, r in got.items()} == {"1": ("a", "items", "null"), "2": ("a", "items", "missing"), "7": ("b", "discrepancies", "missing"), "9": ("c", "reviews", "missing")}
    assert got["7"].n == 1.5 and '"z":true' in got["9"].j
    changed = rows.withColumn("entry", documents.with_fields(e, {"status": F.lit("done \"so\""), "by": F.lit(None).cast("string")}))
    again = documents.entries(documents.rewritten(changed, "doc"), "doc").where("doc = 'a'").orderBy("ord")
    out = again.select(documents.field(e, "status", "string").alias("s"), documents.state(e, "by").alias("by"), F.to_json(F.try_element_at("entry", F.lit("odd"))).alias("odd")).collect()
    assert [tuple(r) for r in out] == [('done "so"', "null", '{"x":[1,null,"y"]}'), ('done "so"', "null", None)]


def test_a_document_of_no_kind_is_an_error(spark):
    with pytest.raises(Exception, match="a report has items"):
        documents.entries(spark.createDataFrame([('{"x":1}',)], "value string")).collect()


def test_one_archive_over_several_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for k in range(40):
            z.writestr(f"labels/{k // 30}/s{k % 30}.txt", f"{k}" * 50)
        z.writestr("images\\one.PNG", b"\x00\xff")
        z.writestr("classes.txt", "no")
        z.writestr("empty/", "")
    with zipfile.ZipFile(tmp_path / "b.zip", "w"):
        pass
    (tmp_path / "not.txt").write_text("x")
    entries = archives.read_entries(spark, str(tmp_path), 500)
    assert entries.rdd.getNumPartitions() > 5 and entries.count() == 42
    got = {(r.kind, r.stem): bytes(r.content) for r in archives.read_archives(spark, str(tmp_path), 500).collect()}
    assert len(got) == 31 and got["label", "s3"] == b"3" * 50 and got["image", "one"] == b"\x00\xff"
    assert archives.read_archives(spark, str(tmp_path / "a.zip")).count() == 31 and archives.read_archives(spark, f"file://{tmp_path}").count() == 31
    plain = annotations.read_archives(spark, str(tmp_path / "a.zip"))
    assert sorted(tuple(r) for r in plain.select("kind", "stem", "content").collect()) == sorted((k, s, c) for (k, s), c in got.items())


def test_first_strategy_with_a_track(spark):
    rows = lambda *x: spark.createDataFrame([(f, float(k), 1.0, 2.0) for f, n in x for k in range(n)], "file string, ts_ms double, lat double, lon double")
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    strategies = [rows(("a", 2), ("b", 1)), rows(("a", 5), ("b", 3), ("c", 1))]
    assert sorted((r.file, r.strategy) for r in gps.choose_tracks(files, strategies, strict=False).collect()) == [("a", 1)] * 2 + [("b", 2)] * 3
    with pytest.raises(Exception, match="no strategy finds a track in c"):
        gps.choose_tracks(files, strategies).collect()


def test_reannotation_is_quoted(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Curves", 1.5, None, 'a "b", c\nd')], "cluster_id int, sign_class string, lat double, lon double, note string")
    sinks.write_csv(sinks.reannotation(rows, "v.mp4"), str(tmp_path / "out"), single=True)
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert list(csv.reader(io.StringIO(text))) == [list(sinks.REANNOTATION), ["1", "Curves", "1.5", "", 'a "b", c\nd', "v.mp4"]] and '"a ""b"", c\nd"' in text


def test_a_range_reads_its_own_part_of_the_directory(spark, tmp_path, monkeypatch):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(300):
            z.writestr(f"labels/s{k}.txt", f"{k}" * 20)
    (tmp_path / "a.zip").write_bytes(b"before" + held.getvalue())  # an archive need not begin its file
    reader = archives.ZipReader({"path": str(tmp_path), "rangebytes": "600"})
    parts = reader.partitions()
    seen = []
    plain = zipfile.ZipFile.infolist
    monkeypatch.setattr(zipfile.ZipFile, "infolist", lambda z: seen.append(len(plain(z))) or plain(z))
    rows = [r for p in parts for r in reader.read(p)]
    assert len(parts) > 20 and sum(seen) == 300  # before, every range read the whole directory
    assert [(r[1], r[2], r[4]) for r in rows] == [(k, f"labels/s{k}.txt", f"{k}".encode() * 20) for k in range(300)]


def test_entries_go_on_in_batches():
    class Held:
        def select(self, *_):
            return self

        def mapInPandas(self, f, _):  # noqa: N802
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                for k in range(1200):
                    z.writestr(f"labels/s{k}.txt", "x")
            return [len(x) for x in f(iter([pd.DataFrame({"path": ["a.zip"], "content": [held.getvalue()]})]))]

    assert annotations.open_archives(Held()) == [500, 500, 200]

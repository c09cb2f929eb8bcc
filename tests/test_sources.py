import json
import zipfile

import pytest
from pyspark.sql import functions as F

from curbline.sources import annotations, geojson, gps, sinks


def test_captions(spark, tmp_path):
    blocks = "\n\n".join(f"{i}\n00:00:0{i},000 --> 00:00:0{i},500\nGPS({38.123434 + i * 22e-6:.6f}, -81.234567, 245)" for i in (2, 1, 3)) + "\n\n4\n00:00:04,000 --> x\nGPS(0.0, 0.0)\n\n5\n00:00:05,000 --> x\nGPS: 91.5, 1.5\n\n6\n00:00:06.000 --> x\nlat=38.5 \n lon=-81.5"
    (tmp_path / "a.srt").write_text(blocks)
    got = [(r.ts_ms, round(r.lat, 6), r.alt) for r in gps.read_sidecar(spark, str(tmp_path / "a.srt")).orderBy("ts_ms").collect()]
    assert got == [(1000.0, 38.123456, 245.0), (2000.0, 38.123478, 245.0), (3000.0, 38.1235, 245.0), (6000.0, 38.5, None)]


def test_csv(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Timestamp, Latitude ,Lng,altitude\n0,38.1,81.0,200\n1000,38.2,-81.1,n/a\nx,1,1,1\n5,0,0,1\n")
    got = [tuple(r)[1:5] for r in gps.read_sidecar(spark, str(tmp_path / "b.csv")).orderBy("ts_ms").collect()]
    assert got == [(0.0, 38.1, 81.0, 200.0), (1_000_000.0, 38.2, -81.1, None)]
    (tmp_path / "c.csv").write_text("time,lat,lon\n2024-03-15T10:00:00,38.1,81.0\n2024-03-15 10:00:01,38.1,81.0\n")
    assert [r.ts_ms for r in gps.read_csv(spark, str(tmp_path / "c.csv")).orderBy("ts_ms").collect()] == [0.0, 1000.0]
    (tmp_path / "d.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        gps.read_sidecar(spark, str(tmp_path / "d.csv"))


def test_metadata_csv(spark, tmp_path):
    head = "sample_time,gps_latitude,gps_longitude,gps_altitude,gps_timestamp\n"
    (tmp_path / "e.csv").write_text(head + "0.5 s,39.28 N,80.96 W,273.3 m Above Sea Level,2024:03:15 10:00:00\n,39.28,-80.96,,2024:03:15 10:00:02\n")
    (tmp_path / "f.csv").write_text(head + ",39.28 N,80.96 W,,2024:03:15 10:00:01\n,39.29 N,80.96 W,,2024:03:15 10:00:00\n")
    assert [tuple(r)[1:5] for r in gps.read_sidecar(spark, str(tmp_path / "e.csv")).collect()] == [(500.0, 39.28, -80.96, 273.3)]
    assert [r.ts_ms for r in gps.read_sidecar(spark, str(tmp_path / "f.csv")).orderBy("ord").collect()] == [0.0, -1000.0]


def test_gpx(spark, tmp_path):
    pts = "".join(f'<trkpt lat="38.{i}" lon="-81.5"><ele>2{i}</ele><time>2024-03-15T10:00:0{i}Z</time></trkpt>' for i in (2, 1))
    (tmp_path / "g.gpx").write_text(f"<gpx><trk><trkseg>{pts}</trkseg></trk></gpx>")
    assert [(r.ts_ms, r.lat, r.alt) for r in gps.read_sidecar(spark, str(tmp_path / "g.gpx")).orderBy("ts_ms").collect()] == [(0.0, 38.1, 21.0), (1000.0, 38.2, 22.0)]


def test_geojson_round_trip(spark, tmp_path):
    fc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [-81.2, 38.1]}, "properties": {"OBJECTID": 7, "MUTCDCODE": "W10-1", "MUTCDCAT": "", "sign_class": "Old"}}]}
    (tmp_path / "inv").mkdir()
    (tmp_path / "inv" / "x.geojson").write_text(json.dumps(fc, indent=1))
    row = geojson.read_inventory(spark, str(tmp_path / "inv")).first()
    assert (row.inv_id, row.inv_lat, row.inv_lon, row.inv_class, row.inventory_source) == ("7", 38.1, -81.2, "Curves", "x.geojson")
    assert geojson.read_inventory(spark, str(tmp_path / "inv"), overwrite=False).first().inv_class == "Old"
    clusters = spark.createDataFrame([(1, "Regulatory", 38.5, -81.5, None), (2, "Curves", None, None, None)], "cluster_id long, sign_class string, lat_median double, lon_median double, note string")
    doc = json.loads(geojson.collection(clusters).first().value)
    assert doc["features"] == [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [-81.5, 38.5]}, "properties": {"cluster_id": 1, "sign_class": "Informational/Regulatory", "note": None}}]
    geojson.write_lines(clusters, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1


def test_labels_and_annotations(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "v_1.txt").write_text("0 .5 .5 .2 .4\n\nx 1 2\n3 .1 .2 .3 .4 .9\n")
    got = [(r.stem, r.line_no, r.n_fields, r.class_idx, r.w) for r in annotations.read_labels(spark, str(tmp_path / "l")).orderBy("line_no").collect()]
    assert got == [("v_1", 0, 5, 0, 0.2), ("v_1", 2, 3, None, None), ("v_1", 3, 6, 3, 0.3)]
    (tmp_path / "a.csv").write_text("Filename;Tag;x1;y1;x2;y2;other\na.png;stop;1;2;3;4;z\n")
    assert [tuple(r) for r in annotations.read_semicolon_boxes(spark, str(tmp_path / "a.csv")).collect()] == [("a.png", "stop", 1, 2, 3, 4)]
    (tmp_path / "c.txt").write_text("warning: dip, merge, dip\nnone\nspeed: s25\n")
    assert [(r.name, r.category) for r in annotations.read_categories(spark, str(tmp_path / "c.txt")).orderBy("ord").collect()] == [("warning", "dip"), ("warning", "merge"), ("speed", "s25")]
    obj = lambda label, **p: {"label": label, "bbox": {"xmin": 1, "ymin": 2, "xmax": 3, "ymax": 4}, "properties": p}
    (tmp_path / "o.json").write_text(json.dumps({"width": 10, "height": 20, "objects": [obj("a", occluded=False), obj("b", occluded=True), obj("c", **{"out-of-frame": True})]}, indent=1))
    assert [(r.stem, r.label, r.xmax) for r in annotations.read_object_json(spark, str(tmp_path / "o.json")).collect()] == [("o", "a", 3.0)]


def test_archives_lists_and_configs(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        for name, text in (("labels/a.txt", "1"), ("other/a.txt", "2"), ("classes.txt", "no"), ("images/a.jpg", "img"), ("labels/b.txt", "")):
            z.writestr(name, text)
    got = sorted((r.kind, r.stem, bytes(r.content)) for r in annotations.read_archives(spark, str(tmp_path / "r.zip")).collect())
    assert got == [("image", "a", b"img"), ("label", "a", b"1"), ("label", "b", b"")]
    (tmp_path / "i1.csv").write_text("video_id,x\n1,a\n2,b\n")
    (tmp_path / "i2.csv").write_text("id,x\n2,a\n3,b\n")
    assert sorted(r.video_id for r in annotations.read_ids(spark, [str(tmp_path / n) for n in ("i1.csv", "none.csv", "i2.csv")]).collect()) == ["1", "2", "3"]
    (tmp_path / "s.txt").write_text("a\n\n b \n")
    names = annotations.read_lines(spark, str(tmp_path / "s.txt"))
    images = spark.createDataFrame([("a",), ("z",)], "stem string")
    assert {tuple(r) for r in annotations.with_split(images, {"val": names}).collect()} == {("a", "val"), ("z", "train")}
    files = spark.createDataFrame([("/p/a.jpg", 1), ("/q/a.png", 2)], "path string, ord int")
    assert annotations.image_index(files).first().path == "/q/a.png"
    (tmp_path / "d.yaml").write_text(sinks.dataset_yaml("/data", "train/images", "val/images", ["x", "y"]))
    assert annotations.dataset_config(str(tmp_path / "d.yaml")) == {"names": ["x", "y"], "nc": 2, "splits": {"train": {"images": "/data/train/images", "labels": "/data/train/labels"}, "val": {"images": "/data/val/images", "labels": "/data/val/labels"}}}


def test_rounds(spark):
    rows = [(1, "background", "a", True, 0), (1, "annotated", "a", True, 1), (2, "annotated", "a", True, 2), (2, "background", "b", True, 3), (1, "annotated", "c", False, 4), (2, "annotated", "c", True, 5)]
    rounds = spark.createDataFrame(rows, "round int, kind string, stem string, has_image boolean, ord int")
    seen = spark.createDataFrame([("b",)], "value string")
    kept = annotations.merge_rounds(rounds, seen, 2)
    assert {(r.stem, r["round"], r.kind) for r in kept.collect()} == {("a", 1, "annotated"), ("c", 2, "annotated")}
    s = {r["round"]: r for r in annotations.round_summary(rounds, kept).collect()}
    assert (s[1].rows, s[1].label_without_image, s[1].annotated_kept, s[1].repeats) == (3, 1, 1, 1)


def test_sinks(spark, tmp_path):
    boxes = spark.createDataFrame([("s", 1, 0, 0.5, 0.5, 0.2, 0.4), ("s", 0, 2, 0.5, 0.5, 0.1, 0.1)], "stem string, line_no int, class_idx int, cx double, cy double, w double, h double")
    assert sinks.label_text(boxes).first().text == "2 0.500000 0.500000 0.100000 0.100000\n0 0.500000 0.500000 0.200000 0.400000"
    sinks.write_label_folder(boxes, str(tmp_path / "labels"))
    images = spark.createDataFrame([("s", "s.jpg", 100, 50)], "stem string, file_name string, width int, height int")
    img, ann, cats = sinks.coco(images, boxes, ["a", "b"])
    assert [(r.id, r.category_id, r.bbox, r.area) for r in ann.orderBy("id").collect()][1] == (2, 1, [40.0, 15.0, 20.0, 20.0], 400.0)
    assert [r.category_id for r in sinks.invalid_categories(ann, cats).collect()] == [3]
    preds = spark.createDataFrame([("s.jpg", 1, "a", 0.9, (0.1, 0.2, 0.3, 0.6))], "file_name string, idx int, class_name string, conf double, box struct<x1:double,y1:double,x2:double,y2:double>")
    task = json.loads(sinks.prediction_tasks(preds).first().value)
    assert task["predictions"][0]["result"][0]["value"]["rectanglelabels"] == ["a"] and abs(task["predictions"][0]["result"][0]["value"]["height"] - 40) < 1e-9
    doc = json.loads(sinks.report(boxes.select("stem", "line_no"), {"video_source": "v"}).first().value)
    assert doc["total"] == 2 and doc["video_source"] == "v" and sinks.sniff_report(json.dumps(doc)) == "items"
    reviews = spark.createDataFrame([(1, "approved", None), (2, "no_sign", "n")], "cluster_id long, decision string, note string")
    out = json.loads(sinks.reviews_export(reviews, spark.createDataFrame([], "original_class string, n long"), {"video_source": "v"}).first().value)
    assert out["false_positives"] == [2] and "wrong_class_summary" not in out and out["reviews"]["1"]["decision"] == "approved"
    assert sinks.markdown(reviews.orderBy("cluster_id").select("cluster_id", "note")) == "| cluster_id | note |\n|---|---|\n| 1 |  |\n| 2 | n |"
    sinks.write_csv(spark.createDataFrame([('a "q", b', 1)], "t string, n int"), str(tmp_path / "csv"), single=True)
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').first().t == 'a "q", b'
    local = spark.createDataFrame([("k", bytearray(b"x")), ("m", bytearray(b"y"))], "key string, content binary")
    remote = local.limit(2).where("key = 'k'").select("key", F.md5("content").alias("md5"))
    assert [r.key for r in sinks.to_upload(local, remote).collect()] == ["m"]
    assert "curl" in sinks.download_script(spark.createDataFrame([("https://example.com/o/it's", "it's")], "url string, filename string")).first().value


def test_clusters_rules_and_routes(spark, tmp_path):
    from curbline.sources import synthetic

    (tmp_path / "w.csv").write_text("frame_stem,cluster_id,split,keep,targeted_classes\na_1,v_c0,train,True,1|3\nb_2,v_c1,val,False,\n")
    got = {r.frame_stem: (r.keep, r.targeted_classes) for r in annotations.read_clusters(spark, str(tmp_path / "w.csv")).collect()}
    assert got == {"a_1": (True, ["1", "3"]), "b_2": (False, [])}
    (tmp_path / "p.yaml").write_text('rules:\n  - {prefix: "a--", class: 0}\n  - {prefix: "b--", class: 1}\n')
    assert annotations.prefix_rules(str(tmp_path / "p.yaml")) == [("a--", 0), ("b--", 1)]
    line = spark.createDataFrame([(1, 0, 38.0, -81.0), (1, 1, 38.0, -80.9)], "line_id int, ord int, lat double, lon double")
    rows = synthetic.route(line, 50, ["A", "B"]).collect()
    assert len(rows) == 50 and {r.class_name for r in rows} == {"A", "B"} and all(-81.001 < r.lon < -80.899 for r in rows)
    again = synthetic.route(line.repartition(5), 50, ["A", "B"]).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))

import hashlib

from curbline.llm.warc import audit


def record(url, html):
    html = html or ""
    return f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: {url or ''}\r\nContent-Length: {len(html.encode())}\r\n\r\n{html}\r\n\r\n".encode()


def test_finds_every_difference(spark):
    rows = [(i * 7, f"u{i}", f"<p>é {i}</p>" * (i % 5), 1) for i in range(300)]
    other = [r for r in rows if r[0] != 70]
    other[20] = (*other[20][:2], other[20][2] + "x", 1)
    other.append((5000, "new", "page", 1))
    schema = "page_id long, url string, html string, node int"
    got = {r.page_id: r for r in audit(spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)).collect()}
    start = {}
    at = 0
    for r in rows:
        start[r[0]] = (at, at + len(record(*r[1:3])))
        at = start[r[0]][1]
    assert {k: r.status for k, r in got.items()} == {70: "missing", other[20][0]: "corrupt", 5000: "extra"}
    for k in (70, other[20][0]):
        assert (got[k].start, got[k].end) == start[k]
    assert got[70].primary_digest == hashlib.sha256(record("u10", rows[10][2])).hexdigest() and got[70].replica_digest is None
    assert got[5000].start is None


def test_nulls_repeats_and_empty(spark):
    schema = "page_id long, url string, html string"
    a = [(None, "u", "x"), (None, None, None), (-3, "a", "b"), (4, "u", None), (4, "u", None), (4, "v", "w")]
    one = spark.createDataFrame(a, schema)
    assert audit(one, spark.createDataFrame(a[::-1], schema)).count() == 0
    got = audit(one, spark.createDataFrame([(None, "u", "y"), *a[1:5]], schema)).collect()
    assert {(r.page_id, r.status) for r in got} == {(None, "corrupt"), (4, "corrupt")}
    assert audit(one.limit(0), one.limit(0)).count() == 0
    assert audit(one.limit(0), one).count() == 3


def test_extreme_ids_and_a_very_long_page(spark):
    schema = "page_id long, url string, html string, up long"
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(low, "a", "x", 1), (low + 1, "b", None, 1), (-1, "c", "y", 1), (0, "d", "z" * 3_000_000, 1), (high - 1, "e", "", 1), (high, "f", "w", 1), (None, "g", "v", 1)]
    other = [(*r[:2], (r[2] or "") + "!" * (r[0] in (low, 0, high, None)), 2) for r in rows]
    got = audit(spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)).collect()
    assert {r.page_id for r in got} == {low, 0, high, None} and {r.status for r in got} == {"corrupt"}
    at, start = 0, {}
    for r in rows:
        start[r[0]], at = (at, at + len(record(*r[1:3]))), at + len(record(*r[1:3]))
    assert {r.page_id: (r.start, r.end) for r in got} == {k: start[k] for k in (low, 0, high, None)}
    two = [r for r in rows if r[0] in (high, None)]
    got = audit(spark.createDataFrame(two, schema), spark.createDataFrame(two[:1], schema)).collect()
    assert [(r.page_id, r.status) for r in got] == [(None, "missing")]

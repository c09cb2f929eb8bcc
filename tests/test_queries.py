"""Registered queries against their SQL, on the smallest of the given tables; passed over where those are not there."""

import glob
import math
import os

import duckdb
import pytest

from curbline.plans import choices, curation, extras, files, live, scale

DATA = os.environ.get("QUERY_TEST_DATA", "/root/testdata/sf0.001")
CASES = [(n, m.QUERIES[n], m.ORACLES[n]) for m in (files, choices, live, extras, scale) for n in m.QUERIES if n in m.ORACLES]
CASES += [(n, curation.QUERIES[n], curation.ORACLES[n]) for n in ("greedy_match", "ap50", "coarse_mean_ap", "recall_by_bucket", "uncovered_truth", "frames_by_road_type", "stratified_split", "cluster_split")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name,query,sql", CASES, ids=[c[0] for c in CASES])
def test_query_equals_its_sql(spark, duck, name, query, sql):
    found = query(spark, DATA)
    columns = sorted(found.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=str)
    rel = duck.execute(sql)
    names = [c[0] for c in rel.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=str)
    assert got == want

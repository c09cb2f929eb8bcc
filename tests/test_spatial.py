import numpy as np
from pyspark.sql import functions as F

from curbline.functions import geo
from curbline.operators import spatial


def test_pairs_of_all_latitudes_and_across_the_date_line(spark):
    rng, rows = np.random.default_rng(3), []
    for lat in (-89.9995, -85.0, 0.0, 38.3, 80.0, 88.0, 90.0):
        for lon in (-180.0, 12.0, 179.9999):
            spread = 60 / 111195 / max(np.cos(np.radians(lat)), 1e-3)
            rows += [(float(min(max(lat + a * 60 / 111195, -90), 90)), float((lon + b * spread + 180) % 360 - 180)) for a, b in rng.uniform(-1, 1, (9, 2))]
    left = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "a int, lat double, lon double")
    right = left.toDF("b", "r_lat", "r_lon")
    far = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    want = sorted((r.a, r.b) for r in left.crossJoin(right).where(far <= 60).collect())
    assert sorted((r.a, r.b) for r in spatial.within(left, right, 60.0).collect()) == want

from pyspark.sql import functions as F

from curbline.functions.text import stable_order
from curbline.operators import sample


def test_first_by_counting_is_first_by_rank(spark):
    rows = spark.range(6000).select("id", (F.col("id") % 10 > 0).cast("string").alias("g"), F.when(F.col("id") % 7 > 0, "x").alias("null_too"), (F.col("id") % 3).alias("early"))
    for by, most, ahead in ((("g",), 40, None), (("g", "null_too"), 700, None), (("g",), 100_000, None), (("g",), 0, None), (("g",), 333, F.col("early"))):
        one, other = (sorted(r.id for r in sample.first_by_chance(rows, "id", by, most, ahead=ahead, long=n).collect()) for n in (0, 10**9))
        assert one == other
        assert len(one) <= most * rows.select(*by).distinct().count()
    budget = F.when(F.col("g") == "true", 50).otherwise(7)
    got = sample.first_by_chance(rows, "id", ("g",), budget, long=0)
    assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == {"true": 50, "false": 7}
    hashes = rows.where("g = 'true'").select("id", stable_order(42, F.col("id")).alias("h")).orderBy("h").limit(50).collect()
    assert {r.id for r in hashes} == {r.id for r in got.where("g = 'true'").collect()}


def test_a_group_is_not_ranked_whole(spark):
    rows = spark.range(1000).select("id", F.lit("a").alias("g"))
    plan = sample.first_by_chance(rows, "id", ("g",), 10, long=0)._jdf.queryExecution().optimizedPlan().toString()
    ranked = [x for x in plan.splitlines() if "row_number()" in x]
    assert ranked and all("_range" in x for x in ranked if x.lstrip(" +-:").startswith("Window"))


def test_classes_share_their_counties(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3], float(i * 37 % 50)) for i in range(60)], "id long, county string, size double")
    scores = {"one": F.col("size"), "two": -F.col("size"), "three": F.col("id") % 11}
    budgets, cap = {"one": 4, "two": 5, "three": 9}, 5
    got = [tuple(r) for r in sample.select_for_classes(rows, scores, budgets, "id", "county", cap).select("target_class", "id").collect()]
    data, used, taken, want = rows.collect(), {}, set(), []
    keys = {"one": lambda r: r.size, "two": lambda r: -r.size, "three": lambda r: r.id % 11}
    for cls, n in budgets.items():
        for r in sorted((r for r in data if r.id not in taken), key=lambda r: (-keys[cls](r), r.id)):
            if n and used.get(r.county, 0) < cap:
                used[r.county] = used.get(r.county, 0) + 1
                taken.add(r.id)
                want.append((cls, r.id))
                n -= 1
    assert sorted(got) == sorted(want)


def test_budgets_of_a_table(spark):
    shares = {"a": 0.33, "b": 0.29, "c": 0.25, "d": 0.125, "e": 0.001}
    df = spark.createDataFrame(list(shares.items()), "cls string, share double")
    assert {r.cls: r.budget for r in sample.budgets_by_share(df, "cls", F.col("share"), 77).collect()} == sample.class_budgets(shares, 77)

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curbline.llm.simhash import fingerprint, keep_one, links, near_duplicates, pair_links
from curbline.operators.skew import join_uneven


def plain_fingerprint(text, seed=0):
    words = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [plain_remix(xxhash.xxh64_intdigest(s, seed=42), seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


MASK = (1 << 64) - 1


def plain_remix(x, seed):
    if not seed:
        return x
    x = (x + seed * 0x9E3779B97F4A7C15) & MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def brute(rows, radius=4, seeds=1):
    fps = [plain_fingerprint(t) for _, t in rows]
    every = [[plain_fingerprint(t, k) for k in range(seeds)] for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if any(bin(x ^ y).count("1") <= radius for x, y in zip(every[i], every[j], strict=True)):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows))


@given(st.text(max_size=60))
@settings(max_examples=60, deadline=None)
def test_fingerprint(text):
    text = text.encode("utf-8", "ignore").decode()
    assert fingerprint(text) == plain_fingerprint(text)


def test_bit_sliced_distances():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 70, dtype=np.uint64)
    values = np.concatenate([base, base ^ np.uint64(0b10011), base ^ np.uint64(0x8000000000000FF0)])
    got = {(k, int(j)) for k, found in pair_links(values, values, 4) for j in found}
    want = {(i, j) for i, a in enumerate(values.tolist()) for j, b in enumerate(values.tolist()) if bin(a ^ b).count("1") <= 4}
    assert got == want


def test_components_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words, 120)) for _ in range(25)]
    rows = []
    for i in range(220):
        own = base[int(rng.integers(25))].split()
        for _ in range(int(rng.integers(0, 5))):
            own[int(rng.integers(len(own)))] = str(rng.choice(words))
        rows.append((1000 - i, " ".join(own)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (None, "no id"), (7, "Short"), (8, "sHORT"), (9, "ÉCOLE"), (10, "école"), (8, "sHORT")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in near_duplicates(docs).collect())
    assert got == brute(rows)


def test_dense_bucket_is_tiled(spark):
    from pyspark.sql import functions as F

    from curbline.llm.simhash import links
    from curbline.operators.components import connected_components

    rng = np.random.default_rng(6)
    values = sorted({int(np.uint64(1 << 40) ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b))) for a, b in rng.integers(0, 62, (300, 2))})
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    parts = connected_components(links(fps, tile=16)).agg(F.countDistinct("component"), F.count("*")).first()
    assert tuple(parts) == (1, len(values))


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert keep_one(spark.createDataFrame([], "doc_id long, text string"), seeds=3).count() == 0


def test_keep_one_keeps_all_columns_and_one_row_a_component(spark):
    """Columns named like those used inside come through; repeated rows and null ids have a defined result."""
    long = "word " * 300_000
    rows = [(3, "a b c d e", 1), (2, "A b c d e", 2), (2, "A b c d e", 2), (None, "a b c d e", 3), (None, "alone here now", 4), (None, "alone here now", 4), (9, None, 5), (8, "", 6), (7, long, 7), (6, long, 8)]
    names = ["_id", "_other", "_hash", "_copy", "_at", "_row", "_own", "_won", "fp", "first"]
    docs = spark.createDataFrame([(i, t, *[x] * len(names)) for i, t, x in rows], ["doc_id", "text", *names])
    for seeds in (1, 3):
        got = keep_one(docs, seeds=seeds)
        assert got.columns == docs.columns
        assert sorted((str(r.doc_id), r.fp, r["_copy"]) for r in got.collect()) == [("2", 2, 2), ("6", 8, 8), ("8", 6, 6), ("None", 4, 4)]


def test_more_seeds_link_more_near_copies_and_no_others(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(60):
        base = list(rng.choice(words, 100))
        rows.append((g, " ".join(base)))
        for k in range(2):
            own = list(base)
            own[int(rng.integers(100))] = "changed"
            rows.append((1000 + 2 * g + k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [{r.doc_id for r in keep_one(docs, radius=5, seeds=n).collect()} for n in (1, 5)]
    assert all(set(range(60)) <= k for k in kept)
    assert len(kept[1]) <= len(kept[0]) and len(kept[1]) - 60 <= 6


def test_hot_component(spark):
    """A third of all rows are near copies of one text."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(2000)]
    base, rows = list(rng.choice(words, 150)), []
    for i in range(900):
        own = list(base) if i % 3 == 0 else list(rng.choice(words, 150))
        own[i % 150] = "x"
        rows.append((i, " ".join(own)))
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_tiles_of_near_copies_give_few_edges(spark):
    """All values lie within four bits of one another: under a key, tiles meet in pairs, but only one edge a pair joins them."""
    values = [(1 << a) | (1 << b) for a in range(24) for b in range(a)]
    fps = spark.createDataFrame([(v,) for v in values], "fp long").coalesce(1)
    edges = links(fps, blocks=6, tile=16).collect()
    parent = {v: v for v in values}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        assert bin(a ^ b).count("1") <= 4
        parent[find(a)] = find(b)
    assert len({find(v) for v in values}) == 1
    keys = 15  # choices of 4 blocks of 6
    assert len(edges) < keys * (len(values) + (len(values) // 16 + 1) ** 2 / 2)


def test_only_heavy_keys_are_broadcast(spark):
    left = spark.range(2000).select(F.col("id") % 50, "id").toDF("key", "id")
    right = left.groupBy("key").agg(F.count("*").alias("n"))
    plan = join_uneven(left, right, "key", "n", 2000)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan  # the rows of light keys, however small the table


def test_small_tables_are_kept_in_few_files(spark, monkeypatch):
    """Many shuffle partitions that Spark leaves as they are: each would be a file of every checkpoint, and of the result."""
    from curbline.llm import simhash
    from curbline.operators import components

    parts = []
    for module in (simhash, components):
        monkeypatch.setattr(module, "cut", lambda *a, f=module.cut: (parts.append((out := f(*a)).rdd.getNumPartitions()), out)[1])
    rows = [(i, f"common words of text {i % 40} and some more of {i % 7}") for i in range(120)]
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        parts.append(found.rdd.getNumPartitions())
        got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in found.collect())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == brute(rows)
    assert len(parts) > 5 and max(parts) <= spark.sparkContext.defaultParallelism


def test_many_rows_keep_their_partitions(spark, monkeypatch):
    from curbline.plans import session

    monkeypatch.setattr(session, "FILE_ROWS", 10)
    assert session.cut(spark.range(200).repartition(16), 200).rdd.getNumPartitions() == 16
    assert session.cut(spark.range(200).repartition(16)).rdd.getNumPartitions() == 16
    assert session.cut(spark.range(200).repartition(16), 60).rdd.getNumPartitions() == 6

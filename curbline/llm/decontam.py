"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly. DataFrame operations only.

Items are partitioned by their number of distinct shingles. An item's MinHash sketch is the m shingles with the least hash
values, where m comes from its partition's largest size u: m = u - ceil(t u) + 1. A document that holds a share t of an
item's shingles can miss at most m - 1 of them, so it holds one of any m: looking the documents' shingle hashes up among
the sketches finds every contained item, however long the document, and verification compares the shingles themselves.

The sketches are broadcast only if they are counted to be at most BROADCAST_ROWS; else the same join shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
THRESHOLD = 0.8
BROADCAST_ROWS = 500_000
#: Copies of each sketch row beyond that.
SALTS = 32


def _spaced(text: Column) -> Column:
    return F.translate(F.lower(text), "\t\n\x0b\x0c\r", "     ")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(_spaced(text), " "), "")


def _hash(width: int) -> Column:
    """The hash of the width words from place i on."""
    return F.xxhash64(F.lit(width), *(F.get("words", F.col("i") + k) for k in range(width)))


def shingle_rows(rows: DataFrame, widths: list[int]) -> DataFrame:
    """A row for each place and width of neighbouring words that fit there: the other columns, i, width and h, the words' hash. The explode is of
    places only, so the words are read from the row's one array by generated code."""
    rest = [F.col(c) for c in rows.columns]
    least = min(widths)
    places = F.when(F.size("words") >= least, F.sequence(F.lit(0), F.size("words") - least)).otherwise(F.array().cast("array<int>"))
    placed = rows.select(*rest, F.explode(places).alias("i"))
    if len(widths) == 1:
        return placed.select(*rest, "i", F.lit(least).alias("width"), _hash(least).alias("h"))
    fits = [F.when(F.col("i") + w <= F.size("words"), F.struct(F.lit(w).alias("width"), _hash(w).alias("h"))) for w in widths]
    return placed.select(*rest, "i", F.explode(F.array_compact(F.array(*fits))).alias("x")).select(*rest, "i", "x.width", "x.h")


def item_shingles(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, shingle, h, n): the distinct shingles of each item, of SHINGLE words; a shorter item is one shingle of all its words."""
    words = items.select(F.col(item_id).alias("item_id"), _words(F.col(text).cast("string")).alias("words"))
    rows = shingle_rows(words, list(range(1, SHINGLE + 1))).where(F.col("width") == F.least(F.size("words"), F.lit(SHINGLE)))
    rows = rows.select("item_id", F.array_join(F.slice("words", F.col("i") + 1, F.col("width")), " ").alias("shingle"), "h").distinct()
    sizes = rows.groupBy("item_id").agg(F.count("*").alias("n"))
    return rows.join(sizes, "item_id")


def sketches(shingles: DataFrame, threshold: float) -> DataFrame:
    """(item_id, h): each item's least hashes, as many as its size partition asks for."""
    upper = F.pow(F.lit(2.0), F.ceil(F.log2("n")))
    m = F.least(F.col("n"), (upper - F.ceil(upper * threshold - 1e-9) + 1).cast("long"))
    lists = shingles.groupBy("item_id", "n").agg(F.sort_array(F.collect_set("h")).alias("hs"))  # bounded: one item's shingles
    return lists.select("item_id", F.explode(F.slice("hs", F.lit(1), m.cast("int"))).alias("h"))


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                    item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) for every document that holds a share of at least threshold of an item.

    Words are lower-cased runs without ASCII white space; shingles have five words. An item of one to four words is a single
    shingle of all its words; an item without words is in nothing. Null and empty texts hold nothing. Rows that repeat id and
    text give one row; a null id is a value like any other. Repeated rows of one item_id count as one item with the shingles of all.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    widths = [r.w for r in items.select(F.least(F.size(_words(F.col(item_text).cast("string"))), F.lit(SHINGLE)).alias("w")).where("w > 0").distinct().collect()]  # at most 5
    every = item_shingles(items, item_id, item_text)
    sketch = sketches(every, threshold)
    hashed = shingle_rows(rows.select("doc_id", F.xxhash64("text").alias("th"), _words(F.col("text")).alias("words")), sorted(widths) or [SHINGLE])
    hashed = hashed.select("doc_id", "th", "h")
    if sketch.count() <= BROADCAST_ROWS:
        found = hashed.join(F.broadcast(sketch), "h")
    else:  # a shingle that very many documents hold is dealt by document too
        hashed = hashed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALTS)))
        found = hashed.join(sketch.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["h", "salt"])
    pairs = found.select("doc_id", "th", "item_id").distinct()
    whole = every.groupBy("item_id").agg(F.collect_set("shingle").alias("shingles"))  # bounded: one item's shingles
    bodies = rows.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), "text")
    held = pairs.join(bodies, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).join(whole, "item_id")
    body = F.concat(F.lit(" "), F.array_join(_words(F.col("text")), " "), F.lit(" "))
    # the explode keeps the optimiser from computing the body anew for every shingle
    asked = held.select("doc_id", "th", "item_id", body.alias("body"), "shingles").select("doc_id", "th", "item_id", "body", F.explode("shingles").alias("s"))
    found = F.contains(F.col("body"), F.concat(F.lit(" "), F.col("s"), F.lit(" ")))
    held = asked.groupBy("doc_id", "th", "item_id").agg(F.count("*").alias("n_shingles"), F.count_if(found).alias("n_found"))
    held = held.where(F.col("n_found") >= threshold * F.col("n_shingles") - 1e-9).select("doc_id", "item_id", "n_shingles", "n_found").distinct()
    return held.withColumn("containment", F.round(F.col("n_found") / F.col("n_shingles"), 6))


def remove_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose id holds an item; every other row and all columns, whatever their names, stay. Null ids are an id like
    any other, null and empty texts hold nothing, repeated rows go or stay together; an empty table stays empty."""
    other = "_" * (1 + max(map(len, docs.columns)))  # a name that docs can't have
    bad = contained_items(docs, items, threshold=threshold).select(F.col("doc_id").alias(other)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[other]), "left_anti")


ORACLE = r"""
WITH i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x09-\x0D\x20]+'), lambda w: w <> '') AS w FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k : k + 4], ' '))) AS shingle FROM i WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_shingles FROM s GROUP BY item_id),
d AS (SELECT DISTINCT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[\x09-\x0D\x20]+'), lambda w: w <> ''), ' ') || ' ' AS body FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, item_id, count(*) AS n_found FROM d JOIN s ON contains(body, ' ' || shingle || ' ') GROUP BY doc_id, item_id, body)
SELECT DISTINCT doc_id, item_id, n_shingles, n_found, round(n_found / n_shingles, 6) AS containment
FROM f JOIN n USING (item_id) WHERE n_found >= 0.8 * n_shingles - 1e-9
"""

"""WARC fixity audit with Merkle trees.

Pages are taken as WARC resource records in the order of their ids, which gives each record a byte range of the archive.
A tree's leaf is a record's SHA-256; an inner node covers the byte range of the ids that share all but the last bits and
hashes its at most FANOUT children in order with their lengths. Two replicas are compared from the root; below that only the
children of nodes that differ are joined, level by level, down to the records. Nodes are made by aggregation on the id, so no
task sees more than FANOUT children, and each level is written to the shared checkpoint folder once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from curbline.plans.session import cut

BITS = 4
FANOUT = 1 << BITS


def record_text(uri: Column, body: Column) -> Column:
    """A WARC/1.1 resource record as text; a null address or body counts as empty."""
    uri, body = F.coalesce(uri, F.lit("")), F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), uri, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, record_id: str = "page_id", uri: str = "url", body: str = "html") -> DataFrame:
    """(id, bytes, digest) with one row an id.

    Rows that repeat an id are one record: their number, their summed length, and the digest of their digests' sums,
    whatever their order. Rows without an id are one record with a null id.
    """
    text = record_text(F.col(uri).cast("string"), F.col(body).cast("string"))
    rows = pages.select(F.col(record_id).cast("long").alias("id"), F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("digest"))
    limbs = [F.sum(F.conv(F.substring("digest", 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(4)]
    sums = rows.groupBy("id").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("digest").alias("one"), *limbs)
    many = F.sha2(F.concat_ws("|", "n", *(f"s{i}" for i in range(4))), 256)
    return sums.select("id", "bytes", F.when(F.col("n") == 1, F.col("one")).otherwise(many).alias("digest"))


def tree(leaves: DataFrame, height: int) -> list[DataFrame]:
    """Levels of (node, bytes, digest) from the records, level 0, to the root, level height. The record without an id has null nodes."""
    levels = [cut(leaves.select(F.col("id").alias("node"), "bytes", "digest"))]
    for k in range(height):
        up = F.shiftright("node", BITS) if k < height - 1 else F.lit(0).cast("long")
        children = F.sort_array(F.collect_list(F.struct("node", "digest", "bytes")))  # at most FANOUT
        nodes = levels[-1].groupBy(up.alias("up")).agg(F.sum("bytes").alias("bytes"), children.alias("c"))
        line = F.transform("c", lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"], c["bytes"].cast("string")))
        levels.append(cut(nodes.select(F.col("up").alias("node"), "bytes", F.sha2(F.array_join(line, ","), 256).alias("digest"))))
    return levels


def _height(last: int) -> int:
    """Levels above the records, so that ids 0 to last share one root."""
    return max(1, -(-last.bit_length() // BITS))


def audit(primary: DataFrame, replica: DataFrame, record_id: str = "page_id", uri: str = "url", body: str = "html") -> DataFrame:
    """The records that differ: id, status (corrupt, missing or extra), start and end byte in the primary, both digests, and the
    number of tree levels that led to it.

    start and end are null for extra records, which the primary does not have. Equal replicas, empty ones included, give no row. Ids may be
    any longs; null addresses and bodies count as empty; rows that repeat an id are one record, rows without an id are one, which comes last;
    other columns are not looked at.
    """
    sides = [records(x, record_id, uri, body) for x in (primary, replica)]
    ends = sides[0].select("id").unionByName(sides[1].select("id")).agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    low = ends.low if ends.low is not None else 0
    last = (ends.high if ends.high is not None else -1) + 1 - low
    if last >= 1 << 63:  # offsets would overflow: the ids themselves, whose sign is part of the highest node
        low, height = 0, 64 // BITS
    else:
        height = _height(last)
    trees = [tree(side.withColumn("id", F.col("id") - F.lit(low).cast("long")), height) for side in sides]
    # the root's range, then the ranges of its differing descendants
    bad = _differing(trees[0][height], trees[1][height], None)
    for k in range(height - 1, -1, -1):
        up = F.shiftright("node", BITS) if k < height - 1 else F.lit(0).cast("long")
        parents = bad.select(F.col("node").alias("parent"), F.col("start").alias("from"))
        below = [t[k].withColumn("up", up).join(parents, F.col("up").eqNullSafe(F.col("parent"))).drop("parent") for t in trees]
        bad = cut(_differing(*below, "up"))
    status = F.when(F.col("replica_digest").isNull(), "missing").when(F.col("primary_digest").isNull(), "extra").otherwise("corrupt")
    own = F.col("node") + F.lit(low).cast("long")
    start = F.when(F.col("primary_digest").isNotNull(), F.col("start"))
    return bad.select(own.alias(record_id), status.alias("status"), start.alias("start"), (start + F.col("bytes")).alias("end"), "primary_digest", "replica_digest", F.lit(height).alias("levels"))


def _differing(left: DataFrame, right: DataFrame, up: str | None) -> DataFrame:
    """Nodes whose digests differ, with their start in the primary: the parent's and the lengths of earlier siblings."""
    if up:
        before = Window.partitionBy("up").orderBy(F.asc_nulls_last("node")).rowsBetween(Window.unboundedPreceding, -1)
        left = left.withColumn("start", F.col("from") + F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    else:
        left = left.withColumn("start", F.lit(0).cast("long"))
    left = left.select("node", "bytes", "start", F.col("digest").alias("primary_digest"))
    right = right.select(F.col("node").alias("other"), F.lit(True).alias("held"), F.col("digest").alias("replica_digest"))
    both = left.join(right, F.col("node").eqNullSafe(F.col("other")), "full_outer").withColumn("node", F.when(F.col("held"), F.col("other")).otherwise(F.col("node")))
    both = both.where(~F.col("primary_digest").eqNullSafe(F.col("replica_digest")))
    return both.withColumn("start", F.coalesce("start", F.lit(0).cast("long")))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of pages with known damage: of every 53 ids one is lost, one truncated, one has a character changed."""
    kept = pages.where(~F.coalesce(F.col("page_id") % 53 == 9, F.lit(False)))
    body = F.col("html")
    short = F.substring(body, 1, F.greatest(F.length(body) - 1, F.lit(0)))
    flipped = F.concat(F.substring(body, 1, 20), F.lit("¤"), F.substring(body, 22, 1 << 30))
    return kept.withColumn("html", F.when(F.col("page_id") % 53 == 8, short).when(F.col("page_id") % 53 == 7, flipped).otherwise(body))


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, url, CASE page_id % 53 WHEN 8 THEN substr(html, 1, greatest(length(html) - 1, 0)) WHEN 7 THEN substr(html, 1, 20) || chr(164) || substr(html, 22) ELSE html END AS html FROM p WHERE page_id % 53 <> 9),
rec AS (SELECT 'p' AS side, page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS t FROM p
 UNION ALL SELECT 'r', page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) FROM r),
a AS (SELECT page_id, sha256(t) AS digest, CAST(sum(strlen(t)) OVER (ORDER BY page_id) AS BIGINT) AS "end", strlen(t) AS n FROM rec WHERE side = 'p'),
b AS (SELECT page_id, sha256(t) AS digest FROM rec WHERE side = 'r'),
l AS (SELECT CAST(min(k) AS INTEGER) AS levels FROM range(1, 17) AS t(k) WHERE pow(16, k) > (SELECT max(page_id) + 1 - min(page_id) FROM pages))
SELECT a.page_id, CASE WHEN b.digest IS NULL THEN 'missing' ELSE 'corrupt' END AS status, a."end" - n AS start, a."end", a.digest AS primary_digest, b.digest AS replica_digest, l.levels
FROM a LEFT JOIN b USING (page_id), l WHERE a.digest IS DISTINCT FROM b.digest
"""

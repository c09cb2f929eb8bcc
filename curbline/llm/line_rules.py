"""Quality rules with cross-document line frequency. DataFrame operations only.

Lines are normalised (letter case, white space and digits do not count) and hashed. The documents of each host that hold a line are counted, and a
line in more of them than the host's limit is boilerplate: it is removed, and a document that loses over half of its text is rejected, as are
documents that fail the base rules (too short, or too many repeated five-word windows).

The texts are read twice: for the counts, and for the verdicts. A document sends each of its lines once, summed map-side by host and line; only the
lines above the limit meet the documents again, broadcast if they are counted to be at most BROADCAST_ROWS, else shuffled and salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.plans.session import cut

#: A line is removed where more documents of its host hold it than this number, and than this share of the host's documents.
MIN_DOCS, SHARE = 20, 0.01
#: A document is depleted if less than this share of its normalised characters is left.
LEAST_LEFT = 0.5
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
BROADCAST_ROWS = 500_000
#: Copies of each line above the limit beyond that.
SALTS = 32
_BLANK = r"[\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def normalised(line: Column) -> Column:
    return F.lower(F.regexp_replace(line, r"[\x20\x09-\x0D0-9]+", ""))


def line_counts(rows: DataFrame) -> DataFrame:
    """(host, h, n_docs) of rows (host, text): how many rows of the host hold a line of hash h."""
    held = F.array_distinct(F.transform(_lines(F.col("text")), lambda line: F.xxhash64(normalised(line))))
    return rows.select("host", F.explode(held).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n_docs"))


def frequent_lines(rows: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """(host, h) of the lines above their host's limit. Rows of a null host are a host of their own."""
    often = line_counts(rows).where(F.col("n_docs") > min_docs)
    hosts = rows.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("docs")).where(F.col("docs") > min_docs)
    return often.join(hosts, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n_docs") > share * F.col("docs")).select("host", "h")


def _repeated(rows: DataFrame) -> DataFrame:
    """rows (words, ...) with n_repeat_words instead of words: the words in windows that the text holds twice or more.

    Windows are compared by their hashes: sorted with their places, equal neighbours are repeats, and the places' union is measured. Each step is a
    column of its own, so that what is looked up by place is computed once.
    """
    rest = [c for c in rows.columns if c != "words"]
    rows = rows.select(*rest, F.transform("words", lambda w: F.xxhash64(w)).alias("hs"))  # a word is read once, its hash five times
    windows = F.transform("hs", lambda h, i: F.xxhash64(h, *(F.get("hs", i + k) for k in range(1, WINDOW))))
    rows = rows.select(*rest, F.slice(windows, F.lit(1), F.greatest(F.size("hs") - WINDOW + 1, F.lit(0))).alias("hs"))
    twice = F.size(F.array_distinct("hs")) < F.size("hs")
    filed = F.sort_array(F.transform("hs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.select(*rest, F.when(twice, filed).alias("filed"))
    same = lambda x, k: F.get("filed", k)["h"] == x["h"]
    repeats = F.filter("filed", lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
    rows = rows.select(*rest, F.sort_array(F.transform(repeats, lambda x: x["i"])).alias("at"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("at", start, lambda acc, i: F.struct((acc["n"] + (i + WINDOW - F.greatest(acc["end"], i))).alias("n"), (i + WINDOW).alias("end")))
    return rows.select(*rest, F.coalesce(covered["n"], F.lit(0).cast("long")).alias("n_repeat_words"))


def base_rules(rows: DataFrame) -> DataFrame:
    """rows (text, ...) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    rest = rows.columns
    rows = rows.select(*rest, F.array_remove(F.split("text", _BLANK), "").alias("words"), _lines(F.col("text")).alias("lines"))
    rows = rows.select(
        *rest, "words", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    rows = _repeated(rows).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    # as a generated row, so that a filter on a result stays above the steps instead of being computed by all of them anew
    return rows.select(*rest, F.inline(F.array(F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))))


def _plain(docs: DataFrame, text: str, host: str) -> DataFrame:
    return docs.select(F.col(host).cast("string").alias("host"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def _marked(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """rows (host, h, ...) with bad, whether the line is above its host's limit. frequent is kept, so that counting it is cheap."""
    bad = frequent.select(F.col("host").alias("of"), F.col("h").alias("line"), F.lit(True).alias("bad"))
    same = F.col("host").eqNullSafe(F.col("of")) & (F.col("h") == F.col("line"))
    if frequent.count() <= BROADCAST_ROWS:
        met = rows.join(F.broadcast(bad), same, "left")
    else:  # a line that very many documents hold is dealt by document too
        salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
        met = rows.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS))).join(bad.withColumn("copy", F.explode(salts)), same & (F.col("salt") == F.col("copy")), "left").drop("salt", "copy")
    return met.withColumn("bad", F.coalesce("bad", F.lit(False))).drop("of", "line")


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_lines) for every row of docs.

    A row is a document. Null and empty texts have no words, so they fail the base rules. Ids may be null or repeat: repeated rows are judged each, and
    count as several documents of their host. Rows of a null host are a host of their own. Ties there are none: a limit is passed or not. An empty table
    gives an empty result; further columns are not looked at.
    """
    frequent = cut(frequent_lines(_plain(docs, text, host), min_docs, share))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    judged = base_rules(rows.withColumn("row", F.monotonically_increasing_id()))
    own = [c for c in judged.columns if c not in ("text", "host")]
    line = lambda x: F.struct(F.xxhash64(normalised(x)).alias("h"), F.length(normalised(x)).alias("n"))
    each = judged.select(*own, "host", F.explode_outer(F.transform(_lines(F.col("text")), line)).alias("x")).select(*own, "host", "x.h", "x.n")
    sums = _marked(each, frequent).groupBy(*own).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("lost"), F.count_if("bad").alias("n_removed_lines"))
    kept = ~F.col("base_failed") & (F.col("all") - F.col("lost") >= LEAST_LEFT * F.col("all"))
    return sums.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_removed_lines")


def clean(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """The rows of docs that are kept, without their lines above the limit; the other lines stay as they are. All columns stay, whatever their names;
    nulls, repeats and empty tables as in judge."""
    frequent = cut(frequent_lines(_plain(docs, text, host), min_docs, share))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), F.col(host).cast("string").alias("host"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = whole.withColumn("row", F.monotonically_increasing_id())
    each = rows.select("row", "host", F.explode(F.array_distinct(F.transform(_lines(F.col("text")), lambda x: F.xxhash64(normalised(x))))).alias("h"))
    bad = _marked(each, frequent).where("bad").groupBy("row").agg(F.collect_set("h").alias("bad"))  # bounded: one document's lines
    met = base_rules(rows).where(~F.col("base_failed")).join(bad, "row", "left").select("whole", "text", F.coalesce("bad", F.array().cast("array<bigint>")).alias("bad"))
    left = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("bad", F.xxhash64(normalised(x))))
    met = met.select("whole", "text", F.array_join(left, "\n").alias("left"))
    size = lambda c: F.length(normalised(F.col(c)))
    enough = size("left") >= LEAST_LEFT * size("text")
    return met.where(enough).select(*(F.col("left").alias(c) if c == text else F.col(f"whole.`{c}`").alias(c) for c in docs.columns))


_WINDOW = "[" + ", ".join(f"w[k + {k}]" for k in range(WINDOW)) + "]"
ORACLE = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT r, list_filter(regexp_split_to_array(text, '{_BLANK}'), lambda x: x <> '') AS w FROM d),
l AS MATERIALIZED (SELECT r, source, x FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
n AS MATERIALIZED (SELECT r, source, lower(regexp_replace(x, '[\x20\x09-\x0D0-9]+', '', 'g')) AS x FROM l),
f AS (SELECT source, x, count(DISTINCT r) AS n FROM n GROUP BY source, x),
h AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
bad AS (SELECT f.source, x FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source WHERE n > {MIN_DOCS} AND n > {SHARE} * docs),
loss AS (SELECT r, sum(length(n.x)) AS total, sum(CASE WHEN bad.x IS NOT NULL THEN length(n.x) ELSE 0 END) AS lost, count(bad.x) AS n_removed_lines FROM n LEFT JOIN bad ON n.source IS NOT DISTINCT FROM bad.source AND n.x = bad.x GROUP BY r),
win AS MATERIALIZED (SELECT r, k, {_WINDOW} AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 0) + 1)) AS k FROM w)),
twice AS (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1),
cov AS (SELECT r, count(DISTINCT k) AS n_repeat_words FROM (SELECT r, unnest(range(k, k + {WINDOW})) AS k FROM win JOIN twice USING (r, g)) GROUP BY r),
dup AS (SELECT r, count(*) - count(DISTINCT x) AS n_dup_lines FROM l GROUP BY r),
b AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(total, 0) AS total, coalesce(lost, 0) AS lost, coalesce(n_removed_lines, 0) AS n_removed_lines
 FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN cov USING (r) LEFT JOIN loss USING (r)),
v AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND total - lost >= {LEAST_LEFT} * total AS kept, n_removed_lines FROM v
"""

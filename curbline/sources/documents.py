"""Report documents as VARIANT: every field is kept, known or not, and a missing one is told from a null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a document is a report of, in the order in which its structure is asked.
KINDS = ("items", "discrepancies", "reviews")


def entries(documents: DataFrame, *keep: str) -> DataFrame:
    """A row an entry of documents (value, JSON text, and the columns to keep): kind, id, entry (a map of VARIANT by field). Entries of lists have their id
    inside, those of a map as its key. A text that is no JSON object, or without any of the three, is an error."""
    doc = documents.select(*keep, F.parse_json("value").cast("map<string, variant>").alias("d"))
    kind = F.coalesce(*(F.when(F.map_contains_key("d", k), F.lit(k)) for k in KINDS), F.raise_error(F.lit("a report has items, discrepancies or reviews")))
    doc = doc.withColumn("kind", kind).withColumn("body", F.element_at("d", F.col("kind")))
    listed = doc.where("kind <> 'reviews'").select(*keep, "kind", F.posexplode(F.col("body").cast("array<map<string, variant>>")).alias("ord", "entry"))
    listed = listed.select(*keep, "kind", "ord", field(F.col("entry"), "id", "string").alias("id"), "entry")
    named = doc.where("kind = 'reviews'").select(*keep, "kind", F.explode(F.col("body").cast("map<string, map<string, variant>>")).alias("id", "entry"))
    return listed.unionByName(named.select(*keep, "kind", F.lit(None).cast("int").alias("ord"), "id", "entry"))


def field(entry: Column, name: str, kind: str) -> Column:
    """A field as a value of the type; null where it is missing, null, or not of the type."""
    return F.try_variant_get(F.try_element_at(entry, F.lit(name)), "$", kind)


def state(entry: Column, name: str) -> Column:
    """missing, null or value."""
    return F.when(~F.map_contains_key(entry, name), "missing").when(F.is_variant_null(F.element_at(entry, name)), "null").otherwise("value")


def with_fields(entry: Column, changes: dict[str, Column]) -> Column:
    """The entry with fields set, each to a string; the others stay as they are, in whatever shape."""
    rest = F.map_filter(entry, lambda k, _: ~k.isin(*changes))
    new = F.create_map(*(x for k, v in changes.items() for x in (F.lit(k), F.parse_json(F.coalesce(F.to_json(F.array(v)), F.lit("[null]"))))))
    return F.map_concat(rest, F.transform_values(new, lambda _, v: F.variant_get(v, "$[0]", "variant")))


def rewritten(rows: DataFrame, by: str) -> DataFrame:
    """(by, value): the documents of entries (by, kind, ord, id, entry) of lists, in their order, as JSON text."""
    listed = rows.where("kind <> 'reviews'").groupBy(by, "kind").agg(F.array_sort(F.collect_list(F.struct("ord", F.to_json("entry").alias("text")))).alias("e"))
    body = F.array_join(F.transform("e", lambda x: x["text"]), ",")
    return listed.select(by, F.concat(F.lit('{"'), "kind", F.lit('":['), body, F.lit("]}")).alias("value"))

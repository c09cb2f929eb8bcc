"""Parsing of names, paths, coordinates and times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers below this are seconds, others milliseconds.
SECONDS_BELOW = 2e10


def unquote(name: Column) -> Column:
    """Percent-decoding that leaves plus signs alone."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def label_path(name: Column) -> Column:
    """(folder, stem) of an export's label file name: what follows the first double underscore, cut at the first back slash or else slash."""
    stemmed = F.regexp_replace(unquote(name), r"\.txt$", "")
    rest = F.when(F.instr(stemmed, "__") > 0, F.regexp_extract(stemmed, r"^(?s:.*?)__(?s:(.*))$", 1))
    at = F.locate("\\", rest)
    at = F.when(at > 0, at).otherwise(F.locate("/", rest))
    return F.when(at > 0, F.struct(F.substring(rest, F.lit(1), at - 1).alias("folder"), F.substring(rest, at + 1, F.length(rest)).alias("stem")))


def label_stem(name: Column) -> Column:
    """The last path part without the eight hex digits that an export puts first."""
    bare = F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z]+$", ""), r"^[0-9a-f]{8}__", "")
    return F.element_at(F.split(unquote(bare), r"[\\/]"), -1)


def stem_video(stem: Column) -> Column:
    return F.when(F.instr(stem, "_") > 0, F.regexp_extract(stem, r"^(?s:(.*))_[^_]*$", 1)).otherwise(stem)


def stem_number(stem: Column) -> Column:
    """The number after the last underscore, if it is one."""
    return F.regexp_extract(stem, r"_([^_]*)$", 1).try_cast("bigint")


def url_filename(url: Column) -> Column:
    return unquote(F.element_at(F.split(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", ""), "/"), -1))


def path_slug(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\]", "__")


def normal_extension(ext: Column) -> Column:
    return F.when(F.lower(ext) == ".jpeg", ".jpg").otherwise(F.lower(ext))


def coordinate(text: Column) -> Column:
    """Degrees with a hemisphere letter or a sign."""
    number = F.regexp_extract(text, r"(-?\d+\.?\d*)", 1).try_cast("double")
    side = F.upper(F.regexp_extract(F.trim(text), r"([NSEWnsew])$", 1))
    return F.when(side.isin("S", "W"), -F.abs(number)).when(side.isin("N", "E"), F.abs(number)).otherwise(number)


def leading_number(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*(-?\d+\.?\d*)", 1).try_cast("double")


def timestamp_ms(text: Column) -> Column:
    """Numbers as seconds or milliseconds by size; otherwise one of the usual ISO shapes, in UTC."""
    number = text.try_cast("double")
    shapes = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss"]
    moment = F.coalesce(*(F.unix_millis(F.try_to_timestamp(F.regexp_replace(text, "Z$", ""), F.lit(s))) for s in shapes), F.unix_millis(F.try_to_timestamp(text)))
    return F.when(number.isNotNull(), F.when(number < SECONDS_BELOW, number * 1000).otherwise(number)).otherwise(moment.cast("double"))


def reviewed_name(name: Column) -> Column:
    """The file name of a reviewed copy."""
    return F.concat(F.regexp_replace(name, r"\.(geo)?json$", ""), F.lit("_reviewed.geojson"))


def camera_suffix(name: Column) -> Column:
    return F.when(F.contains(name, F.lit("_FH")), "FH").when(F.contains(name, F.lit("_FL")), "FL").otherwise("other")


def frame_id(url: Column) -> Column:
    return F.regexp_extract(url, r"/frame/(\d+)", 1).try_cast("bigint")


def inventory_class(reason: Column) -> Column:
    return F.nullif(F.regexp_extract(reason, r"inventory ([A-Za-z]+)\)", 1), F.lit(""))


def stable_order(seed: int | str, *keys: Column) -> Column:
    """A pseudo-random order that does not depend on partitions or engine: the MD5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)))

"""SimHash near-dedup with bit-sliced comparison.

A fingerprint bit is set where over half of the XXH64 hashes of a text's 4-word shingles have it. Fingerprints
are compared vertically: bit b of 64 candidates is one machine word (a bit plane), distances of a whole block
grow in carry-save counters, and a block is left as soon as every candidate in it exceeds the radius.

Which blocks meet is decided by the pigeonhole principle: with the 64 bits cut into m blocks, two fingerprints at
most r bits apart agree on at least m - r blocks, so each fingerprint is filed once under every choice of m - r
blocks. That is exact for any m > r. Equal fingerprints are collapsed first; a bucket with more than
TILE fingerprints is dealt into tiles and every pair of tiles is a task of its own, so no bucket meets in
one task. A tile yields a spanning forest of its links and a pair of tiles what joins their forests, never all
pairs. Only the few heavy keys are broadcast: joins with tables that grow are merge joins, whatever their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from curbline.operators.components import connected_components
from curbline.operators.skew import join_uneven
from curbline.plans.session import cut, in_few_files

SEED = 42
RADIUS = 4
SHINGLE = 4
TILE = 1024


# --------------------------------------------------------------------------------------------------- fingerprints
def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint; 0 for null and for texts without words. Only A-Z are lower-cased."""
    return int(_fingerprints(text, words, 1)[0])


def _remixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Hashes independent of the given ones: a bijection of 64-bit words (SplitMix64's finisher) keyed by the seed; seed 0 changes nothing."""
    if not seed:
        return hashes
    x = hashes + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _fingerprints(text: str | None, words: int, seeds: int) -> np.ndarray:
    """The fingerprint and those of seeds - 1 remixed hashes."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.zeros(seeds, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = np.concatenate(([0], ends[: -words] + 1)).tolist()
        slices = map(joined.__getitem__, map(slice, starts, ends[words - 1 :].tolist()))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, slices, repeat(SEED)), np.uint64, len(starts))
    total = np.zeros((seeds, 64), np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[at : at + (1 << 14)]).astype("<u8")
        for k in range(seeds):
            total[k] += np.unpackbits(_remixed(part, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes), axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", other: Column | None = None, seeds: int = 1) -> DataFrame:
    """(doc_id long, fp long), fp being the fingerprint as a signed 64-bit integer; fp1, fp2, ... those of remixed hashes, if there are
    to be more. A further long column can come along as other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.zeros((batch.num_rows, seeds), np.uint64)
            for i, x in enumerate(batch.column(1)):
                fps[i] = _fingerprints(x.as_py(), SHINGLE, seeds)
            columns = [pa.array(np.ascontiguousarray(fps[:, k]).view(np.int64)) for k in range(seeds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[2:]], names=["doc_id", *_names(seeds), *batch.schema.names[2:]])

    more = [other.cast("long").alias("other")] if other is not None else []
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *more)
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *_names(seeds), *["other"] * bool(more))))


def _names(seeds: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, seeds))]


# ------------------------------------------------------------------------------------------------- bit-sliced core
def bit_planes(values: np.ndarray) -> np.ndarray:
    """(64, ceil(n / 64)) words: bit k of word w of plane b is bit b of value 64 w + k."""
    n = len(values)
    padded = np.zeros(-(-max(n, 1) // 64) * 64, "<u8")
    padded[:n] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within_radius(planes: Iterator[np.ndarray], shape: tuple[int, ...], radius: int) -> np.ndarray:
    """Words with a bit set for each lane whose difference planes hold at most radius ones.

    The counters saturate: a lane that overflows stays beyond the radius. Left early once all lanes are beyond it.
    """
    width = (radius + 1).bit_length()
    count = [np.zeros(shape, np.uint64) for _ in range(width)]
    over = np.zeros(shape, np.uint64)
    for b, plane in enumerate(planes):
        carry = plane
        for k in range(width):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if b % 8 == 7:
            beyond = over | _greater(count, radius)
            if (beyond == np.uint64(0xFFFFFFFFFFFFFFFF)).all():
                return ~beyond
    return ~(over | _greater(count, radius))


def _greater(count: list[np.ndarray], limit: int) -> np.ndarray:
    more, same = np.zeros_like(count[0]), np.full_like(count[0], 0xFFFFFFFFFFFFFFFF)
    for k in range(len(count) - 1, -1, -1):
        if limit >> k & 1:
            same &= count[k]
        else:
            more |= same & count[k]
            same &= ~count[k]
    return more


def _lanes(words: np.ndarray, n: int) -> np.ndarray:
    """Lanes as booleans along the last axis, cut to n."""
    flat = np.ascontiguousarray(words.astype("<u8")).view(np.uint8)
    return np.unpackbits(flat, axis=-1, bitorder="little")[..., :n].astype(bool)


def pair_links(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each position of left that has any, the positions of right within the radius."""
    planes, ones = bit_planes(right), np.uint64(0xFFFFFFFFFFFFFFFF)
    for at in range(0, len(left), 64):
        part = left[at : at + 64].astype(np.uint64)
        masks = (((part >> np.uint64(b)) & np.uint64(1)) * ones for b in range(64))
        near = within_radius((planes[b][None, :] ^ m[:, None] for b, m in enumerate(masks)), (len(part), planes.shape[1]), radius)
        for k in np.flatnonzero(near.any(axis=1)):
            found = np.flatnonzero(_lanes(near[k], len(right)))
            if len(found):
                yield at + int(k), found


def _united(label: np.ndarray, values: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Those links between the positions left and right of values that join two labels; label is changed to what they make."""
    edges = []
    for k, found in pair_links(values[left], values[right], radius):
        at, own = right[found], label[left[k]]
        names, first = np.unique(label[at], return_index=True)
        other = names != own
        if other.any():
            edges += [(int(left[k]), int(at[i])) for i in first[other]]
            held = np.append(names[other], own)
            label[np.isin(label, held)] = held.min()
    return edges


def forest(values: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (member, first member), as positions, of the links between the positions left and right of values."""
    label = np.arange(len(values))
    _united(label, values, left, right, radius)
    return [(int(i), int(label[i])) for i in np.flatnonzero(label != np.arange(len(values)))]


def across(values: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges, as positions, that join what is linked within left and within right to one another. The links inside a side are left out: they come
    out where the side meets itself. So two tiles of near copies give one edge, however many links there are between them."""
    label = np.arange(len(values))
    for side in (left, right):
        _united(label, values, side, side, radius)
    return _united(label, values, left, right, radius)


def _small_links(values: np.ndarray, group: np.ndarray, size: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links, as positions, inside many small groups at once: lane k compares the k-th value with the one s places on."""
    for s in range(1, int(size.max(initial=1))):
        at = np.flatnonzero(size > s)
        at = at[at + s < len(values)]
        at = at[group[at] == group[at + s]]
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            planes = bit_planes(values[part] ^ values[part + s])
            near = _lanes(within_radius(iter(planes), planes.shape[1:], radius), len(part))
            yield part[near], part[near] + s


SMALL = 48
#: Nodes that a task remembers at a time.
KNOWN = 1 << 20


def _joining(parent: dict[int, int], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which edges join two trees of parent, which takes them up: a link that a task finds again under another key is not put out again."""

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    keep = np.zeros(len(a), bool)
    for i, (u, v) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(u), find(v)
        if x != y:
            parent[max(x, y)], keep[i] = min(x, y), True
    return keep


def _compare_sorted(radius: int):
    def flush(keys: np.ndarray, fps: np.ndarray, sides: np.ndarray, nodes: np.ndarray, parent: dict[int, int]) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(keys)])
        group, size = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes, sizes)
        values, pairs = fps.view(np.uint64), []
        plain = np.flatnonzero((size <= SMALL) & (keys[:, 1] == keys[:, 2]))
        if len(plain):
            pairs += [plain[np.stack(x)] for x in _small_links(values[plain], group[plain], size[plain], radius)]
        for at, n in zip(starts, sizes, strict=True):
            same = keys[at, 1] == keys[at, 2]
            if n > SMALL or not same:
                own, own_side = values[at : at + n], sides[at : at + n]
                left = np.arange(n) if same else np.flatnonzero(own_side == 0)
                right = np.arange(n) if same else np.flatnonzero(own_side == 1)
                if len(left) and len(right) and (edges := (forest if same else across)(own, left, right, radius)):
                    pairs.append(at + np.array(edges).T)
        if pairs:
            a, b = nodes[np.concatenate(pairs, axis=1)]
            keep = _joining(parent, a, b)
            if len(parent) > KNOWN:
                parent.clear()
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        parent: dict[int, int] = {}

        def parts(data: np.ndarray) -> Iterator[pa.RecordBatch]:
            return flush(data[:, :3], np.ascontiguousarray(data[:, 3]), data[:, 4], np.ascontiguousarray(data[:, 5]), parent)

        for batch in batches:
            data = np.stack([np.asarray(c) for c in batch.columns], axis=1)
            if not len(data):
                continue
            data = np.concatenate([*held, data]) if held else data
            last = int(np.flatnonzero((data[:, :3] == data[-1, :3]).all(axis=1))[0])
            if last:
                yield from parts(data[:last])
            held = [data[last:]]
        if held:
            yield from parts(held[0])

    return run


# ------------------------------------------------------------------------------------------------------- the search
def _blocks(m: int) -> list[tuple[int, int]]:
    cuts = [round(64 * i / m) for i in range(m + 1)]
    return list(zip(cuts[:-1], [b - a for a, b in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))


#: Bits of a key beyond those that number the fingerprints: unrelated ones rarely share a key, however many there are.
SLACK = 6


def block_count(n: int, radius: int = RADIUS) -> int:
    """The smallest number of blocks whose agreeing bits tell n fingerprints well apart; the result does not depend on it."""
    m = radius + 2
    while m < 64 and 64 * (m - radius) / m < np.log2(max(n, 2)) + SLACK:
        m += 1
    return m


def _keys(fp: Column, m: int, radius: int, seed: int) -> Column:
    """(key, value) for each choice of agreeing blocks: the bits kept, mixed with the number of the choice and of the fingerprint."""
    out = []
    for t, chosen in enumerate(combinations(_blocks(m), m - radius)):
        mask = sum(((1 << w) - 1) << at for at, w in chosen)
        mask -= (mask >> 63) << 64
        key = F.xxhash64(F.lit(t + (seed << 20)), fp.bitwiseAND(F.lit(mask).cast("long")))
        out.append(F.struct(key.alias("key"), fp.alias("value")))
    return F.array(*out)


def links(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between the values of fp that span every link within the radius: of fp, or of any of the further columns fp1, fp2, ...

    Rows of fps are distinct. A key that many rows share meets its size by broadcast before it is tiled.
    """
    seeds, n = [c for c in fps.columns if c.startswith("fp")], fps.count()
    m = blocks or block_count(n, radius)
    keys = [_keys(F.col(c), m, radius, k) for k, c in enumerate(seeds)]
    filed = fps.select(F.col("fp").alias("node"), F.explode(F.concat(*keys)).alias("x")).select("x.key", "x.value", *["node"] * (len(seeds) > 1))
    sizes = filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    known = join_uneven(filed, sizes, "key", "n", max(1, n * len(seeds) * comb(m, radius)))
    known = known if len(seeds) > 1 else known.withColumn("node", F.col("value"))
    tiles = F.ceil(F.col("n") / F.lit(tile)).cast("long")
    own = F.pmod(F.xxhash64("value", "node", F.lit(7)), tiles)
    dealt = known.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
    dealt = dealt.select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "value",
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).cast("long").alias("side"), "node",
    )
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_compare_sorted(radius), "a long, b long")


def _classes(own: DataFrame, radius: int, rows: int) -> DataFrame:
    """(fp, n, root, component_id) of the distinct fingerprints of own (doc_id, fp, ...), which has so many rows: n is the number of rows of the fingerprint."""
    seeds = [c for c in own.columns if c.startswith("fp")]
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), rows)
    parts = cut(connected_components(links(own.select(*seeds).distinct(), radius), rows=rows).withColumnRenamed("node", "fp"), rows)
    linked = cut(distinct.join(parts.hint("merge"), "fp"), rows)
    sizes = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = join_uneven(linked, sizes, "component", "members", max(1, linked.count()))
    alone = distinct.join(parts.hint("merge"), "fp", "left_anti").withColumn("root", F.col("fp")).withColumn("component_id", F.col("least"))
    return named.withColumnRenamed("component", "root").select("fp", "n", "root", "component_id").unionByName(alone.select("fp", "n", "root", "component_id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Null and empty texts and texts without words have fingerprint zero and are linked like any other. A row whose
    doc_id is null keeps its component, which is null if no row of it has an id. Repeated rows stay repeated. An empty
    table gives an empty result; further columns are not looked at.
    """
    own = cut(fingerprints(docs, doc_id, text))
    rows = own.count()
    classes = cut(_classes(own, radius, rows).select("fp", "n", "component_id"), rows)
    named = in_few_files(join_uneven(own, classes, "fp", "n", max(1, rows)), rows)
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, seeds: int = 1) -> DataFrame:
    """docs with one row of each component: that of the smallest id, null ids last. Of rows that repeat the id the one
    with the least text hash stays, of equal rows one. All columns stay, whatever their names.

    With more seeds there are that many independent fingerprints of a text, and texts are linked if those of any one seed are within
    the radius: near copies whose distance under one hash is unlucky are linked under another. An empty table stays empty.
    """
    hash_of = F.coalesce(F.xxhash64(F.col(text).cast("string")), F.lit(0).cast("long"))
    own = cut(fingerprints(docs, doc_id, text, hash_of, seeds))
    # one winner a fingerprint, then one a component: the rows of a common text never meet in one task
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "other"))
    firsts = own.groupBy("fp").agg(first.alias("first")).join(_classes(own, radius, own.count()).select("fp", "root").hint("merge"), "fp")
    winners = firsts.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.other")
    where = lambda i, h: F.xxhash64(i.cast("long"), h)
    winners = winners.select(F.struct(F.col("doc_id").alias("id"), "other").alias("_won"), where(F.col("doc_id"), F.col("other")).alias("_at"))
    # the rows go by one key, so that they are dealt once, for the join and for their copies
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.struct(F.col(doc_id).cast("long").alias("id"), hash_of.alias("other")).alias("_own"))
    rows = rows.withColumn("_at", where(F.col("_own.id"), F.col("_own.other")))
    met = rows.join(winners.hint("merge"), "_at").where(F.col("_own.id").eqNullSafe(F.col("_won.id")) & (F.col("_own.other") == F.col("_won.other")))
    same = Window.partitionBy("_at", "_own").orderBy("_at")
    return met.withColumn("_copy", F.row_number().over(same)).where("_copy = 1").select("_row.*")

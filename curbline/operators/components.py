"""Connected components of an undirected graph given as edges.

Two star operations alternate (Kiveris et al., 2014) until the edge set stops changing. Each step is an
aggregate and an equi-join on the vertex: a vertex with very many edges is pre-aggregated map-side, and its edges
meet its label by broadcast, since few vertices can have a large share of all edges. Before the first round every partition replaces its own edges by a spanning
star forest, which is what keeps the rounds few.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbline.operators.skew import join_uneven
from curbline.plans.session import cut

MAX_ROUNDS = 50


def _local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the edges of one batch at a time: memory is bounded by a batch."""
    for pdf in batches:
        yield _forest(pdf)


def _whole_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = list(batches)
    if held:
        yield _forest(pd.concat(held))


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """The edges' components as stars around their least ids."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
        a, b = find(u), find(v)
        parent.setdefault(u, u)
        parent.setdefault(v, v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    rows = [(x, find(x)) for x in parent]
    return pd.DataFrame([(x, r) for x, r in rows if x != r], columns=["u", "v"]).astype("int64")


#: A part's edges are held by its task up to this number; the rest of a larger part goes on in rounds.
PART_EDGES = 500_000


def _part_forests(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Stars of the parts, whose edges (p, u, v, crosses) come one part after another. Stars that an edge to another part touches, those edges, and all
    of a part of more than most edges are open; the others are done and name their centre too."""
    held, over = None, None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf])
        last = pdf["p"].iloc[-1] if len(pdf) else None
        done, held = pdf[pdf["p"] != last], pdf[pdf["p"] == last]
        yield _stars(done, over)
        if len(held) > most:
            over = last
            yield _stars(held, over)
            held = None
    if held is not None:
        yield _stars(held, over)


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives the ends of every edge (a, b) and all that has their labels one label, the least; labels are places in label and name themselves."""
    while (label[a] != label[b]).any():
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def _stars(pdf: pd.DataFrame, over: int | None) -> pd.DataFrame:
    u, across = pdf["u"].to_numpy("int64"), pdf["crosses"].to_numpy(bool)
    v = np.where(across, u, pdf["v"].to_numpy("int64"))
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(ids))
    join_labels(label, a, b)
    unfinished = np.zeros(len(ids), bool)
    unfinished[label[a[across | (pdf["p"].to_numpy() == over)]]] = True
    is_open = unfinished[label]
    kept = ~is_open | (label != np.arange(len(ids)))
    stars = pd.DataFrame({"u": ids[kept], "v": ids[label][kept], "open": is_open[kept]})
    return pd.concat([stars, pdf.loc[across, ["u", "v"]].assign(open=True)]).astype({"u": "int64", "v": "int64", "open": "bool"})


def components_by_parts(edges: DataFrame, a: str, b: str, part_a: str, part_b: str, small: int = 0, most: int = PART_EDGES) -> DataFrame:
    """What connected_components gives for edges whose ends have a part each (numbers), most edges lying inside one part: those are shuffled once, to
    the task of their part, and only components that reach into another part, or lie in a part of more than most edges, go on in rounds."""
    end = lambda p, u, v, x: F.struct(F.col(p).cast("long").alias("p"), F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"), F.lit(x).alias("crosses"))
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    sides = F.when(F.col(part_a) == F.col(part_b), F.array(end(part_a, a, b, False))).otherwise(F.array(end(part_a, a, b, True), end(part_b, b, a, True)))
    rows = ends.select(F.explode(sides).alias("e")).select("e.*")
    stars = cut(rows.repartition("p").sortWithinPartitions("p").mapInPandas(partial(_part_forests, most=most), "u long, v long, open boolean"))
    done = stars.where("not open").select(F.col("u").alias("node"), F.col("v").alias("component"))
    unfinished = stars.where("open")
    return done.unionByName(connected_components(unfinished, "u", "v", small)) if unfinished.take(1) else done


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)).alias("h")).first()
    return row["n"], row["h"] or 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", small: int = 0, rows: int | None = None) -> DataFrame:
    """(node, component) for every vertex that has an edge to another one; component is the smallest id reachable.

    Null ends, self loops and repeated edges are ignored. Raises if MAX_ROUNDS rounds do not converge. If the partitions' forests have at most small
    edges together, one task finishes them and there are no rounds; the result is the same. rows is about the number of those forests' edges, if known.
    """
    ends = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    ends = ends.where("u is not null and v is not null and u <> v")
    stars = cut(ends.mapInPandas(_local_forest, "u long, v long").distinct(), rows)
    seen = _state(stars)
    if 0 < seen[0] <= small:
        stars, seen = cut(stars.coalesce(1).mapInPandas(_whole_forest, "u long, v long")), (0, 0)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = join_uneven(both, low, "u", "n", 2 * seen[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, seen[0])  # read by the aggregate and by both joins
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_uneven(large, low, "u", "n", 2 * seen[0])
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        stars = cut(small.where("u <> v").distinct(), seen[0])
        now = _state(stars)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"connected components did not converge in {MAX_ROUNDS} rounds")
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

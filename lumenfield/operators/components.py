"""Connected components of pixel masks and of edge lists.

Pixels: every tile of a frame is labelled on its own (one bounded block per task), then
only the labels that meet at tile borders form a graph. Edge lists: alternating star
contraction, a logarithmic number of rounds of grouped minima and joins; each round is
cut with a reliable checkpoint and only a count and a yes/no answer reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfield.operators.raster import offsets_array
from lumenfield.session import cut, dealt

TILE = {"z": 16, "y": 256, "x": 256}
TILE_3D = {"z": 16, "y": 64, "x": 64}
FOLD = 1 << 16
HELD = 1 << 20
FEW = 1 << 16


def pixel_code(axes: Sequence[str]) -> Column:
    """Raster-order code of a pixel; 21 bits per axis."""
    code = F.lit(0).cast("bigint")
    for axis in axes:
        code = F.shiftleft(code, 21) + F.col(axis)
    return code


def neighbour_offsets(n_axes: int, connectivity: str) -> list[tuple[int, ...]]:
    """All neighbours (``full``) or face neighbours (``faces``), raster order."""
    steps = [o for o in product((-1, 0, 1), repeat=n_axes) if any(o)]
    return steps if connectivity == "full" else [o for o in steps if sum(map(abs, o)) == 1]


def tile_labels(points: np.ndarray, forward: Sequence[tuple[int, ...]]) -> np.ndarray:
    """Index of the first point of each point's component; ``points`` are in raster order."""
    place = points - points.min(axis=0) + 1
    grid = np.full(tuple(place.max(axis=0) + 2), -1, np.int64)
    grid[tuple(place.T)] = np.arange(len(points))
    pairs = []
    for offset in forward:
        other = grid[tuple((place + np.asarray(offset)).T)]
        here = np.flatnonzero(other >= 0)
        pairs.append(np.stack([here, other[here]]))
    left, right = np.concatenate(pairs, axis=1)
    root = np.arange(len(points))
    while True:
        a, b = root[left], root[right]
        open_ = a != b
        if not open_.any():
            return root
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (jumped := root[root]).tobytes() != root.tobytes():
            root = jumped


def label_components(
    mask: DataFrame, keys: Sequence[str], axes: Sequence[str] = ("y", "x"), connectivity: str = "full",
    tile: dict[str, int] | None = None,
) -> DataFrame:
    """Add ``root``, the raster-order code of the first pixel of each component within ``keys``."""
    keys, axes = list(keys), list(axes)
    sizes = tile or (TILE_3D if "z" in axes else TILE)
    tiles = [f"_t{a}" for a in axes]
    offsets = neighbour_offsets(len(axes), connectivity)
    forward = [o for o in offsets if o > tuple([0] * len(axes))]
    image, planes = keys[:1], keys[1:]
    stacked = [(0, *o) for o in forward]

    def label(part: pd.DataFrame) -> pd.DataFrame:
        # all planes of one image tile in one call; the plane number is an axis nothing crosses
        plane = part.groupby(planes, sort=False).ngroup().to_numpy() if planes else np.zeros(len(part), np.int64)
        part = part.assign(_plane=plane).sort_values(["_plane", "_code"], ignore_index=True)
        first = tile_labels(part[["_plane", *axes]].to_numpy(np.int64), stacked)
        return part.drop(columns="_plane").assign(root=part["_code"].to_numpy()[first])

    prepared = mask.withColumns({t: F.floor(F.col(a) / sizes[a]).cast("int") for t, a in zip(tiles, axes)}).withColumn("_code", pixel_code(axes))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prepared.schema) + ", root bigint"
    local = cut(dealt(prepared, *image, *tiles).groupBy(*image, *tiles).applyInPandas(label, schema).drop("_code", *tiles))

    at_border = F.lit(False)
    for axis in axes:
        at_border = at_border | (F.col(axis) % sizes[axis]).isin(0, sizes[axis] - 1)
    step = local.filter(at_border).select(*keys, *axes, F.col("root").alias("a"), F.explode(offsets_array(forward, axes)).alias("_o"))
    crosses = F.lit(False)
    for axis in axes:
        crosses = crosses | (F.floor(F.col(axis) / sizes[axis]) != F.floor((F.col(axis) + F.col(f"_o.d{axis}")) / sizes[axis]))
    step = step.filter(crosses).withColumns({a: F.col(a) + F.col(f"_o.d{a}") for a in axes}).drop("_o")
    border = step.join(local.filter(at_border).select(*keys, *axes, F.col("root").alias("b")), [*keys, *axes])
    border = cut(border.select(*keys, "a", "b").distinct())
    if border.isEmpty():
        return local
    roots = connected_roots(border, keys).select(*keys, F.col("node").alias("root"), F.col("root").alias("_final"))
    return local.join(roots, [*keys, "root"], "left").withColumn("root", F.coalesce("_final", "root")).drop("_final")


def contract(pairs: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Replace edges (rows of two node numbers) by stars with the same components, rooted at the smallest node.

    With ``group``, one number per edge, all groups go at once and each star has its group as third column.
    """
    if group is None:
        nodes, ends = np.unique(pairs, return_inverse=True)
        groups = None
    else:
        flat, owner = pairs.ravel(), np.repeat(group, 2)
        order = np.lexsort((flat, owner))
        nodes, groups = flat[order], owner[order]
        first = np.ones(len(nodes), bool)
        first[1:] = (nodes[1:] != nodes[:-1]) | (groups[1:] != groups[:-1])
        ends = np.empty(len(nodes), np.int64)
        ends[order] = np.cumsum(first) - 1
        nodes, groups = nodes[first], groups[first]
    left, right = ends.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:
        a, b = root[left], root[right]
        open_ = a != b
        if not open_.any():
            break
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (jumped := root[root]).tobytes() != root.tobytes():
            root = jumped
    leaves = np.flatnonzero(root != np.arange(len(nodes)))
    stars = [nodes[leaves], nodes[root[leaves]]]
    return np.stack(stars if groups is None else [*stars, groups[leaves]], axis=1)


def connected_roots(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node, root) for every node of ``edges(keys, a, b)``; root is the smallest node reachable.

    Edges of one key mostly share a task, so each task first contracts its own, all of its keys
    at once and at most about ``HELD`` at a time; star contraction then joins what is split over
    tasks, for any group size. Its rounds end in one task as soon as no more than ``FEW`` stars are left.
    """
    keys = list(keys)
    plain = edges.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")

    def stars_of(part: pd.DataFrame) -> pd.DataFrame:
        group = part.groupby(keys, sort=False).ngroup().to_numpy()
        known = group >= 0
        group, part = group[known].astype(np.int64), part[known]
        a, b, of = contract(part[["a", "b"]].to_numpy(), group).T
        at = np.zeros(group.max(initial=-1) + 1, np.int64)
        at[group] = np.arange(len(group))
        return part[keys].iloc[at[of]].assign(a=a, b=b)

    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows, due = [], 0, FOLD
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows < due:
                continue
            held = [stars_of(pd.concat(held, ignore_index=True))]
            rows = len(held[0])
            if rows > HELD:
                yield held.pop()
                rows = 0
            due = 2 * rows + FOLD
        if held:
            yield stars_of(pd.concat(held, ignore_index=True))

    stars = cut(plain.hint("rebalance", *keys).mapInPandas(per_task, plain.schema))
    while True:
        if stars.count() <= FEW:
            stars = cut(stars.coalesce(1).mapInPandas(per_task, plain.schema))
            break
        if _is_forest(stars, keys):
            break
        stars = cut(_small_star(_large_star(stars, keys), keys))
    leaves = stars.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"))
    own = edges.select(*keys, F.explode(F.array("a", "b")).alias("node")).distinct()
    return own.join(leaves, [*keys, "node"], "left").withColumn("root", F.coalesce("root", "node"))


def _is_forest(stars: DataFrame, keys: list[str]) -> bool:
    """Stars are final when every leaf has one root and no root is a leaf."""
    ends = F.inline(F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("root")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("root")),
    ))
    counts = stars.select(*keys, ends).groupBy(*keys, "node").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root"))
    return counts.filter("leaf > 1 or (leaf = 1 and root = 1)").isEmpty()


def _large_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest member of the neighbourhood."""
    both = edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy(*keys, "a").agg(F.min("b").alias("_low")).withColumn("_low", F.least("_low", "a"))
    hung = both.join(lowest, [*keys, "a"]).filter("b > a")
    return hung.select(*keys, F.col("b").alias("a"), F.col("_low").alias("b")).distinct()


def _small_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    lowest = edges.groupBy(*keys, "a").agg(F.min("b").alias("_low"))
    moved = edges.join(lowest, [*keys, "a"]).filter("b <> _low").select(*keys, F.col("b").alias("a"), F.col("_low").alias("b"))
    return moved.unionByName(lowest.select(*keys, "a", F.col("_low").alias("b"))).distinct()

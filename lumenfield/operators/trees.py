"""Component trees: the components of many thresholds at once, from one labelling.

The components of a higher threshold lie inside those of a lower one, so all of them form
a forest of nodes (level, first pixel). Every pixel belongs to one node, that of the highest
level it reaches; sizes, maxima and centroids are summed up per node and passed on to the
levels below. Pixels are labelled tile by tile, highest level first; where tiles meet, the
nodes of each level are joined as a small graph.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfield.operators.components import TILE, connected_roots, neighbour_offsets, pixel_code
from lumenfield.operators.raster import offsets_array
from lumenfield.session import cut, dealt


def nested_roots(points: np.ndarray, depth: np.ndarray, offsets: Sequence[tuple[int, ...]]) -> list[np.ndarray]:
    """For each level 1, 2, ... the first point of each point's component among those of at least that depth.

    ``points`` are in raster order; entries of points that don't reach the level mean nothing.
    """
    place = points - points.min(axis=0) + 1
    grid = np.full(tuple(place.max(axis=0) + 2), -1, np.int64)
    grid[tuple(place.T)] = np.arange(len(points))
    pairs = []
    for offset in offsets:
        other = grid[tuple((place + np.asarray(offset)).T)]
        here = np.flatnonzero(other >= 0)
        pairs.append(np.stack([here, other[here]]))
    edges = np.concatenate(pairs, axis=1)
    met = depth[edges].min(axis=0)
    root, levels = np.arange(len(points)), []
    for level in range(int(depth.max()), 0, -1):
        left, right = edges[:, met == level]
        while True:
            a, b = root[left], root[right]
            open_ = a != b
            if not open_.any():
                break
            left, right, a, b = left[open_], right[open_], a[open_], b[open_]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (jumped := root[root]).tobytes() != root.tobytes():
                root = jumped
        levels.append(root.copy())
    return levels[::-1]


def component_tree(
    px: DataFrame, keys: Sequence[str], levels: Column, axes: Sequence[str] = ("y", "x"), connectivity: str = "full", tile: Mapping[str, int] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(pixels with ``depth`` and ``node``, paths of the nodes).

    ``levels`` is a column of ascending thresholds; pixels below the first are left out.
    ``paths`` has (keys, depth, node, level, root) for every node and every level up to its
    own; ``root`` is the code of the first pixel of the component at that level.
    """
    keys, axes = list(keys), list(axes)
    sizes = tile or TILE
    tiles = [f"_t{a}" for a in axes]
    offsets = [o for o in neighbour_offsets(len(axes), connectivity) if o > tuple([0] * len(axes))]
    image, planes = keys[:1], keys[1:]
    stacked = [(0, *o) for o in offsets]
    depth = F.size(F.filter(levels, lambda low: F.col("value") >= low)).alias("depth")
    told_columns = [*px.columns, "depth", "_border", "node", "_path"]
    border = F.lit(False)
    for a in axes:
        border = border | (F.col(a) % sizes[a]).isin(0, sizes[a] - 1)
    reached = px.select("*", depth, pixel_code(axes).alias("_code"), border.alias("_border"), *[F.floor(F.col(a) / sizes[a]).cast("int").alias(t) for a, t in zip(axes, tiles)]).filter("depth > 0")

    def grow(part: pa.Table) -> pa.Table:
        plane = np.zeros(part.num_rows, np.int64)
        for name in planes:
            column = part.column(name).combine_chunks().dictionary_encode()
            plane = plane * len(column.dictionary) + column.indices.to_numpy()
        code = part.column("_code").to_numpy()
        order = np.lexsort((code, plane))
        part, plane, code = part.take(pa.array(order)), plane[order], code[order]
        reach = part.column("depth").to_numpy()
        points = np.stack([plane, *(part.column(a).to_numpy().astype(np.int64) for a in axes)], axis=1)
        roots = nested_roots(points, reach, stacked)
        own = np.stack(roots)[reach - 1, np.arange(len(reach))]
        # one pixel of each node and those at the border carry the way down
        _, first = np.unique(own * (len(roots) + 1) + reach, return_index=True)
        told = part.column("_border").to_numpy().copy()
        told[first] = True
        sizes_ = np.where(told, reach, 0)
        at = np.repeat(np.arange(len(reach)), sizes_)
        level = np.arange(len(at)) - np.repeat(np.cumsum(sizes_) - sizes_, sizes_)
        down = code[np.stack(roots)[level, at]] if len(at) else np.zeros(0, np.int64)
        path = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes_)]).astype(np.int32)), pa.array(down))
        return part.append_column("node", pa.array(code[own])).append_column("_path", path).select(told_columns)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in px.schema), "depth int", "_border boolean", "node bigint", "_path array<bigint>"])
    local = cut(dealt(reached, *image, *tiles).groupBy(*image, *tiles).applyInArrow(grow, schema))

    told = local.filter(F.size("_path") > 0)
    paths = told.select(*keys, "depth", "node", F.posexplode("_path").alias("level", "root")).withColumn("level", F.col("level") + 1).distinct()
    crosses = F.lit(False)
    for a in axes:
        crosses = crosses | (F.floor(F.col(a) / sizes[a]) != F.floor((F.col(a) + F.col(f"_o.d{a}")) / sizes[a]))
    edge = local.filter("_border")
    step = edge.select(*keys, *axes, F.col("_path").alias("_a"), F.explode(offsets_array(offsets, axes)).alias("_o")).filter(crosses)
    step = step.withColumns({a: F.col(a) + F.col(f"_o.d{a}") for a in axes}).drop("_o")
    met = step.join(edge.select(*keys, *axes, F.col("_path").alias("_b")), [*keys, *axes])
    # arrays of different length are padded with NULL: levels that only one side reaches
    links = met.select(*keys, F.posexplode(F.arrays_zip(F.col("_a").alias("a"), F.col("_b").alias("b"))).alias("level", "_l"))
    links = cut(links.select(*keys, (F.col("level") + 1).alias("level"), "_l.a", "_l.b").filter("a is not null and b is not null").distinct())
    pixels = local.drop("_path", "_border")
    if links.isEmpty():
        return pixels, paths
    joined = connected_roots(links, [*keys, "level"]).select(*keys, "level", F.col("node").alias("root"), F.col("root").alias("_final"))
    return pixels, paths.join(joined, [*keys, "level", "root"], "left").withColumn("root", F.coalesce("_final", "root")).drop("_final")


def tree_regions(pixels: DataFrame, paths: DataFrame, keys: Sequence[str], axes: Sequence[str] = ("y", "x")) -> DataFrame:
    """(keys, level, root, n, top, weighted centroid, extent) of all components of all levels, summed up from the nodes."""
    own = pixels.groupBy(*keys, "depth", "node").agg(
        F.count("*").alias("n"), F.max("value").alias("top"), F.sum("value").alias("_w"),
        *[F.sum(F.col("value") * F.col(a)).alias(f"_w{a}") for a in axes], *[f(a).alias(f"{a}{i}") for a in axes for i, f in ((0, F.min), (1, F.max))],
    )
    return own.join(paths, [*keys, "depth", "node"]).groupBy(*keys, "level", "root").agg(
        F.sum("n").alias("n"), F.max("top").alias("top"), *[(F.sum(f"_w{a}") / F.sum("_w")).alias(a) for a in axes],
        *[f(f"{a}{i}").alias(f"{a}{i}") for a in axes for i, f in ((0, F.min), (1, F.max))],
    )

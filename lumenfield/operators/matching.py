"""Matching two channels: range join, overlap admission, one-to-one assignment, overlay."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfield.functions.scalars import half_even
from lumenfield.operators.components import connected_roots
from lumenfield.operators.raster import moved
from lumenfield.session import cut


def centroid_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str], radius: float, axes: Sequence[str] = ("y", "x")
) -> DataFrame:
    """Pairs of centroids within ``radius`` (inclusive): (keys, green_id, red_id, distance).

    An equi-join on grid cells of that size: the left side visits its own and the
    neighbouring cells, the distance is checked on what meets there.
    """
    keys, axes = list(keys), list(axes)
    cells = {f"_c{a}": F.floor(F.col(a) / radius).cast("bigint") for a in axes}
    visits = moved(left.withColumns(cells), list(product((-1, 0, 1), repeat=len(axes))), list(cells))
    visits = visits.select(*keys, *cells, F.col("id").alias("green_id"), *[F.col(a).alias(f"_l{a}") for a in axes])
    homes = right.withColumns(cells).select(*keys, *cells, F.col("id").alias("red_id"), *axes)
    d2 = F.lit(0.0)
    for a in axes:
        d2 = d2 + (F.col(a) - F.col(f"_l{a}")) * (F.col(a) - F.col(f"_l{a}"))
    paired = visits.join(homes, [*keys, *cells]).withColumn("distance", F.sqrt(d2))
    return paired.filter(F.col("distance") <= radius).select(*keys, "green_id", "red_id", "distance")


def near_regions(
    regions: DataFrame, max_distance: float, axes: Sequence[str], pitch: Mapping[str, float],
    shared: Sequence[str], green_keys: Sequence[str], red_keys: Sequence[str],
) -> DataFrame:
    """Green/red pairs of regions within ``max_distance``, with the half-even rounded green centroid in ``_c<axis>``."""
    size = max(float(max_distance), 1.0)
    sides = {}
    for channel, mark, own in (("green", "g", green_keys), ("red", "r", red_keys)):
        cells = [F.floor(F.col(a) * F.lit(float(pitch[a])) / size).cast("bigint").alias(f"_b{a}") for a in axes]
        sides[mark] = regions.filter(F.col("channel") == channel).select(*shared, *own, F.col("id").alias(f"{channel}_id"), *[F.col(a).alias(f"_{mark}{a}") for a in axes], *cells)
    visits = moved(sides["g"], list(product((-1, 0, 1), repeat=len(axes))), [f"_b{a}" for a in axes])
    d2 = F.lit(0.0)
    for a in axes:
        step = (F.col(f"_g{a}") - F.col(f"_r{a}")) * F.lit(float(pitch[a]))
        d2 = d2 + step * step
    met = visits.join(sides["r"], [*shared, *[f"_b{a}" for a in axes]]).withColumn("distance", F.sqrt(d2))
    centres = [half_even(F.col(f"_g{a}")).cast("int").alias(f"_c{a}") for a in axes]
    return met.filter(F.col("distance") <= max_distance).select(*shared, *green_keys, *red_keys, "green_id", "red_id", *centres, "distance")


def row_runs(pixels: DataFrame, keys: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """(keys, all axes but the last, start, stop): the runs of neighbouring pixels along the last axis."""
    rows, last = [*keys, *axes[:-1]], axes[-1]
    marked = pixels.select(*rows, last, (F.col(last) - F.row_number().over(Window.partitionBy(*rows).orderBy(last))).alias("_run"))
    return marked.groupBy(*rows, "_run").agg(F.min(last).alias("start"), F.max(last).alias("stop")).drop("_run")


def admissible_pairs(
    pixels: DataFrame, regions: DataFrame, max_distance: float, dilation: Mapping[str, int], window: Mapping[str, int],
    spacing: Mapping[str, float] | None = None, slack: float = 0.0,
    shared: Sequence[str] = ("image_id",), green_keys: Sequence[str] = (), red_keys: Sequence[str] = (),
) -> DataFrame:
    """Green/red pairs whose centroids are near and whose masks meet after a box dilation.

    The green mask is cut to a window around its half-even rounded centroid before it is
    dilated, and only red pixels inside that window count. Centroids decide first; then the
    rows of near pairs are compared run by run: a green run visits the rows its dilation
    reaches, and meets a red run there if their intervals overlap. So the work follows the
    runs of near regions; ``green_keys``/``red_keys`` carry sweep factors. ``window`` names
    the axes; distances are physical when ``spacing`` is given.
    """
    axes = list(window)
    rows, last = axes[:-1], axes[-1]
    shared, green_keys, red_keys = list(shared), list(green_keys), list(red_keys)
    near = near_regions(regions, max_distance + slack, axes, spacing or dict.fromkeys(axes, 1.0), shared, green_keys, red_keys)

    def runs(channel: str, own: list[str]) -> DataFrame:
        side = pixels.filter(F.col("channel") == channel).select(*shared, *own, F.col("id").alias(f"{channel}_id"), *axes)
        return row_runs(side, [*shared, *own, f"{channel}_id"], axes).withColumnsRenamed({"start": f"_{channel}0", "stop": f"_{channel}1"})

    def beside(axis: str) -> Column:
        return F.abs(F.col(axis) - F.col(f"_c{axis}")) <= window[axis]

    met = near.join(runs("green", green_keys), [*shared, *green_keys, "green_id"])
    for axis in rows:
        met = met.filter(beside(axis)).withColumn(axis, F.explode(F.sequence(F.col(axis) - dilation[axis], F.col(axis) + dilation[axis]))).filter(beside(axis))
    met = met.join(runs("red", red_keys), [*shared, *red_keys, "red_id", *rows])
    # the green run is cut to the window, grown, and cut again
    low, high = F.col(f"_c{last}") - window[last], F.col(f"_c{last}") + window[last]
    start, stop = F.greatest("_green0", low), F.least("_green1", high)
    meets = (start <= stop) & (F.greatest(start - dilation[last], low, "_red0") <= F.least(stop + dilation[last], high, "_red1"))
    return met.filter(meets).select(*shared, *green_keys, *red_keys, "green_id", "red_id", "distance").distinct()


def best_matching(edges: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """Most pairs first, then least total distance, by cheapest augmenting paths; a repeated edge counts at its least distance."""
    costs: dict[int, dict[int, float]] = {}
    for g, r, d in edges:
        row = costs.setdefault(g, {})
        row[r] = min(d, row.get(r, d))
    partner: dict[int, int] = {}
    mate: dict[int, int] = {}
    price_g = dict.fromkeys(costs, 0.0)
    price_r = {r: 0.0 for row in costs.values() for r in row}
    while True:
        free = [g for g in costs if g not in mate]
        queue = [(-price_g[g], 0, g, None) for g in free]
        # reduced costs stay non-negative, so each search is a plain shortest path
        best = {("g", g): -price_g[g] for g in free}
        came: dict[int, int] = {}
        heapq.heapify(queue)
        goal = None
        done = set()
        while queue:
            reach, side, node, _ = heapq.heappop(queue)
            mark = ("g", "r")[side], node
            if mark in done or reach > best[mark]:
                continue
            done.add(mark)
            if side == 0:
                for r, d in costs[node].items():
                    if mate.get(node) == r:
                        continue
                    total = reach + max(0.0, d + price_g[node] - price_r[r])
                    if total < best.get(("r", r), float("inf")):
                        best["r", r] = total
                        came[r] = node
                        heapq.heappush(queue, (total, 1, r, None))
            elif node not in partner:
                end = reach + price_r[node]
                if goal is None or end < goal[0]:
                    goal = (end, node)
            else:
                g = partner[node]
                if reach < best.get(("g", g), float("inf")):
                    best["g", g] = reach
                    heapq.heappush(queue, (reach, 0, g, None))
        if goal is None:
            return sorted(mate.items())
        far = max(best.values())
        for g in price_g:
            price_g[g] += min(best.get(("g", g), far), far)
        for r in price_r:
            price_r[r] += min(best.get(("r", r), far), far)
        node = goal[1]
        while node is not None:
            g = came[node]
            following = mate.get(g)
            mate[g], partner[node] = node, g
            node = following


def one_to_one(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Maximum-cardinality, then minimum-distance matching of an edge list.

    The objective separates by connected component of the edge list. A pair that touches
    no other edge is final; only the rest is sorted and solved per component, whose
    size is bounded by the detections within reach of each other in one frame. Of edges
    that repeat a pair, the least distant one stands for all.
    """
    keys = list(keys)
    pairs = cut(pairs)
    alone_g = pairs.groupBy(*keys, "green_id").agg(F.count("*").alias("_ng"))
    alone_r = pairs.groupBy(*keys, "red_id").agg(F.count("*").alias("_nr"))
    counted = pairs.join(alone_g, [*keys, "green_id"]).join(alone_r, [*keys, "red_id"])
    final = counted.filter("_ng = 1 and _nr = 1").select(*pairs.columns)
    rest = cut(counted.filter("_ng > 1 or _nr > 1").select(*pairs.columns))
    if rest.isEmpty():
        return final
    edges = rest.select(*keys, (F.col("green_id") * 2).alias("a"), (F.col("red_id") * 2 + 1).alias("b"))
    roots = connected_roots(edges, keys)
    grouped = rest.withColumn("node", F.col("green_id") * 2).join(roots, [*keys, "node"]).drop("node")

    names = list(pairs.columns)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # components come one after the other; the last one of a batch may go on in the next
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            marks = [batch[n].to_numpy() for n in (*keys, "root")]
            starts = np.flatnonzero(np.logical_or.reduce([m[1:] != m[:-1] for m in marks])) + 1
            fresh = bool(held) and any(held[-1][n].iloc[-1] != batch[n].iloc[0] for n in (*keys, "root"))
            if fresh:
                yield solved(pd.concat(held), [])
                held = []
            if not len(starts):
                held.append(batch)
                continue
            whole = pd.concat([*held, batch.iloc[: starts[-1]]])
            yield solved(whole, starts[:-1] + (len(whole) - starts[-1]))
            held = [batch.iloc[starts[-1] :]]
        if held:
            yield solved(pd.concat(held), [])

    def solved(part: pd.DataFrame, inner: Sequence[int]) -> pd.DataFrame:
        edges = list(part[["green_id", "red_id", "distance"]].itertuples(index=False, name=None))
        bounds = [0, *inner, len(part)]
        first = ~part.duplicated([*keys, "green_id", "red_id"]).to_numpy()
        keep = np.zeros(len(part), bool)
        for start, stop in zip(bounds[:-1], bounds[1:]):
            chosen = set(best_matching(edges[start:stop]))
            keep[start:stop] = [e[:2] in chosen for e in edges[start:stop]]
        return part.loc[keep & first, names]

    # dealt by component and read as a stream: no call per image or setting
    dealt = grouped.repartition(*keys, "root").sortWithinPartitions(*keys, "root", "green_id", "red_id", "distance")
    return final.unionByName(dealt.mapInPandas(solve, pairs.schema))


def match_objects(regions: DataFrame, matched: DataFrame, keys: Sequence[str], green_keys: Sequence[str] = (), red_keys: Sequence[str] = ()) -> DataFrame:
    """One row per object: all green detections by id, then the unmatched red ones by id.

    ``keys`` identify one matching; with sweeps, ``regions`` must already carry them for
    both channels (see ``cross_factors``).
    """
    keys = list(keys)
    green = regions.filter("channel = 'green'").select(*keys, F.col("id").alias("green_id"), "y", "x", F.col("peak_contrast").alias("green_peak"))
    red = regions.filter("channel = 'red'").select(*keys, F.col("id").alias("red_id"), "y", "x", F.col("peak_contrast").alias("red_peak"))
    pairs = matched.select(*keys, "green_id", "red_id")
    zero = F.lit(0).cast("bigint")
    first = green.join(pairs, [*keys, "green_id"], "left").join(red.drop("y", "x"), [*keys, "red_id"], "left").select(
        *keys, F.lit(0).alias("_part"), F.col("green_id").alias("_id"), "y", "x", "green_id", F.coalesce("red_id", zero).alias("red_id"),
        F.when(F.col("red_id").isNull(), "live_only").otherwise("double_positive").alias("status"),
        "green_peak", F.coalesce(F.col("red_peak"), F.lit(0)).alias("red_peak"),
    )
    second = red.join(pairs.select(*keys, "red_id"), [*keys, "red_id"], "left_anti").select(
        *keys, F.lit(1).alias("_part"), F.col("red_id").alias("_id"), "y", "x", zero.alias("green_id"), "red_id",
        F.lit("dead_only").alias("status"), F.lit(0).alias("green_peak"), "red_peak",
    )
    # one field's detections are bounded by its frame, so this window is too
    order = Window.partitionBy(*keys).orderBy("_part", "_id")
    return first.unionByName(second).withColumn("object_id", F.row_number().over(order).cast("bigint")).drop("_part", "_id")


def object_pixels(pixels: DataFrame, objects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, object_id, y, x) of every object's mask, the union of its channel masks."""
    members = F.array(
        F.struct(F.lit("green").alias("channel"), F.col("green_id").alias("id")),
        F.struct(F.lit("red").alias("channel"), F.col("red_id").alias("id")),
    )
    mapping = objects.select(*keys, "object_id", F.inline(members)).filter("id > 0")
    return pixels.join(mapping, [*keys, "channel", "id"]).select(*keys, "object_id", "y", "x").distinct()


def mask_overlay(masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One label per pixel; the later object (larger id) overwrites the earlier one."""
    return masks.groupBy(*keys, "y", "x").agg(F.max("object_id").alias("object_id"))


def overlay_audit(objects: DataFrame, masks: DataFrame, overlay: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add area, mask_pixels_final, mask_pixels_overwritten and mask_lost to the objects."""
    keys = [*keys, "object_id"]
    area = masks.groupBy(*keys).agg(F.count("*").alias("area"))
    left = overlay.groupBy(*keys).agg(F.count("*").alias("mask_pixels_final"))
    audited = objects.join(area, keys, "left").join(left, keys, "left").withColumns(
        {"area": F.coalesce("area", F.lit(0)), "mask_pixels_final": F.coalesce("mask_pixels_final", F.lit(0))}
    )
    return audited.withColumns(
        {"mask_pixels_overwritten": F.col("area") - F.col("mask_pixels_final"), "mask_lost": F.col("mask_pixels_final") == 0}
    )

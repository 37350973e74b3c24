"""From labelled components to regions: admission, peaks, seeds, splitting, properties."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfield.operators.components import TILE, connected_roots, label_components, neighbour_offsets, pixel_code
from lumenfield.session import cut, dealt

SEED_TILE = {"z": 64, "y": 256, "x": 256}
NO_MARK = np.iinfo(np.int64).max


def component_sizes(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    return labels.groupBy(*keys, "root").agg(F.count("*").alias("area"), F.max("value").alias("peak"))


def admit(labels: DataFrame, keys: Sequence[str], keep: Column) -> DataFrame:
    """Keep the pixels of components whose (area, peak) satisfy ``keep``."""
    good = component_sizes(labels, keys).filter(keep).select(*keys, "root")
    return labels.join(good, [*keys, "root"], "left_semi")


def dense_ids(table: DataFrame, within: Sequence[str], order: Sequence[str], name: str = "id") -> DataFrame:
    """Number the rows of a region table 1, 2, ... per plane; a plane's regions are bounded by its frame."""
    return table.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)).cast("bigint"))


def touching_border(labels: DataFrame, keys: Sequence[str], sizes: Mapping[str, int]) -> DataFrame:
    """Regions (rows of ``keys``) with a pixel on any face of the frame."""
    ends = labels.groupBy(*keys).agg(
        *[F.min(a).alias(f"_{a}0") for a in sizes], *[F.max(a).alias(f"_{a}1") for a in sizes]
    )
    touches = F.lit(False)
    for axis, size in sizes.items():
        touches = touches | (F.col(f"_{axis}0") == 0) | (F.col(f"_{axis}1") == size - 1)
    return ends.filter(touches).select(*keys)


def exclude_border(labels: DataFrame, keys: Sequence[str], sizes: Mapping[str, int]) -> DataFrame:
    return labels.join(touching_border(labels, keys, sizes), list(keys), "left_anti")


# ---------------------------------------------------------------- peaks and seeds


def strongest_first() -> Column:
    """Planar peak order: brightest first, ties to the larger y, then the larger x."""
    return F.struct((-F.col("value")).alias("v"), (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))


def window_maximum(points: DataFrame, targets: DataFrame, keys: Sequence[str], radii: Mapping[str, int]) -> DataFrame:
    """Add ``_most``, the largest value of ``points`` in the box window around each target.

    One axis at a time: every point spreads along an axis and only the maximum per place
    goes on, so the work grows with the sum of the window sides and not with its volume.
    The last axis is looked up from the targets instead.
    """
    keys, axes = list(keys), list(radii)
    spread = points.select(*keys, *axes, F.col("value").alias("_most"))
    for a in axes[:-1]:
        reach = F.explode(F.sequence(F.col(a) - radii[a], F.col(a) + radii[a]))
        spread = spread.withColumn(a, reach).groupBy(*keys, *axes).agg(F.max("_most").alias("_most"))
    last = axes[-1]
    wanted = targets.withColumn("_at", F.explode(F.sequence(F.col(last) - radii[last], F.col(last) + radii[last])))
    met = wanted.select(*keys, *axes, "value", "_at").join(spread.withColumnRenamed(last, "_at"), [*keys, *axes[:-1], "_at"])
    return met.groupBy(*keys, *axes, "value").agg(F.max("_most").alias("_most"))


def inside_boxes(points: DataFrame, boxes: DataFrame, keys: Sequence[str], axes: Sequence[str], tile: int = 32) -> DataFrame:
    """Pair each point with every component whose bounding box holds it (equi-join on coarse tiles)."""
    keys, tiles = list(keys), [f"_t{a}" for a in axes]
    covered = boxes
    for a, t in zip(axes, tiles):
        covered = covered.withColumn(t, F.explode(F.sequence(F.floor(F.col(f"_{a}0") / tile), F.floor(F.col(f"_{a}1") / tile))))
    placed = points.select(*keys, *axes, "value", *[F.floor(F.col(a) / tile).alias(t) for a, t in zip(axes, tiles)])
    held = F.lit(True)
    for a in axes:
        held = held & F.col(a).between(F.col(f"_{a}0"), F.col(f"_{a}1"))
    return placed.join(covered, [*keys, *tiles]).filter(held).select(*keys, "root", *axes, "value")


def local_maxima(
    labels: DataFrame, field: DataFrame, keys: Sequence[str], radii: Mapping[str, int], high: Column
) -> DataFrame:
    """Component pixels >= ``high`` that no pixel of ``field`` inside the window exceeds.

    The window is cut to the component's bounding box; pixels of other components inside
    the box count, cells outside it read zero. Only pixels >= ``high`` can exceed a
    candidate, so nothing else takes part.
    """
    keys, axes = list(keys), list(radii)
    boxes = labels.groupBy(*keys, "root").agg(
        *[F.min(a).alias(f"_{a}0") for a in axes], *[F.max(a).alias(f"_{a}1") for a in axes]
    )
    candidates = labels.filter(F.col("value") >= high).select(*keys, "root", *axes, "value")
    rivals = inside_boxes(field.filter(F.col("value") >= high), boxes, keys, axes)
    return window_maximum(rivals, candidates, [*keys, "root"], radii).filter("value >= _most").drop("_most")


def plateau_peaks(maxima: DataFrame, keys: Sequence[str], spacing: Mapping[str, float], connectivity: str) -> DataFrame:
    """One peak per plateau of adjacent maxima: the member nearest (physically) to the plateau's mean.

    Adjacent maxima lie in the same component, as both use one connectivity.
    """
    axes = list(spacing)
    plateaus = label_components(maxima.withColumnRenamed("root", "_component"), keys, axes, connectivity)
    keys = [*keys, "root"]
    plateaus = plateaus.withColumnsRenamed({"root": "_plateau", "_component": "root"})
    means = plateaus.groupBy(*keys, "_plateau").agg(*[F.avg(a).alias(f"_m{a}") for a in axes])
    away = F.lit(0.0)
    for a in axes:
        away = away + F.pow((F.col(a) - F.col(f"_m{a}")) * F.lit(float(spacing[a])), F.lit(2.0))
    joined = plateaus.join(means, [*keys, "_plateau"]).withColumn("_away", F.round(away, 9))
    best = joined.groupBy(*keys, "_plateau").agg(F.min_by(F.struct(*axes, "value"), F.struct("_away", *axes)).alias("b"))
    return best.select(*keys, "b.*")


def thin_tile(coords: np.ndarray, group: np.ndarray, known: np.ndarray, spacing: Sequence[float], separation: float) -> np.ndarray:
    """Decide the peaks of one tile, strongest first: 1 kept, -1 dropped, 0 open. Rows come in that order.

    ``known`` is 2 for the tile's own peaks and the decision so far for those of its halo.
    A kept peak blocks the ball around it for its own component, an open one marks it as
    uncertain; so every peak is looked at once.
    """
    reach = [max(0, int(np.ceil(separation / s)) - 1) for s in spacing]
    ball = np.zeros([1] * len(reach))
    for axis, (r, s) in enumerate(zip(reach, spacing)):
        shape = [1] * len(reach)
        shape[axis] = -1
        ball = ball + ((np.arange(-r, r + 1) * s) ** 2).reshape(shape)
    ball = ball < separation**2
    place = coords - coords.min(axis=0) + reach
    size = tuple((place.max(axis=0) + np.asarray(reach) + 1).tolist())
    owner = np.full(size, -1, np.int64)
    owner[tuple(place.T)] = group
    blocked, unsure = np.zeros(size, bool), np.zeros(size, bool)
    out = known.copy()
    for i, (at, mine, state) in enumerate(zip(map(tuple, place.tolist()), group.tolist(), known.tolist())):
        if state == 2:
            state = out[i] = -1 if blocked[at] else 0 if unsure[at] else 1
        if state >= 0:
            around = tuple(slice(c - r, c + r + 1) for c, r in zip(at, reach))
            marks = blocked if state else unsure
            marks[around] |= ball & (owner[around] == mine)
    return out


def thin_seeds(
    peaks: DataFrame, keys: Sequence[str], spacing: Mapping[str, float], separation: float, order: Column, tile: Mapping[str, int] | None = None
) -> DataFrame:
    """Greedy minimum-distance thinning, strongest first, inside each component.

    ``order`` sorts ascending from strongest to weakest and has no ties. Each tile decides
    its own peaks in one pass over them. Where tiles meet, a peak may hang on a stronger
    one beyond the border; only those stay open, and the tiles around them are done again
    with what is decided by then. Peaks that are all in one tile need no second pass.
    """
    keys, axes = list(keys), list(spacing)
    sizes = tile or SEED_TILE
    steps = {a: max(0, int(np.ceil(separation / spacing[a])) - 1) for a in axes}
    tiles = [f"_t{a}" for a in axes]
    names = [f"_o{i}" for i in range(len(peaks.select(order.alias("o")).schema["o"].dataType.fields))]
    marked = peaks.withColumn("_order", order)
    marked = marked.select(*keys, "root", *axes, *[F.col(f"_order.{f.name}").alias(n) for f, n in zip(marked.schema["_order"].dataType.fields, names)])

    def around(state: DataFrame) -> DataFrame:
        """Every peak in its tile and in those its ball reaches."""
        for a, t in zip(axes, tiles):
            first, last = (F.floor((F.col(a) + d) / sizes[a]).cast("int") for d in (-steps[a], steps[a]))
            # before the first tile there is none
            state = state.withColumn(t, F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
        return state

    def decide(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(names, ignore_index=True)
        mine = np.ones(len(part), bool)
        for a, t in zip(axes, tiles):
            mine &= (part[a] // sizes[a] == part[t]).to_numpy()
        state = part["_state"].to_numpy(np.int64)
        state = thin_tile(part[axes].to_numpy(np.int64), pd.factorize(part["root"])[0], np.where(mine & (state == 0), 2, state), [float(spacing[a]) for a in axes], separation)
        return part.assign(_state=state)[mine]

    state = marked.withColumn("_state", F.lit(0).cast("bigint"))
    while True:
        placed = around(state)
        decided = cut(dealt(placed, *keys, *tiles).groupBy(*keys, *tiles).applyInPandas(decide, placed.schema).drop(*tiles))
        if decided.filter("_state = 0").isEmpty():
            break
        state = decided
    kept = decided.filter("_state = 1").select(*keys, "root", *axes)
    return peaks.join(kept, [*keys, "root", *axes], "left_semi")


def with_fallback(labels: DataFrame, peaks: DataFrame, keys: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Components without any peak are seeded at their brightest pixel, first in raster order."""
    keys = [*keys, "root"]
    rank = F.struct((-F.col("value")).alias("v"), *axes)
    bare = labels.join(peaks.select(*keys).distinct(), keys, "left_anti")
    brightest = bare.groupBy(*keys).agg(F.min_by(F.struct(*axes, "value"), rank).alias("b")).select(*keys, "b.*")
    return peaks.select(*keys, *axes, "value").unionByName(brightest)


def number_seeds(seeds: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Seed numbers 1, 2, ... per component, strongest first, and how many there are."""
    part = Window.partitionBy(*keys, "root")
    return seeds.withColumn("_o", order).withColumns(
        {"seed": F.row_number().over(part.orderBy("_o")), "parent_count": F.count("*").over(part)}
    ).drop("_o")


# ---------------------------------------------------------------- splitting


def flood(points: np.ndarray, value: np.ndarray, seed: np.ndarray, offsets: Sequence[tuple[int, ...]]) -> np.ndarray:
    """Grow the numbered seeds over a component, brightest pixel first, equal ones first come first served."""
    around = neighbour_index(points, offsets).tolist()
    owner, depth = seed.tolist(), (-value).tolist()
    # first come first served: one queue a level, levels in a heap
    waiting: dict[float, deque[int]] = {}
    levels: list[float] = []

    def join(i: int) -> None:
        if depth[i] not in waiting:
            waiting[depth[i]] = deque()
            heapq.heappush(levels, depth[i])
        waiting[depth[i]].append(i)

    for i in sorted(np.flatnonzero(seed).tolist(), key=owner.__getitem__):
        join(i)
    while levels:
        level = levels[0]
        if not waiting[level]:
            del waiting[heapq.heappop(levels)]
            continue
        i = waiting[level].popleft()
        for j in around[i]:
            if j < len(owner) and not owner[j]:
                owner[j] = owner[i]
                join(j)
    return np.asarray(owner, np.int64)


def neighbour_index(points: np.ndarray, offsets: Sequence[tuple[int, ...]]) -> np.ndarray:
    """For each pixel the row numbers of its neighbours; ``len(points)`` where there is none."""
    place = points - points.min(axis=0) + 1
    index = np.full(tuple(place.max(axis=0) + 2), len(points), np.int64)
    index[tuple(place.T)] = np.arange(len(points))
    return np.stack([index[tuple((place + np.asarray(o)).T)] for o in offsets], axis=1)


def least_neighbour(level: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least (level, mark) of each row."""
    low = level.min(axis=1)
    return low, np.where(level == low[:, None], mark, NO_MARK).min(axis=1)


def lowest_pass(around: np.ndarray, depth: np.ndarray, code: np.ndarray, level: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Relax (level, mark) over a block of pixels until each has the least that reaches it.

    A pixel's level is the lowest pass between it and a seed; its mark is the latest pixel,
    by code, on the way since that level was reached. A flood that takes the lowest level
    first and equal levels by position meets the pixels of one (level, mark) through the
    pixel of that code, which joins its least neighbour. So the owners are those of the
    flood, whatever the order of work.
    """
    n = len(depth)
    level, mark = np.append(level, np.inf), np.append(mark, NO_MARK)
    fresh = np.flatnonzero(np.isfinite(level))
    while len(fresh):
        # pixels beside a change take the least of what their neighbours offer
        at = np.unique(around[fresh])
        at = at[at < n]
        low, seen = least_neighbour(level[around[at]], mark[around[at]])
        rises = depth[at] > low
        seen = np.where(rises, code[at], np.where(np.isinf(low), NO_MARK, np.maximum(seen, code[at])))
        low = np.maximum(low, depth[at])
        better = (low < level[at]) | ((low == level[at]) & (seen < mark[at]))
        fresh = at[better]
        level[fresh], mark[fresh] = low[better], seen[better]
    return level[:-1], mark[:-1]


def owners(code: np.ndarray, mark: np.ndarray, up: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Seeds of the pixels, from mark to mark; 0 where the way leaves the block."""
    order = np.argsort(code)
    to = np.where(mark == code, np.where(seed > 0, code, up), mark)
    at = np.minimum(np.searchsorted(code, to, sorter=order), len(code) - 1)
    step = np.where(code[order[at]] == to, order[at], len(code))
    step = np.append(step, len(code))
    while (jumped := step[step]).tobytes() != step.tobytes():
        step = jumped
    return np.append(seed, 0)[step[:-1]]


def split_planes(crowded: DataFrame, keys: Sequence[str], axes: Sequence[str], offsets: Sequence[tuple[int, ...]], sizes: Mapping[str, int]) -> DataFrame:
    """Owners of the pixels of components with several seeds; ``seed`` is their number at seeds, else 0.

    A tile is relaxed on its own, and components inside one tile are done then. For the
    others the pixels at borders go to the tiles beside them until no level or mark changes;
    the links from marks to marks are a small graph, whose parts hold one seed each.
    """
    keys, axes = list(keys), list(axes)
    tiles = [f"_t{a}" for a in axes]
    start = crowded.withColumns({
        "_level": F.when(F.col("seed") > 0, -F.col("value").cast("double")).otherwise(float("inf")),
        "_mark": F.when(F.col("seed") > 0, pixel_code(axes)).otherwise(int(NO_MARK)),
        "_code": pixel_code(axes),
        "_up": F.lit(int(NO_MARK)),
        "_owner": F.col("seed").cast("bigint"),
        **{t: F.floor(F.col(a) / sizes[a]).cast("int") for a, t in zip(axes, tiles)},
        "_halo": F.lit(False),
        "_new": F.lit(True),
    })

    def relax(part: pd.DataFrame) -> pd.DataFrame:
        # components do not touch, so all of a tile may be relaxed together
        around = neighbour_index(part[axes].to_numpy(np.int64), offsets)
        code, depth, seed = part["_code"].to_numpy(), -part["value"].to_numpy(np.float64), part["seed"].to_numpy(np.int64)
        before, held = part["_level"].to_numpy(), part["_mark"].to_numpy()
        level, mark = lowest_pass(around, depth, code, before, held)
        _, up = least_neighbour(np.append(level, np.inf)[around], np.append(mark, NO_MARK)[around])
        part = part.assign(_level=level, _mark=mark, _up=up, _owner=owners(code, mark, up, seed), _new=(level != before) | (mark != held))
        return part[~part["_halo"].to_numpy(bool)]

    columns = [F.col("_owner").cast(crowded.schema["seed"].dataType).alias("seed") if c == "seed" else c for c in crowded.columns]
    done = cut(dealt(start, *keys, *tiles).groupBy(*keys, *tiles).applyInPandas(relax, start.schema))
    spread = done.groupBy(*keys, "root").agg(*[(F.min(t) < F.max(t)).alias(f"_w{t}") for t in tiles])
    wide = cut(spread.filter(" or ".join(f"_w{t}" for t in tiles)).select(*keys, "root"))
    if wide.isEmpty():
        return done.select(columns)
    inside = done.join(wide, [*keys, "root"], "left_anti").select(columns)
    state = done.join(wide, [*keys, "root"], "left_semi")
    elsewhere = " or ".join(f"floor({a} / {sizes[a]}) <> {t}" for a, t in zip(axes, tiles))
    while True:
        halo = state
        for a, t in zip(axes, tiles):
            reach = [F.floor((F.col(a) + d) / sizes[a]).cast("int") for d in (-1, 1)]
            halo = halo.withColumn(t, F.explode(F.sequence(*reach)))
        both = state.unionByName(halo.filter(elsewhere).withColumn("_halo", F.lit(True)))
        state = cut(dealt(both, *keys, *tiles).groupBy(*keys, *tiles).applyInPandas(relax, start.schema))
        if state.filter("_new").isEmpty():
            break
    links = state.filter("seed = 0 and _mark = _code").select(*keys, F.col("_code").alias("a"), F.col("_up").alias("b"))
    trees = connected_roots(links, keys)
    planted = state.filter("seed > 0").select(*keys, F.col("_code").alias("node"), F.col("seed").cast("bigint").alias("_planted"))
    trees = trees.join(planted, [*keys, "node"], "left").groupBy(*keys, "root").agg(F.collect_list("node").alias("_nodes"), F.max("_planted").alias("_tree"))
    trees = trees.select(*keys, F.explode("_nodes").alias("_mark"), "_tree")
    grown = state.join(planted.withColumnRenamed("node", "_mark"), [*keys, "_mark"], "left").join(trees, [*keys, "_mark"], "left")
    return inside.unionByName(grown.withColumn("_owner", F.coalesce("_planted", "_tree")).select(columns))


def split_regions(
    labels: DataFrame, seeds: DataFrame, keys: Sequence[str], axes: Sequence[str], connectivity: str = "full", by_age: bool = False,
    tile: Mapping[str, int] | None = None,
) -> DataFrame:
    """Add ``seed`` and ``parent_count``: which seed of its component a pixel belongs to.

    A component with one seed is one region and never leaves the JVM. Of the others, each
    pixel goes to the seed with the lowest pass to it, tile by tile. With ``by_age`` equal
    levels go first come first served instead, which hangs on the whole history of a
    component: those that start in the same band of 256 rows of a frame are flooded together.
    """
    keys, axes = list(keys), list(axes)
    offsets = sorted(neighbour_offsets(len(axes), connectivity), key=lambda o: sum(map(abs, o)))
    columns = [*labels.columns, "seed", "parent_count"]
    counts = seeds.filter("seed = 1").select(*keys, "root", "parent_count")
    joined = labels.join(counts, [*keys, "root"])
    single = joined.filter("parent_count = 1").withColumn("seed", F.lit(1)).select(columns)
    crowded = joined.filter("parent_count > 1").join(
        seeds.filter("parent_count > 1").select(*keys, "root", *axes, "seed"), [*keys, "root", *axes], "left"
    )
    crowded = crowded.withColumn("seed", F.coalesce("seed", F.lit(0))).select(columns)
    if not by_age:
        return single.unionByName(split_planes(crowded, keys, axes, offsets, tile or TILE))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(axes, ignore_index=True)
        owner = flood(part[axes].to_numpy(np.int64), part["value"].to_numpy(), part["seed"].to_numpy(), offsets)
        return part.assign(seed=owner)

    band = F.shiftright("root", 29).alias("_band")
    return single.unionByName(dealt(crowded, *keys, band).groupBy(*keys, band).applyInPandas(grow, crowded.schema))


def region_props(
    labels: DataFrame, keys: Sequence[str], region: Sequence[str], axes: Sequence[str] = ("y", "x"),
    weight: str | None = "value", raw: str = "raw",
) -> DataFrame:
    """Area, (weighted) centroid, peak contrast and raw statistics per region."""
    if weight:
        centre = [(F.sum(F.col(weight) * F.col(a)) / F.sum(weight)).alias(a) for a in axes]
    else:
        centre = [F.avg(a).alias(a) for a in axes]
    extra = [F.max("parent_count").alias("parent_count")] if "parent_count" in labels.columns else []
    return labels.groupBy(*keys, *region).agg(
        *centre, F.count("*").alias("area"), F.max("value").alias("peak_contrast"),
        F.avg(raw).alias("mean_raw"), F.max(raw).alias("max_raw"), *extra,
    )


def segment(
    field: DataFrame, keys: Sequence[str], low: Column, high: Column, min_area: Column,
    shape: tuple[int, int], peak_window: int = 7, min_distance: float = 6, exclude_edges: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Segment planes of working contrast: (label pixels with ``id``, region table).

    ``field(keys, y, x, value, raw)`` may hold several planes per image; ``low``, ``high``
    and ``min_area`` are columns, so one pass can sweep channels and threshold factors.
    """
    keys = list(keys)
    labels = label_components(field.filter(F.col("value") >= low), keys)
    limits = labels.groupBy(*keys, "root").agg(
        F.count("*").alias("_n"), F.max("value").alias("_top"), F.first(high).alias("_high"), F.first(min_area).alias("_min")
    )
    good = limits.filter("_n >= _min and _top >= _high").select(*keys, "root")
    labels = cut(labels.join(good, [*keys, "root"], "left_semi"))
    maxima = local_maxima(labels, field, keys, {"y": peak_window // 2, "x": peak_window // 2}, high)
    strongest = strongest_first()
    kept = thin_seeds(cut(maxima), keys, {"y": 1.0, "x": 1.0}, min_distance, strongest)
    seeds = cut(number_seeds(with_fallback(labels, kept, keys, ["y", "x"]), keys, strongest))
    pieces = cut(split_regions(labels, seeds, keys, ["y", "x"]))
    region = ["root", "seed"]
    props = region_props(pieces.withColumn("_min", min_area), keys, region)
    smallest = pieces.groupBy(*keys, *region).agg(F.first(min_area).alias("_min"), F.count("*").alias("_n"))
    props = props.join(smallest.filter("_n >= _min").select(*keys, *region), [*keys, *region], "left_semi")
    if exclude_edges:
        props = props.join(touching_border(pieces, [*keys, *region], {"y": shape[0], "x": shape[1]}), [*keys, *region], "left_anti")
    props = cut(dense_ids(props, keys, region))
    pixels = pieces.join(props.select(*keys, *region, "id"), [*keys, *region]).drop(*region, "parent_count")
    return pixels, props.drop(*region)

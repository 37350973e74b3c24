"""Raster neighbourhood operators over sparse pixel tables.

A raster is a table of non-zero pixels (keys..., [z], y, x, value). Everything that
works per pixel, per row run or per offset stays in Spark expressions; only the dense
convolution runs on NumPy blocks, and each block is a strip of one frame.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfield.functions.scalars import total
from lumenfield.session import dealt

LINES = 64
SHORT_RUN = 32
SLAB = 16

# ---------------------------------------------------------------- smoothing


def gaussian_weights(sigma: float) -> np.ndarray:
    """Normalised weights out to four standard deviations."""
    radius = int(4 * sigma + 0.5)
    offsets = np.arange(-radius, radius + 1)
    weights = np.exp(-0.5 * (offsets / sigma) ** 2)
    return weights / weights.sum()


def convolve_last(block: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian along the last axis with half-sample symmetric borders."""
    weights = gaussian_weights(sigma)
    radius = len(weights) // 2
    padded = np.pad(block, [(0, 0)] * (block.ndim - 1) + [(radius, radius)], mode="symmetric")
    width = block.shape[-1]
    out = np.zeros_like(block)
    for i, weight in enumerate(weights):
        out += weight * padded[..., i : i + width]
    return out


def _ddl(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def smooth_planes(
    px: DataFrame, keys: Sequence[str], sigmas: Mapping[str, tuple[float, float]],
    shape: tuple[int, int], block: int = 64, deep: tuple[float, int] | None = None,
) -> DataFrame:
    """Dense smoothed planes: one column per entry of ``sigmas`` = {name: (sigma_y, sigma_x)}.

    With ``deep`` = (sigma, depth) the last key is z, stacks are whole and at most ``SLAB`` planes
    deep, and the strips, which then hold them whole, are smoothed along z as well.

    Row bands are smoothed along x and cut into column strips; the strips are then
    smoothed along y. A call holds ``block`` rows or columns of the planes of one image,
    no pixel is sent to more than one block, and an image may be spread over many tasks.
    """
    keys, names = list(keys), list(sigmas)
    height, width = shape
    image, planes = keys[:1], keys[1:]

    def along_x(key: tuple, band: pd.DataFrame) -> pd.DataFrame:
        rows, row = _stacks(band, [*planes, "y"])
        dense = np.zeros((len(rows), width))
        dense[row, band["x"].to_numpy()] = band["value"].to_numpy()
        smooth = {n: convolve_last(dense, sigmas[n][1]) for n in names}
        parts = []
        for strip in range(math.ceil(width / block)):
            columns = slice(strip * block, (strip + 1) * block)
            part = rows.assign(strip=strip)
            for n in names:
                part[n] = list(smooth[n][:, columns])
            parts.append(part)
        out = pd.concat(parts, ignore_index=True)
        out.insert(0, image[0], key[0])
        return out[[*keys, "strip", "y", *names]]

    def along_y(key: tuple, strip: pd.DataFrame) -> pd.DataFrame:
        start = key[-1] * block
        wide = min(block, width - start)
        stack, plane = _stacks(strip, planes)
        grid_y, grid_x = np.mgrid[0:height, start : start + wide]
        n_planes, size = max(1, len(stack)), height * wide
        out = {"y": np.tile(grid_y.ravel(), n_planes), "x": np.tile(grid_x.ravel(), n_planes)}
        for n in names:
            dense = np.zeros((n_planes, wide, height))
            dense[plane, :, strip["y"].to_numpy()] = np.stack(strip[n].to_numpy())
            smooth = convolve_last(dense, sigmas[n][0]).transpose(0, 2, 1)
            if deep:
                order = stack.sort_values(planes).index.to_numpy()
                columns = smooth[order].reshape(-1, deep[1], size).transpose(0, 2, 1)
                smooth[order] = convolve_last(columns, deep[0]).transpose(0, 2, 1).reshape(smooth.shape)
            out[n] = smooth.ravel()
        out = pd.DataFrame(out)
        out[image[0]] = key[0]
        for name in planes:
            out[name] = np.repeat(stack[name].to_numpy(), size)
        return out[[*keys, "y", "x", *names]]

    head = _ddl(px, keys)
    # so many planes of a stack at most share a call
    slab = [F.floor(F.col("z") / SLAB).alias("_slab")] if "z" in planes else []
    strips = (
        px.select(*keys, "y", "x", F.col("value").cast("double").alias("value"), F.floor(F.col("y") / block).cast("int").alias("band"))
        .groupBy(*image, *slab, "band")
        .applyInPandas(along_x, f"{head}, strip int, y int, " + ", ".join(f"{n} array<double>" for n in names))
    )
    return strips.groupBy(*image, *slab, "strip").applyInPandas(
        along_y, f"{head}, y int, x int, " + ", ".join(f"{n} double" for n in names)
    )


def _stacks(part: pd.DataFrame, names: Sequence[str]) -> tuple[pd.DataFrame, np.ndarray]:
    """Distinct rows of ``names`` and the position of each row of ``part`` among them."""
    if not names:
        return pd.DataFrame(index=[0]), np.zeros(len(part), np.int64)
    grouped = part.groupby(list(names), sort=False)
    return part[list(names)].drop_duplicates(ignore_index=True), grouped.ngroup().to_numpy()


def smooth_depth(dense: DataFrame, keys: Sequence[str], name: str, sigma: float, depth: int, block: int = 16) -> DataFrame:
    """Smooth ``name`` along z; a block is a square of ``block`` columns of one volume."""
    keys = list(keys)

    def along_z(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["y", "x", "z"], ignore_index=True)
        columns = part[name].to_numpy().reshape(-1, depth)
        part[name] = convolve_last(columns, sigma).ravel()
        return part[[*keys, "z", "y", "x", name]]

    cut = dense.select(*keys, "z", "y", "x", name).withColumns(
        {"_by": F.floor(F.col("y") / block), "_bx": F.floor(F.col("x") / block)}
    )
    return cut.groupBy(*keys, "_by", "_bx").applyInPandas(along_z, f"{_ddl(dense, keys)}, z int, y int, x int, {name} double")


def smooth_volume(
    voxels: DataFrame, keys: Sequence[str], sigma_um: float, spacing: tuple[float, float, float], shape: tuple[int, int, int]
) -> DataFrame:
    """Physical Gaussian: sigma per axis is ``sigma_um / spacing`` (z, y, x); planes without pixels are kept."""
    sz, sy, sx = (sigma_um / s for s in spacing)
    stacked = with_empty_planes(voxels, keys, shape[0])
    if shape[0] <= SLAB:
        return smooth_planes(stacked, [*keys, "z"], {"value": (sy, sx)}, shape[1:], deep=(sz, shape[0]))
    planes = smooth_planes(stacked, [*keys, "z"], {"value": (sy, sx)}, shape[1:])
    return smooth_depth(planes, keys, "value", sz, shape[0])


def with_empty_planes(voxels: DataFrame, keys: Sequence[str], depth: int) -> DataFrame:
    """Add one zero voxel per plane so that every plane of a stack exists."""
    z = F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))
    floor = voxels.select(*keys).distinct().select(
        *keys, z.alias("z"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(0).cast(voxels.schema["value"].dataType).alias("value")
    )
    return voxels.select(*keys, "z", "y", "x", "value").unionByName(floor).groupBy(*keys, "z", "y", "x").agg(F.max("value").alias("value"))


def contrast(
    px: DataFrame, sigma: Mapping[str, float], background: float, shape: tuple[int, int], keys: Sequence[str] = ("image_id", "channel")
) -> DataFrame:
    """Background-subtracted working contrast, per plane: smooth(sigma of the channel) - smooth(background)."""
    parts = None
    for channel, width in sigma.items():
        planes = smooth_planes(
            px.filter(F.col("channel") == channel), keys, {"near": (width, width), "far": (background, background)}, shape
        )
        part = planes.withColumn("contrast", F.col("near") - F.col("far")).drop("near", "far")
        parts = part if parts is None else parts.unionByName(part)
    return parts


# ---------------------------------------------------------------- neighbourhoods


def offsets_array(offsets: Sequence[tuple[int, ...]], axes: Sequence[str]) -> Column:
    """A literal array of offset structs; its length is a parameter, not data."""
    return F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for v, a in zip(o, axes)]) for o in offsets])


def square(radius: int) -> list[tuple[int, int]]:
    span = range(-radius, radius + 1)
    return [(a, b) for a in span for b in span]


def cross(iterations: int) -> list[tuple[int, int]]:
    return [(a, b) for a, b in square(iterations) if abs(a) + abs(b) <= iterations]


def moved(px: DataFrame, offsets: Sequence[tuple[int, ...]], axes: Sequence[str] = ("y", "x")) -> DataFrame:
    """One row per pixel and offset, with the axes shifted."""
    out = px.withColumn("_o", F.explode(offsets_array(offsets, axes)))
    return out.withColumns({a: F.col(a) + F.col(f"_o.d{a}") for a in axes}).drop("_o")


def inside(shape: tuple[int, ...], axes: Sequence[str] = ("y", "x")) -> Column:
    condition = F.lit(True)
    for axis, size in zip(axes, shape):
        condition = condition & F.col(axis).between(0, size - 1)
    return condition


def dilate(
    px: DataFrame, keys: Sequence[str], offsets: Sequence[tuple[int, ...]], shape: tuple[int, ...], axes: Sequence[str] = ("y", "x")
) -> DataFrame:
    """Binary dilation of each key's mask by ``offsets``, clipped to the frame."""
    grown = moved(px.select(*keys, *axes), offsets, axes)
    return grown.filter(inside(shape, axes)).distinct()


def circular_shift(px: DataFrame, dy: int, dx: int, shape: tuple[int, int]) -> DataFrame:
    return px.withColumns(
        {"y": F.pmod(F.col("y") + dy, F.lit(shape[0])), "x": F.pmod(F.col("x") + dx, F.lit(shape[1]))}
    )


def label_boundaries(labels: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Foreground pixels with at least one 4-neighbour of another label, background or outside the frame."""
    same = F.lit(0)
    for along, across in (("x", "y"), ("y", "x")):
        line = Window.partitionBy(*keys, across).orderBy(along)
        for step in (-1, 1):
            neighbour = (F.lead(along, 1).over(line) if step == 1 else F.lag(along, 1).over(line)) == F.col(along) + step
            equal = (F.lead(label, 1).over(line) if step == 1 else F.lag(label, 1).over(line)) == F.col(label)
            same = same + F.coalesce((neighbour & equal).cast("int"), F.lit(0))
    return labels.withColumn("_same", same).filter("_same < 4").drop("_same")


def outline_segments(labels: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Unit pixel edges between different labels: (orientation, y0, x0, y1, x1) in half-pixel coordinates."""
    found = None
    for along, across, name in (("x", "y", "vertical"), ("y", "x", "horizontal")):
        line = Window.partitionBy(*keys, across).orderBy(along)
        before = F.when(F.lag(along).over(line) == F.col(along) - 1, F.lag(label).over(line))
        after = F.when(F.lead(along).over(line) == F.col(along) + 1, F.lead(label).over(line))
        # each edge is written once: by the pixel behind it, or by the last pixel before background
        sides = F.array_compact(F.array(
            F.when(~F.col("_before").eqNullSafe(F.col(label)), F.lit(-0.5)), F.when(F.col("_after").isNull(), F.lit(0.5)),
        ))
        paired = labels.withColumns({"_before": before, "_after": after})
        edge = paired.select(*keys, "y", "x", F.explode(sides).alias("side"))
        at, low, high = F.col(along) + F.col("side"), F.col(across) - 0.5, F.col(across) + 0.5
        start, stop = {f"{along}0": at, f"{across}0": low}, {f"{along}1": at, f"{across}1": high}
        part = edge.select(*keys, F.lit(name).alias("orientation"), *[v.alias(n) for n, v in sorted({**start, **stop}.items())])
        found = part if found is None else found.unionByName(part)
    return found


def lower_envelope(height: np.ndarray, pitch: float) -> np.ndarray:
    """min over q of height[q] + (pitch * (p - q))**2 for every p, in time linear in the length.

    The parabolas that are lowest somewhere are kept in order with where each takes over.
    """
    scale = pitch * pitch
    lifted = (height / scale + np.arange(len(height)) ** 2.0).tolist()
    held, since = [0], [-np.inf]
    for q in range(1, len(lifted)):
        while True:
            p = held[-1]
            at = (lifted[q] - lifted[p]) / (2 * (q - p))
            if at > since[-1]:
                break
            held.pop()
            since.pop()
        held.append(q)
        since.append(at)
    at = np.arange(len(height))
    # beside a hand-over rounding may favour the wrong neighbour, so both are tried
    first = np.searchsorted(np.asarray(since), at, "right") - 1
    best = np.full(len(height), np.inf)
    for k in (first - 1, first, first + 1):
        q = np.asarray(held)[np.clip(k, 0, len(held) - 1)]
        steps = np.abs(at - q)
        best = np.minimum(best, steps * steps * scale + height[q])
    return best


def run_minima(start: np.ndarray, size: np.ndarray, height: np.ndarray, pitch: float) -> np.ndarray:
    """For runs of ``height`` (beginning at ``start``) the least of height + squared distance along the run, both ends being zero just outside."""
    out = np.empty(len(height))
    place = np.arange(len(height)) - np.repeat(start, size)
    edge = np.minimum(place + 1, np.repeat(size, size) - place).astype(float)
    for length in np.unique(size[size <= SHORT_RUN]).tolist():
        # short runs of one length together, every cell against every other
        rows = start[size == length][:, None] + np.arange(length)
        steps = np.abs(np.subtract.outer(np.arange(length), np.arange(length)))
        for part in np.array_split(rows, len(rows) * length * length // (1 << 22) + 1):
            out[part] = (height[part][:, None, :] + steps * steps * (pitch * pitch)).min(axis=2)
    for a, n in zip(start[size > SHORT_RUN].tolist(), size[size > SHORT_RUN].tolist()):
        out[a : a + n] = lower_envelope(height[a : a + n], pitch)
    return np.minimum(out, edge * edge * (pitch * pitch))


def _along(axis: str, others: Sequence[str], label: str, pitch: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Lower ``_d2`` of a band of lines along ``axis``, run by run."""

    def lower(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([*others, axis], ignore_index=True)
        place = part[axis].to_numpy()
        breaks = np.ones(len(part), bool)
        breaks[1:] = place[1:] != place[:-1] + 1
        for name in [*others, label]:
            breaks[1:] |= part[name].to_numpy()[1:] != part[name].to_numpy()[:-1]
        start = np.flatnonzero(breaks)
        return part.assign(_d2=run_minima(start, np.diff(np.append(start, len(part))), part["_d2"].to_numpy(), pitch))

    return lower


def distance_to_background(
    labels: DataFrame, keys: Sequence[str], spacing: Mapping[str, float], label: str = "root"
) -> DataFrame:
    """Euclidean distance (physical units) of each labelled voxel to the nearest voxel of another label.

    Separable: exact distance along the innermost axis from its run, then per axis the
    lower envelope of parabolas over the contiguous run only, since the run's ends are
    background already. Lines go to tasks by bands of ``LINES`` on each other axis; a line
    is as long as its frame, and the work is linear in it.
    """
    axes = list(spacing)
    keys = list(keys)
    last = axes[-1]
    line = Window.partitionBy(*keys, label, *axes[:-1]).orderBy(last)
    work = labels.select(*keys, label, *axes, (F.col(last) - F.row_number().over(line)).alias("_run"))
    run = Window.partitionBy(*keys, label, *axes[:-1], "_run")
    steps = F.least(F.col(last) - F.min(last).over(run), F.max(last).over(run) - F.col(last)) + 1
    pitch = float(spacing[last])
    work = work.withColumn("_d2", (steps * pitch) * (steps * pitch)).drop("_run")
    for axis in reversed(axes[:-1]):
        others = [a for a in axes if a != axis]

        bands = [F.floor(F.col(a) / LINES).alias(f"_l{a}") for a in others]
        work = dealt(work, *keys, *bands).groupBy(*keys, *bands).applyInPandas(_along(axis, others, label, float(spacing[axis])), work.schema)
    return work.withColumn("distance", F.sqrt("_d2")).select(*keys, label, *axes, "distance")


# ---------------------------------------------------------------- selections and statistics


def max_projection(voxels: DataFrame, keys: Sequence[str], z_start: int | None = None, z_stop: int | None = None) -> DataFrame:
    """Maximum over the planes z_start <= z < z_stop; zero pixels are absent as everywhere."""
    if z_start is not None:
        voxels = voxels.filter(F.col("z") >= z_start)
    if z_stop is not None:
        voxels = voxels.filter(F.col("z") < z_stop)
    return voxels.groupBy(*keys, "y", "x").agg(F.max("value").alias("value"))


def decimate(px: DataFrame, frames: DataFrame, limit: int, key: str = "image_id") -> DataFrame:
    """Every k-th row and column, k = ceil(longer side / limit); ``frames`` gives h and w per image."""
    k = F.greatest(F.lit(1), F.ceil(F.greatest("h", "w") / F.lit(limit)).cast("int"))
    strides = frames.select(key, k.alias("k"))
    return px.join(strides, key).filter("y % k = 0 and x % k = 0").drop("k")


def projection_reconcile(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per plane: how many pixels differ between a stored projection and the recomputed one."""
    a = stored.select(*keys, "y", "x", F.col("value").alias("_a"), F.lit(None).cast("int").alias("_b"))
    b = recomputed.select(*keys, "y", "x", F.lit(None).cast("int").alias("_a"), F.col("value").alias("_b"))
    pixels = a.unionByName(b).groupBy(*keys, "y", "x").agg(
        F.coalesce(F.max("_a"), F.lit(0)).alias("_a"), F.coalesce(F.max("_b"), F.lit(0)).alias("_b")
    )
    counted = pixels.groupBy(*keys).agg(F.count("*").alias("n_pixels"), total(F.col("_a") != F.col("_b")).alias("n_different"))
    return counted.withColumn("equal", F.col("n_different") == 0)


def raster_contract(px: DataFrame, frames: DataFrame, keys: Sequence[str] = ("image_id", "channel"), required: Sequence[str] = ("green", "red")) -> DataFrame:
    """First broken contract rule of each plane against the declared frame and value range.

    ``frames`` declares the planes by ``keys``, the last of which is the channel. A declared
    plane without a pixel is a measured zero. Pixels of a plane that is not declared and
    ``required`` channels that a declared field has neither declared nor filled are faults.
    """
    field, channel = list(keys[:-1]), keys[-1]
    seen = px.groupBy(*keys).agg(
        F.count("*").alias("n_pixels"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"),
        F.max("x").alias("x1"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        total(F.isnan(F.col("value").cast("double")) | F.col("value").isNull()).alias("bad"),
    )
    wanted = frames.select(*field).distinct().withColumn(channel, F.explode(F.array(*[F.lit(c) for c in required])))
    declared = frames.withColumn("_declared", F.lit(True)).join(wanted, list(keys), "full")
    checked = declared.join(seen, list(keys), "full")
    verdict = (
        F.when(F.col("_declared").isNull(), F.when(F.col("n_pixels").isNull(), "missing").otherwise("undeclared"))
        .when(F.col("bad") > 0, "not_finite")
        .when((F.col("y0") < 0) | (F.col("x0") < 0) | (F.col("y1") >= F.col("h")) | (F.col("x1") >= F.col("w")), "outside_frame")
        .when((F.col("lo") < 0) | (F.col("hi") > F.col("value_max")), "outside_type")
        .otherwise("ok")
    )
    return checked.select(*keys, F.coalesce("n_pixels", F.lit(0)).alias("n_pixels"), verdict.alias("verdict"))


def infer_shape(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest frame and unsigned type that hold a field's pixels."""
    top = px.groupBy(*keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.max("value").alias("value_max"))
    kind = F.when(F.col("value_max") < 256, "uint8").when(F.col("value_max") < 65536, "uint16").otherwise("unsupported")
    return top.withColumn("dtype", kind)


def histogram(px: DataFrame, keys: Sequence[str], size: int, planes: DataFrame | None = None) -> DataFrame:
    """Pixels per intensity level including zero; at most one row per level of the pixel type.

    ``planes`` declares the planes by their keys, those without a pixel too; else those in ``px`` count.
    """
    levels = px.filter("value <> 0").groupBy(*keys, "value").agg(F.count("*").alias("pixels"))
    found = px.groupBy(*keys).agg(F.count_if(F.col("value") != 0).alias("_found"))
    if planes is not None:
        found = found.join(planes.select(*keys).distinct(), list(keys), "full")
    zeros = found.withColumn("pixels", F.lit(size) - F.coalesce("_found", F.lit(0)))
    zeros = zeros.filter("pixels > 0").select(*keys, F.lit(0).cast(px.schema["value"].dataType).alias("value"), "pixels")
    return levels.unionByName(zeros)


def intensity_diagnostics(px: DataFrame, keys: Sequence[str], size: int, points: Sequence[float], planes: DataFrame | None = None) -> DataFrame:
    """Distinct levels and exact linear percentiles of the dense raster."""
    names = ["p" + str(p).rstrip("0").rstrip(".").replace(".", "_") for p in points]
    grouped = histogram(px, keys, size, planes).groupBy(*keys).agg(
        F.count("*").alias("n_levels"),
        F.percentile("value", F.array(*[F.lit(p / 100.0) for p in points]), F.col("pixels")).alias("v"),
    )
    return grouped.select(*keys, "n_levels", *[F.col("v")[i].alias(n) for i, n in enumerate(names)])


def top_levels(px: DataFrame, keys: Sequence[str], size: int, k: int = 12, planes: DataFrame | None = None) -> DataFrame:
    """The ``k`` most common levels; ties go to the brighter level."""
    order = Window.partitionBy(*keys).orderBy(F.desc("pixels"), F.desc("value"))
    ranked = histogram(px, keys, size, planes).withColumn("position", F.row_number().over(order))
    return ranked.filter(F.col("position") <= k).withColumn("percent", F.col("pixels") * 100.0 / F.lit(size))


def raster_profile(px: DataFrame, keys: Sequence[str], size: int, saturated: int = 255, planes: DataFrame | None = None) -> DataFrame:
    level = F.col("value")
    n = F.coalesce(F.sum(F.when(level != 0, F.col("pixels"))), F.lit(0).cast("long"))
    stats = histogram(px, keys, size, planes).groupBy(*keys).agg(
        F.min("value").alias("minimum"), F.max("value").alias("maximum"), ((F.lit(size) - n) / F.lit(size)).alias("zero_fraction"),
        F.coalesce(F.sum(F.when(level >= saturated, F.col("pixels"))), F.lit(0).cast("long")).alias("saturated_pixels"),
    )
    return stats.select(*keys, "minimum", "maximum", "zero_fraction", "saturated_pixels")


def suggest_thresholds(
    voxels: DataFrame, keys: Sequence[str], shape: tuple[int, int, int], detector_max: int, spacing: tuple[float, float, float],
    planes: DataFrame | None = None,
) -> DataFrame:
    """Starting thresholds from all voxels: low/high at 20 % and 50 % of the median-to-bright span."""
    grouped = histogram(voxels, keys, math.prod(shape), planes).groupBy(*keys).agg(
        F.percentile("value", F.array(F.lit(0.5), F.lit(0.999)), F.col("pixels")).alias("v")
    )
    base, bright = F.col("v")[0], F.col("v")[1]
    span = F.greatest(bright - base, F.lit(detector_max * 0.025))
    low = F.least(F.lit(float(detector_max)), F.greatest(F.lit(1.0), base + 0.2 * span))
    high = F.least(F.lit(float(detector_max)), F.greatest(low, base + 0.5 * span))
    volume = max(10.0, round(3 * math.prod(spacing), 6))
    return grouped.select(*keys, F.round(low, 3).alias("low"), F.round(high, 3).alias("high"), F.lit(volume).alias("min_volume_um3"))


def display_level(value: Column, low: Column, high: Column) -> Column:
    """Linear display mapping clipped to 0..1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low)))


def display_byte(value: Column, low: Column, high: Column) -> Column:
    """The same mapping on 0..255, truncated as a byte image stores it."""
    scaled = (value - low) * (F.lit(255.0) / (high - low))
    return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), scaled))).cast("int")


def composite(px: DataFrame, bounds: Mapping[str, tuple[float, float]], keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Red/green display levels per pixel; a channel without signal there shows its zero level."""
    def level(channel: str) -> Column:
        low, high = bounds[channel]
        value = F.coalesce(F.max(F.when(F.col("channel") == channel, F.col("value"))), F.lit(0))
        return display_level(value, F.lit(float(low)), F.lit(float(high))).alias(channel)

    return px.groupBy(*keys, "y", "x").agg(*[level(c) for c in bounds])


def orthogonal_sections(voxels: DataFrame, points: DataFrame, key: str = "image_id") -> DataFrame:
    """The XY, XZ and YZ sections through one point (z0, y0, x0) per image, in one pass."""
    tagged = voxels.join(points, key).withColumn(
        "section",
        F.explode(F.array_compact(F.array(
            F.when(F.col("z") == F.col("z0"), "xy"), F.when(F.col("y") == F.col("y0"), "xz"), F.when(F.col("x") == F.col("x0"), "yz"),
        ))),
    )
    return tagged.drop("z0", "y0", "x0")


def clamp_start(center: Column, size: int, full: int) -> Column:
    """First index of a window of ``size`` around ``center`` that stays inside ``full``."""
    return F.least(F.greatest(center - size // 2, F.lit(0)), F.lit(full - size))


def central_crop(px: DataFrame, fraction: float, shape: tuple[int, int]) -> DataFrame:
    """The centred window holding ``fraction`` of each side."""
    for axis, full in zip(("y", "x"), shape):
        size = max(1, round(full * fraction))
        start = (full - size) // 2
        px = px.filter(F.col(axis).between(start, start + size - 1))
    return px


def depth_profile(
    voxels: DataFrame, rois: DataFrame, shape: tuple[int, int, int], samples: int | None = None, key: str = "image_id"
) -> DataFrame:
    """Mean raw value per channel and plane inside a clipped square ROI (y0, x0, radius); ``samples`` evenly spaced planes if given."""
    depth, height, width = shape
    n = depth if samples is None else min(depth, samples)
    step = (depth - 1) / max(n - 1, 1)
    planes = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.lit(step)).cast("int")))
    clipped = rois.select(
        key,
        F.greatest(F.lit(0), F.col("y0") - F.col("radius")).alias("ya"), F.least(F.lit(height - 1), F.col("y0") + F.col("radius")).alias("yb"),
        F.greatest(F.lit(0), F.col("x0") - F.col("radius")).alias("xa"), F.least(F.lit(width - 1), F.col("x0") + F.col("radius")).alias("xb"),
    )
    joined = voxels.join(clipped, key)
    sums = joined.groupBy(key, "channel", "z").agg(
        F.sum(F.when(F.col("y").between(F.col("ya"), F.col("yb")) & F.col("x").between(F.col("xa"), F.col("xb")), F.col("value"))).alias("s")
    )
    wanted = voxels.select(key, "channel").distinct().join(clipped, key).select(
        key, "channel", F.explode(planes).alias("z"), ((F.col("yb") - F.col("ya") + 1) * (F.col("xb") - F.col("xa") + 1)).alias("area")
    )
    return wanted.join(sums, [key, "channel", "z"], "left").select(
        key, "channel", "z", (F.coalesce(F.col("s"), F.lit(0)) / F.col("area")).alias("mean")
    )


def point_lookup(points: DataFrame, labels: DataFrame, shape: tuple[int, int], label: str = "label", keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Object under each point inside the frame; 0 is background."""
    visible = points.filter(inside(shape))
    found = visible.join(labels.select(*keys, "y", "x", label), [*keys, "y", "x"], "left")
    return found.withColumn(label, F.coalesce(F.col(label), F.lit(0)))

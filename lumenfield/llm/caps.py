"""Near duplicates of embeddings by spherical-cap filters.

A filter is a random direction; a vector is in the filter's cap if it leans far enough that
way. The directions are a product code: the (randomly rotated) dimensions are split into
``PARTS`` blocks with ``CODES`` random code words each, and a direction is one word per
block, so a vector is decoded to its list of caps by adding up block scores and leaving a
branch once the rest can't lift it over the limit. The limit leaves a vector in ``CAPS`` caps
of a code on average, and in ``LEAST`` at least; ``DRAWS`` independent codes are used. Leaders
that share a cap and whose 128-bit sketches don't rule a link out are compared in double
precision. Measured recall of random pairs is in the README.

Tight groups aren't compared pair by pair. Vectors with the same strongest cap take its
least id as leader if their cosine with it is at least ``TIGHT``, whose angle is less than
half of the threshold's: then all members of a group link. The caps of a group are those of
its members; two groups that share a cap link wholly, not at all, or are compared in blocks
of at most ``BLOCK`` members a side, as the angle of their leaders and their radii tell.

Joins of vectors, caps and blocks are sort-merge joins by hint: Spark sizes a table without the
rows that an explode adds and a vector at 100 bytes, and would send large tables through the driver.

Null vectors, zero vectors and vectors with a null or non-finite component link with
nothing: n_links 0, their own component, kept. Vectors of different length never link.
Equal vectors link. Rows without vec_id are left as they are; vec_ids are taken as unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfield.llm.texts import groups, once
from lumenfield.operators.components import connected_roots, contract
from lumenfield.session import cut

COSINE = 0.9
TIGHT = 0.9755
PARTS, CODES = 3, 48
DRAWS = 6
CAPS, LEAST = 20, 8
SKETCH = 128
BLOCK = 256
SEED = 11


def code(dim: int, draw: int) -> tuple[np.ndarray, list[np.ndarray], float]:
    return once(("caps", dim, draw), lambda: new_code(dim, draw))


def new_code(dim: int, draw: int) -> tuple[np.ndarray, list[np.ndarray], float]:
    """A rotation, for each block of dimensions its code words as columns, and the limit that leaves a random vector in ``CAPS`` caps on average."""
    rng = np.random.default_rng([SEED, dim, draw])
    rotation, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    words = []
    for part in np.array_split(np.arange(dim), min(PARTS, dim)):
        w = rng.standard_normal((len(part), CODES))
        words.append(w / np.linalg.norm(w, axis=0) * np.sqrt(len(part) / dim))
    probe = rng.standard_normal((16, dim))
    total = np.zeros((16, 1))
    for part, w in zip(np.array_split(np.arange(dim), min(PARTS, dim)), words):
        scores = (probe / np.linalg.norm(probe, axis=1, keepdims=True))[:, part] @ w
        total = (total[:, :, None] + scores[:, None, :]).reshape(16, -1)
    return rotation, words, float(np.quantile(total, max(0.0, 1 - CAPS / total.shape[1])))


def decode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, cap) of every cap each unit vector is in, sorted by vector, and each vector's strongest cap of the first draw."""
    dim = unit.shape[1]
    rows, names, tops = [], [], []
    for draw in range(DRAWS):
        rotation, words, limit = code(dim, draw)
        turned = unit @ rotation
        scores = [turned[:, part] @ w for part, w in zip(np.array_split(np.arange(dim), min(PARTS, dim)), words)]
        best = [s.max(axis=1) for s in scores]
        # a vector that leans over the limit in few directions takes its LEAST strongest of the sums of strong words
        strong = [np.sort(s, axis=1)[:, -LEAST:] for s in scores]
        sums = strong[0]
        for s in strong[1:]:
            sums = np.sort((sums[:, :, None] + s[:, None, :]).reshape(len(unit), -1), axis=1)[:, -LEAST:]
        own = np.minimum(limit, sums[:, 0] - 1e-12)
        top = np.zeros(len(unit), np.int64)
        for s in scores:
            top = top * CODES + s.argmax(axis=1)
        row, name, total = np.arange(len(unit)), np.full(len(unit), draw, np.int64), np.zeros(len(unit))
        for i, s in enumerate(scores):
            rest = sum(best[i + 1 :], np.zeros(len(unit)))
            grown = total[:, None] + s[row]
            keep, word = np.nonzero(grown + rest[row][:, None] >= own[row][:, None])
            row, name, total = row[keep], name[keep] * CODES + word, grown[keep, word]
        rows.append(row)
        names.append(name)
        tops.append(top)
    row, name = np.concatenate(rows), np.concatenate(names)
    order = np.argsort(row, kind="stable")
    return row[order], name[order], tops[0]


def planes(dim: int) -> np.ndarray:
    return once(("planes", dim), lambda: np.random.default_rng([SEED, dim, 99]).standard_normal((dim, SKETCH)))


def sketches(unit: np.ndarray) -> list[bytes]:
    """On which side of ``SKETCH`` random planes each vector lies, as bits."""
    return [x.tobytes() for x in np.packbits(unit @ planes(unit.shape[1]) >= 0, axis=1)]


def units(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None where a vector links with nothing."""
    out: list[np.ndarray | None] = []
    for v in column:
        x = None if v.as_py() is None or v.values.null_count else np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
        if x is not None:
            scale = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
            x = x / scale if scale > 0 else None
        out.append(x / np.linalg.norm(x) if x is not None else None)
    return out


def rows_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float64) for x in column.to_pylist()])


def decoded(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """(id, unit, sketch, top, caps) of every vector that can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                unit = units(part.column(embedding))
                for dim in sorted({len(u) for u in unit if u is not None}):
                    mine = [i for i, u in enumerate(unit) if u is not None and len(u) == dim]
                    x = np.stack([unit[i] for i in mine])
                    row, cap, top = decode(x)
                    cap, top = cap + (dim << 32), top + (dim << 32)
                    caps = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(mine) + 1)), pa.int32()), pa.array(cap))
                    yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(mine)), pa.array([u.tobytes() for u in x], pa.binary()), pa.array(sketches(x), pa.binary()), pa.array(top), caps], ["id", "unit", "sketch", "top", "caps"])

    return vectors.select(key, embedding).mapInArrow(run, "id long, unit binary, sketch binary, top long, caps array<long>")


def angles(a: pa.Array, b: pa.Array) -> np.ndarray:
    """The angle of each pair of unit vectors; pairs may differ in length from one another."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.float64) for c in (a, b))
    sizes = np.array([len(v) // 8 for v in a.to_pylist()])
    return np.arccos(np.clip(np.add.reduceat(x * y, np.cumsum(sizes) - sizes), -1, 1))


def led(found: DataFrame) -> DataFrame:
    """(id, unit, sketch, caps, lead, radius): each vector's leader, its own id if it is alone."""
    leaders = found.groupBy("top").agg(F.min_by("unit", "id").alias("lead_unit"), F.min("id").alias("lead"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            turn = angles(batch.column("unit"), batch.column("lead_unit"))
            own, lead = (np.asarray(batch.column(c)) for c in ("id", "lead"))
            near = turn <= np.arccos(TIGHT)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("unit"), batch.column("sketch"), batch.column("caps"), pa.array(np.where(near, lead, own)), pa.array(np.where(near & (own != lead), turn, 0.0))], ["id", "unit", "sketch", "caps", "lead", "radius"])

    return found.join(leaders.hint("merge"), "top").select("id", "unit", "sketch", "caps", "lead", "lead_unit").mapInArrow(run, "id long, unit binary, sketch binary, caps array<long>, lead long, radius double")


def near_groups(placed: DataFrame, cosine: float) -> DataFrame:
    """(g, h, whole): groups that share a cap and may link; ``whole`` if all their members link."""
    own = (F.col("id") == F.col("lead")).cast("int")
    heads = cut(placed.groupBy("lead").agg(F.max("radius").alias("radius"), F.max_by("unit", own).alias("unit"), F.max_by("sketch", own).alias("sketch")))
    caps = placed.select("lead", F.explode("caps").alias("cap")).distinct()
    size = caps.groupBy("cap").agg(F.count("*").alias("c")).filter("c > 1").withColumn("parts", F.ceil(F.col("c") / BLOCK).cast("long")).drop("c")
    dealt = caps.join(size.hint("merge"), "cap").withColumn("part", F.pmod(F.xxhash64("lead"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("cap", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).cast("int").alias("side"), "lead").join(heads.drop("unit").hint("merge"), "lead")
    most = np.arccos(cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["cap", "i", "j"]):
            if table.num_rows < 2:
                continue
            lead, radius, side = (table.column(c).to_numpy() for c in ("lead", "radius", "side"))
            x = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(lead), -1)
            apart = sum(np.bitwise_count(x[:, None, k] ^ x[None, :, k]).astype(np.int64) for k in range(x.shape[1]))
            share = np.minimum((most + radius[:, None] + radius[None, :]) / np.pi, 0.5)
            a, b = np.nonzero((lead[:, None] < lead[None, :]) & (apart <= SKETCH * share + 6 * np.sqrt(SKETCH * share * (1 - share))))
            if side.any():
                across = side[a] != side[b]
                a, b = a[across], b[across]
            if len(a):
                yield pa.RecordBatch.from_pydict({"g": lead[a], "h": lead[b]})

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                turn = angles(batch.column("unit_g"), batch.column("unit_h"))
                reach = np.asarray(batch.column("radius_g")) + np.asarray(batch.column("radius_h"))
                sure = (turn + reach <= most - 1e-7) & (reach > 0)
                yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("h"), pa.array(sure)], ["g", "h", "whole"]).filter(pa.array(turn - reach <= most + 1e-9))

    keys = ["cap", "i", "j"]
    pairs = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "g long, h long").distinct()
    sides = [heads.select(F.col("lead").alias(x), F.col("unit").alias(f"unit_{x}"), F.col("radius").alias(f"radius_{x}")) for x in "gh"]
    return pairs.join(sides[0].hint("merge"), "g").join(sides[1].hint("merge"), "h").mapInArrow(settle, "g long, h long, whole boolean")


def compared(pairs: DataFrame, placed: DataFrame, sizes: DataFrame, cosine: float) -> DataFrame:
    """(id, n, other): how many vectors of the other group each member links with, or (null n) a link (id, other)."""
    parts = F.ceil(F.col("size") / BLOCK).cast("long")
    counts = [sizes.select(F.col("lead").alias(x), parts.alias(p)).hint("merge") for x, p in ("gp", "hq")]
    blocks = pairs.join(counts[0], "g").join(counts[1], "h")
    blocks = blocks.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("p") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    blocks = blocks.select("g", "h", "i", "j", F.explode(F.array(F.struct(F.col("g").alias("lead"), F.col("i").alias("part"), F.lit(0).alias("side")), F.struct(F.col("h").alias("lead"), F.col("j").alias("part"), F.lit(1).alias("side")))).alias("s")).select("g", "h", "i", "j", "s.*")
    members = placed.select("lead", "id", "unit").join(sizes.hint("merge"), "lead").select("lead", "id", "unit", F.pmod(F.xxhash64("id"), parts).alias("part"))
    keys = ["g", "h", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, keys):
            ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
            one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(one) or not len(two):
                continue
            x = rows_of(table.column("unit"))
            hit = x[one] @ x[two].T >= cosine
            if not hit.any():
                continue
            a, b = np.nonzero(hit)
            tree = contract(np.stack([ids[one[a]], ids[two[b]]], axis=1))
            n = np.concatenate([hit.sum(axis=1), hit.sum(axis=0)])
            own = np.concatenate([ids[one], ids[two]])
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own[some], tree[:, 0]])), pa.array([*n[some].tolist(), *[None] * len(tree)], pa.int64()), pa.array([*[None] * int(some.sum()), *tree[:, 1].tolist()], pa.int64())], ["id", "n", "other"])

    return blocks.join(members.hint("merge"), ["lead", "part"]).select(*keys, "side", "id", "unit").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "id long, n long, other long")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(key, n_links, component_id, kept) for every vector."""
    if 2 * np.arccos(TIGHT) > np.arccos(cosine):
        raise ValueError("TIGHT groups would hold pairs below the threshold")
    placed = cut(led(cut(decoded(vectors, key, embedding))))
    sizes = cut(placed.groupBy("lead").agg(F.count("*").alias("size")))
    near = cut(near_groups(placed, cosine))
    counted = cut(compared(near.filter("not whole").select("g", "h"), placed, sizes, cosine))
    whole = near.filter("whole").select("g", "h")
    both = whole.unionByName(whole.select(F.col("h").alias("g"), F.col("g").alias("h")))
    gained = both.join(sizes.withColumnRenamed("lead", "h").hint("merge"), "h").groupBy(F.col("g").alias("lead")).agg(F.sum("size").alias("more"))
    inner = placed.select("id", "lead").join(sizes, "lead").join(gained.hint("merge"), "lead", "left").select("id", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n"))
    links = inner.unionByName(counted.filter("n is not null").select("id", "n")).groupBy("id").agg(F.sum("n").alias("n_links"))
    edges = placed.filter("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b"))
    edges = edges.unionByName(whole.toDF("a", "b")).unionByName(counted.filter("n is null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    roots = connected_roots(edges.select(F.lit(0).alias("_one"), "a", "b"), ["_one"]).select(F.col("node").alias("_node"), "root")
    out = vectors.select(key).join(links, F.col(key) == F.col("id"), "left").join(roots, F.col(key) == F.col("_node"), "left")
    component = F.coalesce("root", F.col(key))
    return out.select(key, F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (component == F.col(key)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))

"""Field manifests: CSV scan, validation rules, id assignment and import records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfield.functions.scalars import is_close, safe_filename, valid_id
from lumenfield.operators.ranks import running_total
from lumenfield.session import cut

REQUIRED = ["image_id", "replicate_id", "green", "red"]
CHANNELS = ["green", "red", "ebfp"]


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Read manifest CSV; blank cells are NULL, relative image paths start at the CSV's folder."""
    raw = spark.read.options(header=True, quote='"', escape='"', multiLine=True, inferSchema=False).csv(path)
    raw = raw.toDF(*[name.lstrip("﻿").strip() for name in raw.columns])
    missing = [name for name in REQUIRED if name not in raw.columns]
    if missing:
        raise ValueError("Manifest requires columns: " + ", ".join(missing))
    if "ebfp" not in raw.columns:
        raw = raw.withColumn("ebfp", F.lit(None).cast("string"))
    folder = F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]*$", "")
    raw = raw.withColumn("folder", folder)
    return normal_paths(trimmed(raw))


def normal_paths(rows: DataFrame) -> DataFrame:
    """Prefix relative channel paths with the manifest folder; absolute paths stay."""
    def resolve(name: str):
        absolute = F.col(name).rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:)")
        return F.when(absolute, F.col(name)).otherwise(F.concat_ws("/", "folder", name))

    return rows.withColumns({c: F.when(F.col(c).isNotNull(), resolve(c)) for c in CHANNELS})


def trimmed(rows: DataFrame) -> DataFrame:
    """Cells without white space around them; blank ones are NULL."""
    return rows.withColumns({n: F.nullif(F.regexp_replace(n, r"^\s+|\s+$", ""), F.lit("")) for n in [*REQUIRED, "ebfp"]})


def channel_paths(rows: DataFrame) -> DataFrame:
    """One row per acquired channel file."""
    return rows.unpivot(["image_id", "replicate_id"], CHANNELS, "channel", "path").filter("path is not null")


def resolved(path: Column) -> Column:
    """The path without ``.``, ``..`` and doubled slashes, so that two spellings of one file are equal."""

    def step(kept: Column, part: Column) -> Column:
        last = F.element_at(kept, -1)
        up = (part == "..") & (F.size(kept) > 0) & (last != "..")
        inside = F.when(last == "", kept).otherwise(F.slice(kept, 1, F.size(kept) - 1))
        return F.when((part == ".") | ((part == "") & (F.size(kept) > 0)), kept).when(up, inside).otherwise(F.array_append(kept, part))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def existing_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of all files below ``folder``; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")


def violations(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(image_id, rule, detail) for every broken manifest rule; empty when the manifest is sound.

    ``files(path)`` lists what exists; without it the files are not looked for.
    """
    rows = trimmed(rows)
    ident, replicate = F.col("image_id"), F.col("replicate_id")
    checks = F.array(
        F.when(~valid_id(ident), F.struct(F.lit("invalid_image_id").alias("rule"), ident.alias("detail"))),
        F.when(~valid_id(replicate), F.struct(F.lit("invalid_replicate_id").alias("rule"), replicate.alias("detail"))),
        F.when(valid_id(ident) & ~safe_filename(ident), F.struct(F.lit("unsafe_filename").alias("rule"), ident.alias("detail"))),
        F.when(F.col("green").isNull(), F.struct(F.lit("missing_channel").alias("rule"), F.lit("green").alias("detail"))),
        F.when(F.col("red").isNull(), F.struct(F.lit("missing_channel").alias("rule"), F.lit("red").alias("detail"))),
    )
    single = rows.select("image_id", F.explode(F.array_compact(checks)).alias("v")).select("image_id", "v.*")
    exact = rows.groupBy("image_id").agg(F.count("*").alias("n")).filter("n > 1").select(
        "image_id", F.lit("duplicate_image_id").alias("rule"), F.col("n").cast("string").alias("detail")
    )
    folded = rows.groupBy(F.lower("image_id").alias("folded")).agg(F.count("*").alias("n"), F.min("image_id").alias("image_id"))
    folded = folded.filter("n > 1").select(
        "image_id", F.lit("duplicate_field_id").alias("rule"), F.col("n").cast("string").alias("detail")
    )
    listed = channel_paths(rows).withColumn("path", resolved(F.col("path")))
    reused = listed.groupBy("path").agg(F.count("*").alias("n"), F.min("image_id").alias("image_id"))
    reused = reused.filter("n > 1").select("image_id", F.lit("reused_path").alias("rule"), F.col("path").alias("detail"))
    none = rows.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(None).cast("string").alias("image_id"), F.lit("empty_manifest").alias("rule"), F.lit(None).cast("string").alias("detail"))
    found = single.unionByName(exact).unionByName(folded).unionByName(reused).unionByName(none)
    if files is None:
        return found
    lost = listed.join(files.select(resolved(F.col("path")).alias("path")), "path", "left_anti")
    return found.unionByName(lost.select("image_id", F.lit("missing_file").alias("rule"), F.col("path").alias("detail")))


def assign_unique_ids(rows: DataFrame, ident: str, seq: str) -> DataFrame:
    """Append rows in ``seq`` order; a taken id (case-folded) becomes ``id_2``, ``id_3``, ...

    A suffixed name may also be some other row's literal id. Whoever comes first keeps
    it: the later literal starts at its own ``_2``, the later duplicate skips the number.
    The literal children of a stem are swept once in the order of their numbers; only names
    that are children of children take another sweep, one a level.
    """
    stems = rows.withColumn("_stem", F.lower(ident))
    firsts = stems.groupBy("_stem").agg(F.min(seq).alias("_first"))
    # no table has the rows to reach a number of more digits
    suffix = r"^(.*)_([2-9]|[1-9][0-9]{1,14})$"
    children = firsts.filter(F.col("_stem").rlike(suffix)).select(
        F.regexp_extract("_stem", suffix, 1).alias("_stem"), F.regexp_extract("_stem", suffix, 2).cast("bigint").alias("_n"), F.col("_first").alias(seq)
    )
    children = children.join(firsts.select("_stem"), "_stem", "left_semi")
    both = stems.withColumn("_n", F.lit(None).cast("bigint")).unionByName(children, allowMissingColumns=True)
    ranked = running_total(both, ["_stem"], [F.col(seq)], F.col("_n").isNull().cast("int"), "_k")
    own = ranked.filter("_n is null").drop("_n")
    # of a child: how many rows of the stem come before it
    met = cut(ranked.filter("_n is not null").select("_stem", "_n", F.col("_k").alias("_before")))
    number = F.col("_k")
    if not met.isEmpty():
        shifts = met.select(F.concat_ws("_", "_stem", F.col("_n").cast("string")).alias("_stem"), F.lit(0).cast("bigint").alias("_shift"))
        while True:
            swept = cut(met.join(shifts, "_stem", "left").fillna(0, ["_shift"]).groupBy("_stem").applyInPandas(_sweep, "_stem string, _n bigint, _from bigint, _taken bigint"))
            new = swept.select(F.concat_ws("_", "_stem", F.col("_n").cast("string")).alias("_stem"), F.col("_taken").alias("_shift"))
            changed = new.join(shifts.withColumnRenamed("_shift", "_old"), "_stem").filter("_shift <> _old")
            settled = changed.isEmpty()
            shifts = new
            if settled:
                break
        # a skipped number moves all later rows of the stem by one
        jumps = swept.filter("_from is not null").select("_stem", F.col("_from").alias("_k"))
        both = own.withColumn("_jump", F.lit(0)).unionByName(jumps.withColumn("_jump", F.lit(1)), allowMissingColumns=True)
        own = running_total(both, ["_stem"], [F.col("_k"), F.desc("_jump")], F.col("_jump"), "_extra").filter("_jump = 0")
        own = own.join(shifts, "_stem", "left")
        number = F.col("_k") + F.col("_extra") + F.coalesce("_shift", F.lit(0))
    unique = F.when(number == 1, F.col(ident)).otherwise(F.concat_ws("_", ident, number.cast("string")))
    return own.withColumn("unique_id", unique).select(*rows.columns, "unique_id")


def _sweep(part: pd.DataFrame) -> pd.DataFrame:
    """The literal children of one stem by number: skipped by its duplicates (``_from``: from which on), or taken by them.

    The duplicate that would take a number is the one whose rank is the number less what
    was skipped so far; it comes before the child if its rank is within ``_before``.
    """
    part = part.sort_values("_n", ignore_index=True)
    skipped = int(part["_shift"].iloc[0])
    start, taken = [], []
    for n, before in zip(part["_n"].tolist(), part["_before"].tolist()):
        rank = n - skipped
        taken.append(int(rank <= before))
        start.append(None if rank <= before else rank)
        skipped += rank > before
    return pd.DataFrame({"_stem": part["_stem"], "_n": part["_n"], "_from": pd.Series(start, dtype="Int64"), "_taken": taken})


def discover_imports(rows: DataFrame, exports: DataFrame, files: DataFrame) -> DataFrame:
    """Attach the export record to each manifest path and say whether the file still matches it.

    ``exports(path, bytes, sha)`` is what the import recorded, ``files(path, bytes, sha)`` what lies there now.
    """
    current = files.select("path", F.col("bytes").alias("bytes_now"), F.col("sha").alias("sha_now"))
    joined = channel_paths(trimmed(rows)).join(exports, "path", "left").join(current, "path", "left")
    state = (
        F.when(F.col("sha").isNull(), "unknown_import")
        .when(F.col("sha_now").isNull(), "missing_file")
        .when(~F.col("bytes").eqNullSafe(F.col("bytes_now")) | (F.col("sha") != F.col("sha_now")), "changed")
        .otherwise("verified")
    )
    return joined.select("image_id", "channel", "path", state.alias("state"))


def recover_roles(paths: DataFrame, exports: DataFrame) -> DataFrame:
    """Map each analysis role back to its acquisition channel; exactly one record must match.

    ``paths(image_id, role, path)``, ``exports(image_id, original_role, channel_index, path)``.
    """
    matched = paths.join(exports, ["image_id", "path"], "left").groupBy("image_id", "role", "path").agg(
        F.count("original_role").alias("n_matches"),
        F.min("original_role").alias("original_role"),
        F.min("channel_index").alias("channel_index"),
    )
    sound = F.col("n_matches") == 1
    return matched.select(
        "image_id", "role", "n_matches",
        F.when(sound, F.col("original_role")).alias("original_role"),
        F.when(sound, F.col("channel_index")).alias("channel_index"),
        F.when(sound, "ok").when(F.col("n_matches") == 0, "not_recorded").otherwise("ambiguous").alias("verdict"),
    )


def calibration_compat(fields: DataFrame, batch: str, seq: str) -> DataFrame:
    """Compare every field's frame, type and pixel pitch with the first field of its batch."""
    names = ["h", "w", "dtype", "dy", "dx"]
    first = fields.groupBy(batch).agg(F.min_by(F.struct(*names), seq).alias("first"))
    same = (
        (F.col("h") == F.col("first.h")) & (F.col("w") == F.col("first.w"))
        & (F.col("dtype") == F.col("first.dtype"))
        & is_close(F.col("dy"), F.col("first.dy")) & is_close(F.col("dx"), F.col("first.dx"))
    )
    return fields.join(first, batch).withColumn("compatible", same).drop("first")


def write_manifest(rows: DataFrame, path: str) -> None:
    """Write a manifest as CSV with a header; an existing target is refused."""
    rows.select(*REQUIRED, "ebfp").write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)



"""Digest-based audits, golden comparisons, incremental work lists and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfield.functions.scalars import fingerprint


def both_sides(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Full outer pairing of two keyed tables in one aggregation: ``<value>_l``, ``<value>_r``, ``n_l``, ``n_r``.

    ``n_l`` and ``n_r`` count the rows of a key on each side. Equal rows are counted before
    they travel; where a side has several different rows, its values are those of the least.
    """
    keys = list(keys)
    row = F.struct(*values)
    sides = left.select(*keys, row.alias("_row"), F.lit(1).alias("_side")).unionByName(right.select(*keys, row.alias("_row"), F.lit(2).alias("_side")))
    counts = sides.groupBy(*keys, "_side", "_row").agg(F.count("*").alias("_n"))

    def of(side: int, column: Column) -> Column:
        return F.when(F.col("_side") == side, column)

    paired = counts.groupBy(*keys).agg(
        *[F.min(of(i, F.col("_row"))).alias(f"_{s}") for i, s in ((1, "l"), (2, "r"))],
        *[F.coalesce(F.sum(of(i, F.col("_n"))), F.lit(0)).alias(f"n_{s}") for i, s in ((1, "l"), (2, "r"))],
    )
    return paired.select(*keys, "n_l", "n_r", *[F.col(f"_{s}.{v}").alias(f"{v}_{s}") for s in ("l", "r") for v in values])


def unpaired(missing: str, unexpected: str, in_left: str = "n_l", in_right: str = "n_r") -> Column:
    """What is wrong with a key before its values matter; NULL if it is once on each side."""
    return (
        F.when((F.col(in_left) > 1) | (F.col(in_right) > 1), "duplicate_key")
        .when(F.col(in_right) == 0, missing).when(F.col(in_left) == 0, unexpected)
    )


def verify_digests(recorded: DataFrame, current: DataFrame, key: str, sha: str = "sha") -> DataFrame:
    """(key, status): ok, changed, missing, unexpected, or duplicate_key if a side has the key twice."""
    paired = both_sides(recorded, current, [key], [sha])
    same = F.when(F.col(f"{sha}_l").eqNullSafe(F.col(f"{sha}_r")), "ok").otherwise("changed")
    return paired.select(key, F.coalesce(unpaired("missing", "unexpected"), same).alias("status"))


def golden_diff(
    actual: DataFrame, expected: DataFrame, keys: Sequence[str], numeric: Sequence[str], exact: Sequence[str],
    rtol: float = 1e-12, atol: float = 1e-12,
) -> DataFrame:
    """One row per differing cell (numbers within atol + rtol*|expected|, NULL equals NULL), unpaired row or repeated key."""
    paired = both_sides(actual, expected, keys, [*numeric, *exact])

    def text(name: str) -> Column:
        return F.col(name).cast("string")

    cells = []
    for name in numeric:
        a, b = F.col(f"{name}_l").cast("double"), F.col(f"{name}_r").cast("double")
        near = F.coalesce(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b), a.isNull() & b.isNull())
        cells.append(F.when(~near, F.lit(name)))
    for name in exact:
        cells.append(F.when(~text(f"{name}_l").eqNullSafe(text(f"{name}_r")), F.lit(name)))
    whole = unpaired("row_unexpected", "row_missing")
    found = F.when(whole.isNotNull(), F.array(whole)).otherwise(F.array_compact(F.array(*cells)))
    return paired.select(*keys, F.explode(found).alias("difference"))


def incremental_todo(requests: DataFrame, finished: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Requests whose fingerprint has no finished result yet."""
    marked = requests.withColumn("fingerprint", fingerprint(*[F.col(p) for p in parts]))
    return marked.join(finished.select("fingerprint"), "fingerprint", "left_anti")


def reusable(requests: DataFrame, finished: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Requests whose fingerprint is finished already."""
    marked = requests.withColumn("fingerprint", fingerprint(*[F.col(p) for p in parts]))
    return marked.join(finished.select("fingerprint"), "fingerprint", "left_semi")


def summary_audit(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Saved summary rows with negative or inconsistent counts or a missing identifier."""
    counts = ["live_only", "dead_only", "double_positive", "total"]
    rules = F.array_compact(
        F.array(
            F.when(F.array_contains(F.transform(F.array(*counts), lambda n: n < 0), True), F.lit("negative_count")),
            F.when(F.col("live_only") + F.col("dead_only") + F.col("double_positive") != F.col("total"), F.lit("sum_differs")),
            F.when(F.coalesce(F.array_contains(F.transform(F.array(*keys), lambda k: F.coalesce(k, F.lit("")) == ""), True), F.lit(True)), F.lit("missing_identifier")),
        )
    )
    return summary.select(*keys, F.explode(rules).alias("rule"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition: Sequence[str] = (), order: Sequence[str] = ()) -> None:
    """Write once: an existing target is refused, the committer publishes whole outputs only.

    With ``order`` the files follow one another in it and so do the rows of each file.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*partition, *order)
    writer = df.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition:
        writer = writer.partitionBy(*partition)
    writer.save(path)


def with_positions(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an ordered Parquet table with ``position`` = 1, 2, ... through its files; one row a file is sorted."""
    rows = spark.read.parquet(path)
    placed = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = placed.groupBy("_file").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return placed.join(files.drop("_n"), "_file").select(*rows.columns, (F.col("_start") + F.col("_row") + 1).alias("position"))


def read_table(spark: SparkSession, path: str, fmt: str, schema) -> DataFrame:
    reader = spark.read.schema(schema).format(fmt)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path)

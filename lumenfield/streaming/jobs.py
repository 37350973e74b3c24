"""Structured Streaming variants: projection as planes arrive, field intake, review feed.

Every job keeps its table as snapshots and deltas: a micro-batch writes its own delta, and
every ``EVERY``-th one merges what is there into a new snapshot. Deltas and snapshots have a
fixed number of folders, used in turn and overwritten, so the table stays compact however
long the stream runs, and a batch that is replayed after a restart writes the same again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfield.functions.scalars import fingerprint
from lumenfield.operators.review import latest

#: micro-batches from one snapshot to the next
EVERY = 8
#: folders of published fingerprints in a delta or snapshot
BUCKETS = 64


class Snapshots:
    """A table below ``folder`` that micro-batches add to; ``merge`` makes one row of each key of all rows added."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, merge: Callable[[DataFrame], DataFrame], every: int = EVERY, partition: Sequence[str] = ()) -> None:
        self.spark, self.folder, self.merge, self.every, self.partition = spark, folder, merge, every, list(partition)
        self.columns = schema.fieldNames()
        self.schema = T.StructType([*schema, T.StructField("_batch", T.LongType()), T.StructField("_kind", T.StringType()), T.StructField("_slot", T.IntegerType())])
        # readers find a folder from the start on
        nothing = spark.createDataFrame([], T.StructType([f for f in self.schema[:-2] if f.name not in self.partition]))
        nothing.write.mode("ignore").parquet("/".join([folder, "_kind=delta", "_slot=-1", *(f"{name}=-1" for name in self.partition)]))

    def rows(self, upto: int | None = None, snapshot_before: int | None = None) -> DataFrame:
        """All live rows of batches before ``upto``, not merged, from the last snapshot before ``snapshot_before`` on."""
        found = self.spark.read.schema(self.schema).parquet(self.folder)
        if upto is not None:
            found = found.filter(F.col("_batch") < upto)
        taken = F.col("_kind") == "snapshot"
        last = found.filter(taken if snapshot_before is None else taken & (F.col("_batch") < snapshot_before)).agg(F.max("_batch")).first()[0]
        last = -1 if last is None else last
        return found.filter((taken & (F.col("_batch") == last)) | (~taken & (F.col("_batch") > last))).select(self.columns)

    def read(self) -> DataFrame:
        return self.merge(self.rows())

    def add(self, rows: DataFrame, number: int) -> None:
        self._write(rows, number, f"_kind=delta/_slot={number % self.every}")
        if (number + 1) % self.every == 0:
            # the two snapshot folders take turns: what is merged is never what is overwritten
            self._write(self.merge(self.rows(number + 1, number)), number, f"_kind=snapshot/_slot={number // self.every % 2}")

    def _write(self, rows: DataFrame, number: int, place: str) -> None:
        writer = rows.select(self.columns).withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite")
        (writer.partitionBy(*self.partition) if self.partition else writer).parquet(f"{self.folder}/{place}")


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything that is there and stop."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def keep(stream: DataFrame, merge: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> DataFrame:
    """The merge of all rows of the stream so far; ``merge`` must not mind rows that come again or late."""
    table = Snapshots(stream.sparkSession, folder, merge(stream).schema, merge)
    run_available(stream, lambda batch, number: table.add(merge(batch), number), checkpoint)
    return table.read()


def stream_projection(planes: DataFrame, keys: Sequence[str], folder: str, checkpoint: str) -> DataFrame:
    """Maximum per pixel while planes arrive; returns the projection seen so far."""
    return keep(planes, lambda rows: rows.groupBy(*keys, "y", "x").agg(F.max("value").alias("value")), folder, checkpoint)


def stream_new_fields(feed: DataFrame, parts: Sequence[str], folder: str, checkpoint: str) -> DataFrame:
    """Publish each field fingerprint once, however late it comes.

    A micro-batch is freed of its own repeats and of what is published; it reads only the
    buckets of fingerprints that it holds.
    """
    marked = feed.select(fingerprint(*[F.col(p) for p in parts]).alias("fingerprint"), *parts)
    marked = marked.withColumn("_bucket", F.conv(F.substring("fingerprint", 1, 2), 16, 10).cast("int") % BUCKETS)
    table = Snapshots(feed.sparkSession, folder, marked.schema, lambda rows: rows, partition=["_bucket"])

    def publish(batch: DataFrame, number: int) -> None:
        todo = batch.dropDuplicates(["fingerprint"]).persist()
        own = [r["_bucket"] for r in todo.select("_bucket").distinct().collect()]
        done = table.rows(number, number).filter(F.col("_bucket").isin(own)).select("fingerprint")
        table.add(todo.join(done, "fingerprint", "left_anti").repartition("_bucket"), number)
        todo.unpersist()

    run_available(marked, publish, checkpoint)
    return table.read().drop("_bucket")


def stream_latest(feed: DataFrame, keys: Sequence[str], order: str, folder: str, checkpoint: str) -> DataFrame:
    """Last revision per key of everything the feed has brought."""
    return keep(feed, lambda rows: latest(rows, keys, order), folder, checkpoint)

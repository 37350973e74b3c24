"""Array files (``.npy`` planes and volumes) to and from raster rows.

A scan lists the files with Spark, reads their headers in tasks, and deals ranges of
planes (rows, for a single plane) to tasks, each of which reads only its own bytes. So a
volume of any size is many tasks, and a file without a single non-zero pixel is still a row
of the headers. Files are opened by URI, wherever Arrow finds a file system for it.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOXELS = "path string, dtype string, z int, y int, x int, value int"
HEADERS = "path string, dtype string, shape array<bigint>, fortran boolean, offset bigint"
HEADER_BYTES = 1 << 16
RANGE_BYTES = 16 << 20


def open_input(path: str):
    """A random-access reader of a URI or local path."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(path)
    system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return system.open_input_file(inner)


def read_header(path: str, start: bytes) -> tuple[np.dtype, tuple[int, ...], bool, int]:
    """(type, shape, Fortran order, where the data begins); other types or ranks and empty arrays are refused."""
    stream = io.BytesIO(start)
    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(stream)
    if dtype.newbyteorder("=") not in (np.uint8, np.uint16) or len(shape) not in (2, 3) or not np.prod(shape):
        raise ValueError(f"{path}: expected a nonempty uint8/uint16 plane or volume")
    return dtype, shape, fortran and len(shape) > 1, stream.tell()


def array_headers(spark: SparkSession, folder: str) -> DataFrame:
    """(path, dtype, shape, fortran, offset) of every ``.npy`` file below ``folder``; no data is read."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, length in zip(batch["path"], batch["length"]):
                with open_input(path) as file:
                    dtype, shape, fortran, offset = read_header(path, file.read(HEADER_BYTES))
                if length != offset + dtype.itemsize * int(np.prod(shape)):
                    raise ValueError(f"{path}: {length} bytes do not hold the array of its header")
                rows.append((path, dtype.str, list(shape), fortran, offset))
            yield pd.DataFrame(rows, columns=["path", "dtype", "shape", "fortran", "offset"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length").mapInPandas(look, HEADERS)


def scan_arrays(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Raster rows of every ``.npy`` file below ``folder``, read by ranges of about ``range_bytes``."""
    headers = array_headers(spark, folder)
    # in memory order; the slowest axis is cut
    shape = F.when(F.col("fortran"), F.reverse("shape")).otherwise(F.col("shape"))
    item = F.substring("dtype", 3, 1).cast("bigint")
    ranges = headers.withColumns({"_axes": shape, "_item": item}).withColumn("_row", F.expr("_item * aggregate(slice(_axes, 2, size(_axes)), 1L, (a, n) -> a * n)"))
    ranges = ranges.withColumn("_step", F.greatest(F.lit(1).cast("bigint"), F.call_function("div", F.lit(range_bytes).cast("bigint"), F.col("_row"))))
    ranges = ranges.withColumn("first", F.explode(F.expr("sequence(0L, _axes[0] - 1, _step)")))
    ranges = ranges.select("path", "dtype", "shape", "fortran", "first", F.least(F.col("_step"), F.col("_axes")[0] - F.col("first")).alias("count"), (F.col("offset") + F.col("first") * F.col("_row")).alias("at"), "_row")
    # a range is a task's unit of work, so ranges are dealt out evenly
    dealt = ranges.repartition("path", "first")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                with open_input(r.path) as file:
                    file.seek(r.at)
                    data = file.read(r.count * r[-1])
                inner = list(r.shape)[::-1] if r.fortran else list(r.shape)
                block = np.frombuffer(data, r.dtype).reshape([r.count, *inner[1:]])
                place = list(np.nonzero(block))
                value = block[tuple(place)]
                place[0] = place[0] + r.first
                if r.fortran:
                    place = place[::-1]
                z, y, x = place if len(place) == 3 else (np.zeros(len(value), np.int64), *place)
                yield pd.DataFrame({
                    "path": r.path, "dtype": np.dtype(r.dtype).name, "z": z.astype("int32"), "y": y.astype("int32"), "x": x.astype("int32"), "value": value.astype("int32"),
                })

    return dealt.mapInPandas(read, VOXELS)


def write_planes(px: DataFrame, planes: DataFrame, shape: tuple[int, int], folder: str, keys: Sequence[str] = ("image_id", "channel")) -> DataFrame:
    """(path, bytes) of one ``.npy`` file ``folder/<key>/<key>.npy`` for each declared plane, with or without pixels.

    A task that is run again writes the same bytes under the same name, so files are whole
    and equal whichever attempt ends.
    """
    keys = list(keys)
    rows = px.select(*keys, "y", "x", "value").unionByName(planes.select(*keys).distinct(), allowMissingColumns=True)

    def write(key: tuple, plane: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        plane = plane[plane["value"].notna()]
        dense = np.zeros(shape, np.uint8 if plane["value"].max() < 256 or not len(plane) else np.uint16)
        dense[plane["y"].astype(int), plane["x"].astype(int)] = plane["value"].astype(int)
        buffer = io.BytesIO()
        np.save(buffer, dense)
        system, inner = fs.FileSystem.from_uri(re.sub(r"^(file:)?/+", "file:///", folder) if folder.startswith(("/", "file:")) else folder)
        inner = "/".join([inner, *map(str, key[:-1])])
        system.create_dir(inner, recursive=True)
        with system.open_output_stream(f"{inner}/{key[-1]}.npy") as file:
            file.write(buffer.getvalue())
        return pd.DataFrame({"path": ["/".join(map(str, key)) + ".npy"], "bytes": [len(buffer.getvalue())]})

    return rows.groupBy(*keys).applyInPandas(write, "path string, bytes bigint")

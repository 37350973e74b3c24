"""Language identification by nearest centroid.

Byte n-grams of the text (ASCII lower-cased, other ASCII signs as blanks) are hashed into
``DIMS`` features, weighted by TF-IDF and normalised. Every language has several centroids,
clustered from a bounded sample of its labelled rows; a text gets the language of the
nearest centroid by cosine. It is rejected if that cosine is below the language's own
limit (``REJECT`` times the cosine that a share of ``LOW`` of its sample falls below), or if
it holds no letter.

Only labelled rows with a letter and at least two bytes (an n-gram) are training rows. Document
frequencies come from all of them. The sample of a language holds at most ``FIT_ROWS`` rows,
those of smallest hash. Null, empty or letterless texts give ``und``
with score 0; an empty table gives an empty result; without any training row every text
is ``und``. Ties between centroids go to the language first by code point.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfield.llm.texts import LOWER, cuts, flat

DIMS = 4096
FIT_ROWS = 600
CLUSTERS = 4
REJECT = 0.5
LOW = 0.05
BLOCK = 256
SIGNS = LOWER.copy()
SIGNS[[i for i in range(128) if not chr(i).isalpha()]] = 32


def features(data: np.ndarray, offsets: np.ndarray, dims: int) -> np.ndarray:
    """Counts of hashed 2- and 3-grams, a row per text."""
    n = len(offsets) - 1
    base = offsets[0]
    text = SIGNS[data[base : offsets[-1]]].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets)) * dims
    counts = np.zeros(n * dims, np.int64)
    shift = np.uint32(32 - int(math.log2(dims)))
    for order in (2, 3):
        if len(text) < order:
            continue
        m = len(text) - order + 1
        code = np.full(m, order, np.uint32)
        for i in range(order):
            code = code * np.uint32(257) + text[i : i + m]
        code = (code * np.uint32(2654435761)) >> shift
        same = row[:m] == row[order - 1 :]
        counts += np.bincount((row[:m] + code)[same], minlength=n * dims)
    return counts.reshape(n, dims)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def blocks(column: pa.Array, dims: int) -> Iterator[tuple[int, int, np.ndarray]]:
    data, offsets = flat(column)
    for low, high in cuts(offsets, rows=BLOCK):
        yield low, high, features(data, offsets[low : high + 1], dims)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centres are chosen farthest from each other, in row order, and none twice."""
    centres = [x.mean(axis=0)]
    for _ in range(min(k, len(x)) - 1):
        near = (x @ np.stack(centres).T).max(axis=1)
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-6:
            break
        centres.append(x[far])
    c = np.stack(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    """Languages and their centroids (a row each), the limits below which a text is rejected, and the IDF."""

    langs: list[str]
    centroids: np.ndarray
    limits: np.ndarray
    idf: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, cosine) for each row."""
        sims = vectors(counts, self.idf) @ self.centroids.T
        best = np.argmax(sims, axis=1)
        return best, np.clip(sims[np.arange(len(best)), best].astype(np.float64), 0.0, 1.0)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", dims: int = DIMS, fit_rows: int = FIT_ROWS, clusters: int = CLUSTERS, reject: float = REJECT) -> Model:
    """Learn from all rows of ``docs`` with a language and a letter; the centroids from at most ``fit_rows`` rows each."""
    some = F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & (F.octet_length(text) > 1)
    rows = docs.filter(some).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, counts in blocks(batch.column("text"), dims):
                total += (counts > 0).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"feature": np.arange(-1, dims), "n": np.concatenate([[n], total])})

    found = {r["feature"]: r["n"] for r in rows.select("text").mapInArrow(frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    seen = np.array([found.get(i, 0) for i in range(dims)], np.float64)
    idf = (np.log((1 + found.get(-1, 0)) / (1 + seen)) + 1).astype(np.float32)

    share = F.lit(0.0)
    for r in rows.groupBy("lang").count().collect():
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, 2 * fit_rows / r["count"]))).otherwise(share)
    order = Window.partitionBy("lang").orderBy("hash", "key")
    sample = rows.withColumn("hash", F.xxhash64("key")).filter(F.pmod("hash", F.lit(1 << 20)) < share * (1 << 20))
    sample = sample.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= fit_rows)

    def centres(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        x = np.concatenate([vectors(c, idf) for _, _, c in blocks(pa.array(part["text"], pa.string()), dims)])
        c = cluster(x, clusters)
        limit = reject * float(np.quantile((x @ c.T).max(axis=1), LOW))
        return pd.DataFrame({"lang": part["lang"].iloc[0], "centre": [v.astype(np.float32).tobytes() for v in c], "limit": limit})

    model = sorted(sample.groupBy("lang").applyInPandas(centres, "lang string, centre binary, limit double").collect(), key=lambda r: (r["lang"], r["centre"]))
    stacked = np.frombuffer(b"".join(r["centre"] for r in model), np.float32).reshape(-1, dims)
    return Model([r["lang"] for r in model], stacked, np.array([r["limit"] for r in model]), idf)


OUT = ("lang_pred", "score", "rejected")


def identify(docs: DataFrame, model: Model, text: str = "text", out: tuple[str, str, str] = OUT) -> DataFrame:
    """``docs`` with the columns ``out``: language, cosine, rejected (too far from every centroid, or no letter).

    A column of ``docs`` that has one of these names is replaced.
    """
    dims = len(model.idf)
    kept = [f for f in docs.schema if f.name not in out]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text)
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            if model.langs:
                for low, high, counts in blocks(column, dims):
                    best[low:high], score[low:high] = model.predict(counts)
            letters = [bool(model.langs) and s is not None and any(map(str.isalpha, s)) for s in column.to_pylist()]
            names = [model.langs[b] if ok else "und" for b, ok in zip(best, letters)]
            score = np.where(letters, score, 0.0)
            far = [not ok or bool(s < model.limits[b]) for s, b, ok in zip(score, best, letters)]
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(score), pa.array(far, pa.bool_())], [*(f.name for f in kept), *out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{out[0]}` string, `{out[1]}` double, `{out[2]}` boolean"])
    return docs.mapInArrow(predict, schema)


def held_out(modulus: int, remainder: int, key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == remainder, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out(3, 1)))
    return identify(docs.select("doc_id", held_out(3, 1).alias("held_out"), "text"), model).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go."""
    out = tuple(f"_{name}_of_{len(docs.columns)}" for name in OUT)
    return identify(docs, fit(docs), out=out).filter(~F.col(out[2])).select(*docs.columns)

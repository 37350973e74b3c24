"""Quality rules: fixed counts, and the log-likelihood ratio of two hashed n-gram models.

Words and pairs of neighbouring words are hashed into ``BUCKETS``. The raw model counts all
documents, the target model all trusted ones whose id hashes even; all other trusted ones set
the threshold. They are found by a join on the id; a bitmap of ``BITS`` hashed ids keeps most
other texts out of it. A document's score is the mean over its
n-grams of log(target / raw), with add-one smoothing. It is dropped if the
score lies more than ``SPREAD`` standard deviations below the mean of the trusted documents
that the model was not fitted on.

Null texts have no words: all counts 0, score 0, base failed, not kept. Repeated doc_ids
are judged row by row. Without trusted documents only the base rules decide.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfield.llm.texts import SPACE, Words, cuts, flat, windows, word_slices, words

BUCKETS = 1 << 16
SPREAD = 5.0
BITS = 1 << 25
PAGE = 1 << 15
WINDOW = 8
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def grams(w: Words, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every word and every pair of neighbouring words."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    rows = np.arange(len(w.first) - 1)
    pairs, first = windows(w, 2)
    code = np.concatenate([w.hashes, pairs]) >> shift
    return code.astype(np.int64), np.concatenate([np.repeat(rows, np.diff(w.first)), np.repeat(rows, np.diff(first))])


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all rows labelled good and not toxic."""
    return labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select("doc_id").distinct()


def gram_counts(docs: DataFrame, text: str, buckets: int) -> np.ndarray:
    """Occurrences of each bucket in all of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, w in word_slices(batch, text):
                found += np.bincount(grams(w, buckets)[0], minlength=buckets)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"bucket": at, "n": found[at]})

    rows = docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def trusted_rows(docs: DataFrame, good: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` whose key is among the distinct keys ``good``."""
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    pages = good.select(place.alias("_h")).groupBy(F.shiftright("_h", PAGE.bit_length() - 1).alias("page")).agg(F.bitmap_construct_agg(F.col("_h") % PAGE).alias("bits")).toArrow()
    marked = np.zeros((-(-bits // PAGE), PAGE // 8), np.uint8)
    for page, found in zip(pages.column("page").to_pylist(), pages.column("bits").to_pylist()):
        marked[page] = np.frombuffer(found, np.uint8)
    marked = marked.ravel()

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("_h").to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array((marked[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1)).drop_columns(["_h"])

    # the text is wide, the keys grow with it: always a sorted join, so that disk grows as the input does
    return docs.withColumn("_h", place).mapInArrow(likely, docs.schema).join(good.hint("merge"), key, "left_semi")


def fit(docs: DataFrame, ids: DataFrame | Sequence, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, spread: float = SPREAD) -> tuple[np.ndarray, float]:
    """(log ratio of each bucket, least score kept) from all of ``docs`` and all trusted ``ids``, a table of one column or a list."""
    kind = docs.schema[key].dataType.simpleString()
    if not isinstance(ids, DataFrame):
        ids = docs.sparkSession.createDataFrame([(i,) for i in ids], f"`{key}` {kind}")
    good = ids.toDF(key).select(F.col(key).cast(kind)).distinct()

    def half(df: DataFrame, fold: int) -> DataFrame:
        return df.filter(F.pmod(F.xxhash64(key), F.lit(2)) == fold)

    known, rest = (trusted_rows(half(docs.select(key, text), fold), half(good, fold), key) for fold in (0, 1))
    target = gram_counts(known, text, buckets)
    if not target.sum():
        return np.zeros(buckets), -np.inf
    raw = gram_counts(docs, text, buckets)
    ratio = np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, w in word_slices(batch, text):
                code, row = grams(w, buckets)
                yield pa.RecordBatch.from_pydict({"score": means(ratio, code, row, len(w.first) - 1)})

    row = rest.select(text).mapInArrow(scores, "score double").agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("sd")).first()
    return ratio, -np.inf if row["mean"] is None else row["mean"] - spread * row["sd"]


def means(ratio: np.ndarray, code: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, ratio[code], minlength=n) / np.maximum(np.bincount(row, minlength=n), 1)


def repeated_words(w: Words, k: int = WINDOW) -> np.ndarray:
    """Words in k-word windows that a text holds twice or more, the first included."""
    runs, first = windows(w, k)
    out = np.zeros(len(w.first) - 1, np.int64)
    for i in np.flatnonzero(np.diff(first) > 1):
        own = runs[first[i] : first[i + 1]]
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        if same.any():
            hit = np.zeros(len(own), bool)
            hit[order[1:][same]] = hit[order[:-1][same]] = True
            edge = np.zeros(len(own) + k, np.int64)
            at = np.flatnonzero(hit)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + k, -1)
            out[i] = int((np.cumsum(edge)[:-1] > 0).sum())
    return out


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def judge(docs: DataFrame, ratio: np.ndarray, least: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score)."""
    buckets = len(ratio)
    names = [key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(text))
            for low, high in cuts(offsets):
                w = words(data, offsets[low : high + 1], False)
                n = np.diff(w.first)
                row = np.repeat(np.arange(high - low), np.diff(w.offsets))
                points = np.bincount(row, ((w.data & 0xC0) != 0x80) & ~SPACE[w.data], minlength=high - low).astype(np.int64)
                symbols = np.bincount(row, SYMBOL[w.data], minlength=high - low).astype(np.int64)
                whole = w.data.tobytes()
                lines = np.array([duplicate_lines(whole[a:b]) for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist())], np.int64)
                repeats = repeated_words(w)
                code, at = grams(words(data, offsets[low : high + 1], True), buckets)
                score = means(ratio, code, at, high - low)
                failed = (n < 20) | (100 * repeats > 30 * n)
                columns = [n.astype(np.int64), points, symbols, lines, repeats, failed, ~failed & (score >= least), score]
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(low, high - low), *map(pa.array, columns)], names)

    kinds = ["long"] * 5 + ["boolean"] * 2 + ["double"]
    return docs.select(key, text).mapInArrow(run, ", ".join([f"`{key}` {docs.schema[key].dataType.simpleString()}", *(f"{n} {k}" for n, k in zip(names[1:], kinds))]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, *fit(docs, trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))))

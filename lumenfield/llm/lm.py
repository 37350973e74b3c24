"""Language-model scoring by context-tree weighting, beside a unigram base.

The model reads a text as its tokens are spelled: the bytes of each word (A-Z lower-cased)
and one space, at last one end sign. A byte is eight binary decisions; each decision has,
for the contexts of 0 to ``DEPTH`` bytes before it, Krichevsky-Trofimov estimates from the
training texts. Context-tree weighting mixes the estimates of all depths: a node's weighted
probability is half its own estimate and half the product of its children's. Contexts run
on across the spaces between words; only before the first word are they filled with spaces.
No context is left out, however rare.

The tree is a table. A node is a long: the bytes of its context, the latest first, and the
number of the decision. Weights climb from the deepest contexts to the root, and
predictions descend again, by stages that are dealt by the first bytes of the context; a
group holds the distinct contexts of a few more bytes, not their occurrences. Grams of all
texts take part, those of other texts with a count of 0, which leaves all weights as they
are and gives every text its score.

The texts that are learned from are scored with them: some texts of ``CHUNK`` bytes, fewer where
they hold more than ``GRAMS`` different grams, send their distinct grams once, packed and dealt by
the last four bytes of the context, and get a number for each of them back. Their words go the same
way and come back with their counts. ``fit`` gives the grams as a table instead, and ``unit_scores``
joins other units with it; grams of most places in that table are at most ``HEAD`` and go to every
task, the rest is joined.

Null texts count as empty: one token, the end. Repeated ids are scored row by row. An empty
table gives no rows; without training rows the counts are 0 and all bytes equally likely.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumenfield.llm.language import held_out
from lumenfield.llm.texts import LOWER, SPACE, cuts, flat, groups, mix, weights
from lumenfield.session import work_path

DEPTH = 7
STAGES = ((7, 4), (4, 2), (2, 1))
HEAD = 1 << 20
FLUSH = 300_000
BLOCK = 1 << 17
FOLD = 1 << 20
SENT = 1 << 16
SMALL = 1 << 12
CHUNK = 1 << 26
GRAMS = 7 << 20
SHARES = 256
PART = 1 << 21
U64 = np.uint64
ROWS = "code long, x double, y double, z double, kind int"
Spell = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def grams_of(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, unit): each byte of some units below its context of ``DEPTH`` bytes, the latest on top; before a unit are spaces."""
    blank = b" " * DEPTH
    out = np.frombuffer(b"".join([x for unit in units for x in (blank, unit)]), np.uint8).astype(U64)
    sizes = np.array([len(unit) for unit in units], np.int64)
    unit = np.repeat(np.arange(len(units)), sizes)
    at = np.arange(len(unit)) + DEPTH * (unit + 1)
    gram = out[at]
    for back in range(1, DEPTH + 1):
        gram |= out[at - back] << U64(64 - 8 * back)
    return gram, unit


def spelled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams of single words, each with a space behind it; an empty word is the end."""
    places = offsets.tolist()
    return grams_of([data[a:b].tobytes() + b" " if a < b else b"\xff" for a, b in zip(places, places[1:])])


def stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends) of whole texts: all words, each with a space behind it, and the end; ``ends`` has where each text ends."""
    data = LOWER[data[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    space = SPACE[data]
    after = np.concatenate([[True], space[:-1]])[: len(data)]
    after[offsets[:-1][offsets[:-1] < len(data)]] = True
    keep = ~(space & after)
    out = data[keep]
    out[space[keep]] = 32
    cut = np.concatenate([[0], np.cumsum(keep)])[offsets]
    # a last word without a space behind it gets one
    more = (np.diff(cut) > 0) & ~space[np.maximum(offsets[1:] - 1, 0)] if len(data) else np.zeros(len(offsets) - 1, bool)
    ends = np.cumsum(np.diff(cut) + more + 1)
    said = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    said[ends - 1] = 255
    for low, high, end, extra in zip(cut[:-1].tolist(), cut[1:].tolist(), ends.tolist(), more.tolist()):
        said[end - 1 - extra - high + low : end - 1 - extra] = out[low:high]
    return said, ends


def grams_along(said: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The grams of a stream, place by place."""
    if not len(said):
        return np.zeros(0, U64)
    # eight spaces before each text let a context be read as one number
    laid = np.full(len(said) + 8 * len(ends), 32, np.uint8)
    own = np.ones(len(laid), bool)
    for i, (low, high) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
        at = low + 8 * i
        own[at : at + 8] = False
        laid[at + 8 : at + 8 + high - low] = said[low:high]
    eight = np.ndarray(len(laid) - 8, "<u8", laid, 0, (1,))
    return eight[own[8:]] & ~U64(255) | said


def running(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams of whole texts: all words, each with a space behind it, and the end."""
    said, ends = stream(data, offsets)
    return grams_along(said, ends), np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))


def words_of(said: np.ndarray, ends: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of a stream, with the space behind them, and how many each text has."""
    words = np.delete(said, ends - 1)
    last = np.flatnonzero(words == 32) + 1
    places = np.concatenate([[0], last]).astype(np.int32)
    column = pa.Array.from_buffers(pa.binary(), len(last), [None, pa.py_buffer(places), pa.py_buffer(words)])
    upto = np.searchsorted(last, ends - np.arange(1, len(ends) + 1), "right")
    return column.dictionary_encode(), np.diff(upto, prepend=0)


def listed(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of binary values."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def hashes_of(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; words end in a space, so none is empty."""
    data, offsets = listed(words)
    sizes = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
    value = (data.astype(U64) + U64(1)) * weights(int(sizes.max()), seed + 2)[place]
    return mix(np.add.reduceat(value, offsets[:-1]) + sizes.astype(U64))


def words_in(blobs: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of some lists, one after the other, and how many each list holds."""
    data = np.frombuffer(b"".join(blobs), np.uint8)
    last = np.flatnonzero(data == 32) + 1
    places = np.concatenate([[0], last]).astype(np.int32)
    upto = np.searchsorted(last, np.cumsum([len(x) for x in blobs]), "right")
    return pa.Array.from_buffers(pa.binary(), len(last), [None, pa.py_buffer(places), pa.py_buffer(data)]), np.diff(upto, prepend=0)


class Counts:
    """Counts of words, found again by hashes that no two of them share."""

    def __init__(self, words: pa.Array, n: np.ndarray) -> None:
        found = words.dictionary_encode()
        total = np.zeros(len(found.dictionary), np.int64)
        total[found.indices.to_numpy()] = n
        for self.seed in range(1 << 16):
            hashes = hashes_of(found.dictionary, self.seed) if len(total) else np.zeros(0, U64)
            order = np.argsort(hashes)
            self.hashes, self.n = hashes[order], total[order]
            if (self.hashes[1:] != self.hashes[:-1]).all():
                return
        raise ValueError("words share all hashes")

    def of(self, words: pa.Array) -> np.ndarray:
        return self.n[np.searchsorted(self.hashes, hashes_of(words, self.seed))] if len(words) else np.zeros(0, np.int64)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 0.5, by Stirling's series from x + 6."""
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))


@lru_cache(1)
def small_gammas() -> tuple[np.ndarray, np.ndarray]:
    """``log_gamma`` of n + 0.5 and of n + 1 for counts below ``SMALL``."""
    n = np.arange(SMALL, dtype=float)
    return log_gamma(n + 0.5), log_gamma(n + 1)


def settle(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log weighted probability, share of the own estimate, estimate of a one) of decisions; ``below`` is None at the leaves."""
    past = np.zeros(len(zeros))
    half, whole = small_gammas()
    # in short pieces, whose passing arrays stay small
    for low in range(0, len(past), SENT):
        a, b = zeros[low : low + SENT], ones[low : low + SENT]
        total = a + b
        i, j = np.minimum(a, SMALL - 1).astype(np.int32), np.minimum(b, SMALL - 1).astype(np.int32)
        both = np.minimum(i + j, SMALL - 1)
        value = half[i] + half[j] - whole[both] - np.log(np.pi)
        value[total == 0] = 0
        other = (both != total) | (i != a)
        a, b = a[other], b[other]
        value[other] = log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - np.log(np.pi)
        past[low : low + SENT] = value
    one = (ones + 0.5) / (zeros + ones + 1)
    if below is None:
        return past, np.ones(len(past)), one
    mixed = np.logaddexp(past, below) - np.log(2)
    return mixed, np.exp(past - np.log(2) - mixed), one


def top(level: int) -> np.uint64:
    """The bits of a node at this depth: its context and the number of the decision."""
    return U64(((1 << 64) - (1 << (64 - 8 * level))) | 255)


def numbered(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, ascending, and the place of each number among them."""
    order = np.argsort(code)
    ascending = code[order]
    first = np.ones(len(code), bool)
    first[1:] = ascending[1:] != ascending[:-1]
    place = np.empty(len(code), np.int64)
    place[order] = np.cumsum(first) - 1
    return ascending[first], place


def decisions(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, zeros, ones, place, bit): the deepest nodes, and for all grams, decision by decision, their node and what they decide.

    Grams of a context come one after another, by their bytes; so do those of a node, which needs no sorting then.
    """
    byte, context = (gram & U64(255)).astype(np.int64), gram & ~U64(255)
    bit = np.concatenate([(byte >> (7 - depth)) & 1 for depth in range(8)]).astype(bool)
    code, zeros, ones, places, before = [], [], [], [], 0
    for depth in range(8):
        node = context | ((1 << depth) | (byte >> (8 - depth))).astype(U64)
        first = np.ones(len(node), bool)
        first[1:] = node[1:] != node[:-1]
        at = np.flatnonzero(first)
        up = bit[depth * len(node) : (depth + 1) * len(node)]
        code.append(node[at])
        ones.append(np.add.reduceat(n * up, at, dtype=float) if len(at) else np.zeros(0))
        zeros.append(np.add.reduceat(n * ~up, at, dtype=float) if len(at) else np.zeros(0))
        places.append(np.cumsum(first) + (before - 1))
        before += len(at)
    return np.concatenate(code), np.concatenate(zeros), np.concatenate(ones), np.concatenate(places), bit


def rise(code: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None, high: int, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
    """The nodes of depth ``low`` above some of depth ``high`` (node, zeros, ones, log product of the children), and the steps between."""
    steps = []
    for level in range(high - 1, low - 1, -1):
        mixed, own, one = settle(zeros, ones, below)
        code, up = numbered(code & top(level))
        steps.append((own, one, up))
        zeros, ones, below = (np.bincount(up, v, len(code)) for v in (zeros, ones, mixed))
    return code, zeros, ones, below, steps


def fall(said: np.ndarray, left: np.ndarray, steps: list) -> tuple[np.ndarray, np.ndarray]:
    """Down the steps of ``rise``: what shallower nodes say for a one, and the share left to deeper ones."""
    for own, one, up in reversed(steps):
        said, left = said[up] + left[up] * own * one, left[up] * (1 - own)
    return said, left


def blocks(batches: Iterator[pa.RecordBatch], low: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of rows that arrive sorted by code, in blocks that keep contexts of one start of ``low`` bytes together."""
    rest: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        code = batch.column("code").to_numpy().view(U64)
        rest.append((code, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "z", "kind"))))
        if sum(len(r[0]) for r in rest) < BLOCK:
            continue
        rows = tuple(np.concatenate(c) for c in zip(*rest))
        start = rows[0] >> U64(64 - 8 * low)
        last = np.flatnonzero(start != start[-1])
        cutting = int(last[-1]) + 1 if len(last) else 0
        if cutting:
            yield tuple(c[:cutting] for c in rows)
        rest = [tuple(c[cutting:] for c in rows)]
    if rest and len(rest[0][0]):
        yield tuple(np.concatenate(c) for c in zip(*rest))


def said_rows(code: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"code": code.view(np.int64), "x": x, "y": y, "z": z, "kind": np.full(len(code), kind, np.int32)})


def dealt(rows: DataFrame, low: int) -> DataFrame:
    return rows.repartition(F.shiftrightunsigned("code", 64 - 8 * low)).sortWithinPartitions("code")


def climb(rows: DataFrame, high: int, low: int) -> DataFrame:
    """Nodes of depth ``low`` (zeros, ones, log product of the children) from those of depth ``high``, or from grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, x, y, z, _ in blocks(batches, low):
            leaves = decisions(code, x)[:3] + (None,) if high == DEPTH else (code, x, y, z)
            yield said_rows(*rise(*leaves, high, low)[:4], 0)

    return stored(dealt(rows, low).mapInArrow(run, ROWS), "nodes")


def descend(rows: DataFrame, above: DataFrame, high: int, low: int) -> DataFrame:
    """(said, left) of nodes of depth ``high`` from those of depth ``low``; of grams, (log10 probability, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, x, y, z, kind in blocks(batches, low):
            up, own = kind == 1, kind == 0
            order = np.argsort(code[up])
            said, left = x[up][order], y[up][order]
            code, x, y, z = code[own], x[own], y[own], z[own]
            if high < DEPTH:
                yield said_rows(code, *fall(said, left, rise(code, x, y, z, high, low)[4]), z, 1)
                continue
            node, zeros, ones, place, bit = decisions(code, x)
            one = fall(said, left, rise(node, zeros, ones, None, high, low)[4])[0][place]
            yield said_rows(code, np.log10(np.where(bit, one, 1 - one)).reshape(8, -1).sum(axis=0), y, z, 1)

    return stored(dealt(rows.unionByName(above), low).mapInArrow(run, ROWS), "said")


def fit(units: DataFrame, spell: Spell = spelled, text: str = "word") -> DataFrame:
    """(gram, log10 probability, places in all units) of every gram of ``units``; column ``n`` is what a unit counts in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def fold() -> None:
            code, x, y = (np.concatenate(c) for c in zip(*held))
            code, place = np.unique(code, return_inverse=True)
            held[:] = [(code, np.bincount(place, x, len(code)), np.bincount(place, y, len(code)))]

        def said() -> Iterator[pa.RecordBatch]:
            code, x, y = held.pop()
            rows = said_rows(code, x, y, np.zeros(len(code)), 0)
            yield from (rows.slice(at, SENT) for at in range(0, len(code), SENT))

        for batch in batches:
            data, offsets = flat(batch.column(text))
            n = batch.column("n").to_numpy()
            for low, high in cuts(offsets):
                gram, unit = spell(data, offsets[low : high + 1])
                code, place = np.unique(gram, return_inverse=True)
                held.append((code, np.bincount(place, n[low:high][unit], len(code)), np.bincount(place, minlength=len(code)).astype(float)))
                if sum(len(h[0]) for h in held) > FOLD:
                    fold()
                    if len(held[0][0]) > FOLD // 2:
                        yield from said()
        if held:
            fold()
            yield from said()

    grams = units.select(text, "n").mapInArrow(run, ROWS).groupBy("code").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    rows = [stored(grams.select("code", "x", "y", F.lit(0.0).alias("z"), F.lit(0).alias("kind")), "grams")]
    for high, low in STAGES:
        rows.append(climb(rows[-1], high, low))
    above = from_root(rows.pop())
    for high, low in reversed(STAGES):
        above = descend(rows.pop(), above, high, low)
    return above.select(F.col("code").alias("gram"), F.col("x").alias("log"), F.col("y").alias("places"))


def from_root(rows: DataFrame) -> DataFrame:
    """(said, left) of the nodes of depth 1, at most 256 contexts of one byte with 255 decisions each."""
    table = rows.toArrow()
    code, x, y, z = (table.column(c).to_numpy() for c in ("code", "x", "y", "z"))
    _, zeros, ones, below, steps = rise(code.view(U64), x, y, z, 1, 0)
    _, own, one = settle(zeros, ones, below)
    said, left = fall(own * one, 1 - own, steps)
    return rows.sparkSession.createDataFrame(pa.Table.from_batches([said_rows(code.view(U64), said, left, np.zeros(len(code)), 1)]), ROWS)


def in_chunks(units: DataFrame, text: str = "text") -> DataFrame:
    """``units`` with ``chunk``, the least id of some that follow each other and hold about ``CHUNK`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = None, 0
        for batch in batches:
            _, offsets = flat(batch.column(text))
            chunks = []
            for at, size in zip(batch.column("id").to_pylist(), np.diff(offsets).tolist()):
                if chunk is None or held >= CHUNK:
                    chunk, held = at, 0
                held += size
                chunks.append(chunk)
            yield batch.append_column("chunk", pa.array(chunks, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema)
    return units.mapInArrow(run, f"{schema}, chunk long")


def packed(code: np.ndarray) -> bytes:
    """Ascending numbers as their steps, byte by byte."""
    steps = np.diff(code, prepend=U64(0))
    return zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U64).ravel(), dtype=U64)


def sealed(logs: np.ndarray) -> bytes:
    """Logarithms of probabilities in steps of 2^-40, far below what their sums round off: six bytes each, the highest compressed.

    Numbers of 255 and more, which eight decisions do not reach, would go as they are.
    """
    if not (logs > -255).all():
        return b"\0" + logs.tobytes()
    steps = np.rint(logs * -(1 << 40)).astype(U64)
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return b"\1" + planes[:5].tobytes() + zlib.compress(planes[5].tobytes(), 1)


def opened(data: pa.Buffer, n: int) -> np.ndarray:
    if data[:1].to_pybytes() == b"\0":
        return np.frombuffer(data[1:].to_pybytes())
    planes = np.zeros((8, n), np.uint8)
    planes[:5] = np.frombuffer(data, np.uint8, 5 * n, 1).reshape(5, n)
    planes[5] = np.frombuffer(zlib.decompress(data[5 * n + 1 :]), np.uint8)
    return np.ascontiguousarray(planes.T).view(U64).ravel() / -(1 << 40)


def distinct(code: np.ndarray) -> np.ndarray:
    """Distinct numbers, ascending; by sorting, which beats numpy's hashing of millions."""
    code = np.sort(code)
    return code[np.concatenate([[True], code[1:] != code[:-1]])] if len(code) else code


def counted(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, ascending, and the sums of what goes with them."""
    order = np.argsort(code)
    code, n = code[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(n, first) if len(code) else n


def part_of(code: np.ndarray, parts: int) -> np.ndarray:
    """The part of a gram or node, by the last four bytes of its context."""
    return (mix(code >> U64(32)) % U64(parts)).astype(np.int64)


def by_part(code: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, indices) of ascending numbers; the indices ascend too."""
    # numpy sorts 16 bits by counting
    part = part_of(code, parts).astype(np.uint16 if parts <= 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    yield from ((int(part[own[0]]), own) for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(own))


def merged(code: np.ndarray, n: np.ndarray, new: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, ascending, and their counts, with some more, distinct and ascending too."""
    at = np.searchsorted(code, new)
    old = np.zeros(len(new), bool)
    inside = at < len(code)
    old[inside] = code[at[inside]] == new[inside]
    n[at[old]] += times[old]
    fresh = at[~old] + np.arange(len(new) - int(old.sum()))
    kept = np.ones(len(code) + len(fresh), bool)
    kept[fresh] = False
    out = []
    for all_, added in ((code, new[~old]), (n, times[~old])):
        both = np.empty(len(kept), all_.dtype)
        both[kept], both[fresh] = all_, added
        out.append(both)
    return out[0], out[1]


def by_share(code: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(share, indices) of ascending numbers: parts are dealt to ``SHARES``, so that what is sorted and copied at once is little."""
    share = (part_of(code, parts) % SHARES).astype(np.uint8)
    order = np.argsort(share, kind="stable")
    ends = np.cumsum(np.bincount(share, minlength=SHARES)).tolist()
    yield from ((i, order[a:b]) for i, (a, b) in enumerate(zip([0, *ends], ends)) if a < b)


def shrunk(n: np.ndarray) -> bytes:
    return zlib.compress(n.astype(np.min_scalar_type(n.max())).tobytes(), 1)


def asked_by(units: DataFrame, parts: int, text: str) -> DataFrame:
    """What chunks of units ask for, and the units, in one table.

    (part, chunk, codes, counts): the distinct grams of a chunk, packed, with their counts in
    training; from part ``parts`` on its words, each with a space behind it, once or more often.
    Rows without a part hold some units spelled (``said``) and lists of their other columns. A
    chunk of many different grams is parted further, so that a task holds few.
    """
    others = [c for c in units.columns if c not in (text, "n", "chunk")]
    kinds = [units.schema[c].dataType.simpleString() for c in others]
    names = ["part", "chunk", "codes", "counts", "said", *others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, U64), np.zeros(0, np.int64))
        grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        tally: list[tuple[pa.Array, np.ndarray]] = []
        chunk = given = None
        size = 0
        types: list[pa.DataType] = []

        def row(part: int | None, codes: bytes | None, counts: bytes | None, said: bytes | None, lists: list[pa.Array]) -> pa.RecordBatch:
            own = [pa.array([x], kind) for x, kind in ((part, pa.int64()), (chunk, pa.int64()), (codes, pa.binary()), (counts, pa.binary()), (said, pa.binary()))]
            return pa.RecordBatch.from_arrays([*own, *(lists or [pa.nulls(1, kind) for kind in types])], names)

        def folded() -> None:
            found = pa.concat_arrays([words for words, _ in tally]).dictionary_encode()
            count = np.bincount(found.indices.to_numpy(), np.concatenate([x for _, x in tally]), len(found.dictionary))
            tally[:] = [(found.dictionary, count.astype(np.int64))]

        def said_words() -> Iterator[pa.RecordBatch]:
            if not sum(len(words) for words, _ in tally):
                return
            folded()
            words, count = tally.pop()
            part = (hashes_of(words) % U64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            data, offsets = listed(words.take(pa.array(order)))
            first = np.flatnonzero(np.diff(part[order], prepend=-1))
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
                yield row(parts + int(part[order[a]]), zlib.compress(data[offsets[a] : offsets[b]].tobytes(), 1), shrunk(count[order[a:b]]), None, [])

        def gathered() -> None:
            new = distinct(np.concatenate([code for code, _ in held]))
            times = np.zeros(len(new), np.int64)
            for code, count in held:
                times[np.searchsorted(new, code)] += count
            held.clear()
            for share, own in by_share(new, parts):
                grams[share] = merged(*grams.get(share, none), new[own], times[own])

        def said_all() -> Iterator[pa.RecordBatch]:
            if held:
                gathered()
            for code, n in grams.values():
                for part, own in by_part(code, parts):
                    yield row(part, packed(code[own]), shrunk(n[own]), None, [])
            grams.clear()
            yield from said_words()

        for batch in batches:
            types = [pa.list_(batch.column(c).type) for c in others]
            chunks, learned, ids = batch.column("chunk").to_numpy(), batch.column("n").to_numpy(), batch.column("id").to_numpy()
            data, offsets = flat(batch.column(text))
            borders = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
            for a, b in zip(borders, borders[1:]):
                for low, high in cuts(offsets[a : b + 1]):
                    own = slice(a + low, a + high)
                    if chunks[own.start] != given or sum(len(code) for code, _ in grams.values()) > GRAMS or size >= CHUNK:
                        if given is not None:
                            yield from said_all()
                        given, chunk, size = chunks[own.start], int(ids[own.start]), 0
                    size += int(offsets[own.stop] - offsets[own.start])
                    said, ends = stream(data, offsets[own.start : own.stop + 1])
                    lists = [pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), batch.column(c).slice(own.start, high - low)) for c in others]
                    bundle = ends.astype(np.int64).tobytes() + said.tobytes()
                    yield row(None, None, None, len(bundle).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(bundle, asbytes=True), lists)
                    gram, weight = grams_along(said, ends), learned[own]
                    for w in np.unique(weight).tolist():
                        code, times = np.unique(gram[np.repeat(weight == w, np.diff(ends, prepend=0))], return_counts=True)
                        held.append((code, times * int(w)))
                    if sum(len(code) for code, _ in held) > 2 * FOLD:
                        gathered()
                    found, sizes = words_of(said, ends)
                    times = np.bincount(found.indices.to_numpy(), np.repeat(weight, sizes), len(found.dictionary))
                    tally.append((found.dictionary, times.astype(np.int64)))
                    if sum(len(words) for words, _ in tally) > 2 * FLUSH:
                        folded()
                        if len(tally[0][0]) > FLUSH:
                            yield from said_words()
        if given is not None:
            yield from said_all()

    schema = ", ".join(["part long, chunk long, codes binary, counts binary, said binary", *(f"`{c}` array<{kind}>" for c, kind in zip(others, kinds))])
    return stored(units.mapInArrow(run, schema), "asked")


def counts_in(table: pa.Table, sizes: list[int]) -> list[np.ndarray]:
    raw = [zlib.decompress(x) for x in table.column("counts").to_pylist()]
    return [np.frombuffer(x, f"u{len(x) // size}").astype(np.int64) for x, size in zip(raw, sizes)]


def grams_in(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct grams of a part and their counts; the grams row by row."""
    codes = [unpacked(x) for x in table.column("codes").to_pylist()]
    return *counted(np.concatenate(codes), np.concatenate(counts_in(table, [len(c) for c in codes]))), codes


def pieces_of(code: np.ndarray, low: int) -> Iterator[slice]:
    """Ascending grams in pieces of about ``BLOCK`` that keep contexts of one start of ``low`` bytes together."""
    start, at = code >> U64(64 - 8 * low), 0
    while at < len(code):
        end = min(at + BLOCK, len(code))
        if end < len(code):
            cutting = int(np.searchsorted(start, start[end]))
            end = cutting if cutting > at else int(np.searchsorted(start, start[end], "right"))
        yield slice(at, end)
        at = end


def word_answers(asked: DataFrame) -> DataFrame:
    """(chunk, part, codes, sent, n, v): the words of each row of ``asked`` with their counts in all training texts.

    ``n`` and ``v`` sum up to the words and to the different words in training.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["part"]):
            words, sizes = words_in([zlib.decompress(x) for x in table.column("codes").to_pylist()])
            found = words.dictionary_encode()
            total = np.bincount(found.indices.to_numpy(), np.concatenate(counts_in(table, sizes.tolist())), len(found.dictionary)).astype(np.int64)
            ends = np.cumsum(sizes)
            sent = [shrunk(total[found.indices[a:b].to_numpy()]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
            rest = [0] * (len(sizes) - 1)
            yield pa.RecordBatch.from_pydict({"chunk": table.column("chunk").combine_chunks(), "part": table.column("part").combine_chunks(), "codes": table.column("codes").combine_chunks(), "sent": pa.array(sent, pa.binary()), "n": pa.array([int(total.sum()), *rest], pa.int64()), "v": pa.array([int((total > 0).sum()), *rest], pa.int64())})

    dealt_words = asked.repartition("part").sortWithinPartitions("part")
    return stored(dealt_words.mapInArrow(run, "chunk long, part long, codes binary, sent binary, n long, v long"), "words")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of 4 MB on their way to Python, for what runs meanwhile; rows of packed grams are large, and several copies of a batch are held at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "4m")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def own_scores(units: DataFrame, text: str = "text") -> DataFrame:
    """(id, ..., log, n_tokens, n_known, base, n_bytes, n, v) of ``units(id, text, n, chunk, ...)``.

    ``log`` is the log10 probability of a unit by the model learned from all of them; column ``n``
    is what a unit counts in training, an integer. ``base`` is the sum of log10(c + 1) over the
    tokens, ``n`` and ``v`` are the tokens and the different tokens in training.
    """
    with small_batches(units.sparkSession):
        return scores_of(units, text)


def scores_of(units: DataFrame, text: str) -> DataFrame:
    high, low = STAGES[0]
    whole = units.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("size"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    parts, ended = int(max(whole["size"] // PART, 1)), int(whole["n"])
    both = asked_by(units, parts, text)
    others = both.columns[5:]
    asked = both.filter(F.col("part") < parts).select("part", "chunk", "codes", "counts")
    words = word_answers(both.filter(F.col("part") >= parts).select("part", "chunk", "codes", "counts"))
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()

    def rising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["part"]):
            code, n, _ = grams_in(table)
            for piece in pieces_of(code, low):
                nodes = said_rows(*rise(*decisions(code[piece], n[piece])[:3], None, high, low)[:4], 0)
                yield from (nodes.slice(at, SENT) for at in range(0, nodes.num_rows, SENT))

    rows = [stored(asked.repartition("part").sortWithinPartitions("part").mapInArrow(rising, ROWS), "nodes")]
    for upper, lower in STAGES[1:]:
        rows.append(climb(rows[-1], upper, lower))
    above = from_root(rows.pop())
    for upper, lower in reversed(STAGES[1:]):
        above = descend(rows.pop(), above, upper, lower)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, x, y = (batch.column(c).to_numpy() for c in ("code", "x", "y"))
            own = [(part, at) for part, at in by_part(code.view(U64), parts)]
            yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in own], pa.int64()), "chunk": pa.nulls(len(own), pa.int64()), "codes": pa.array([code[at].tobytes() for _, at in own], pa.binary()), "counts": pa.array([np.stack([x[at], y[at]]).tobytes() for _, at in own], pa.binary())})

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["part"]):
            is_node = table.column("chunk").is_null()
            nodes, table = table.filter(is_node), table.filter(pa.array(~is_node.to_numpy()))
            node = np.concatenate([np.frombuffer(x, U64) for x in nodes.column("codes").to_pylist()])
            said = np.concatenate([np.frombuffer(x).reshape(2, -1) for x in nodes.column("counts").to_pylist()], axis=1)[:, np.argsort(node)]
            node = np.sort(node)
            code, n, codes = grams_in(table)
            logs = np.zeros(len(code))
            for piece in pieces_of(code, low):
                own, zeros, ones, place, bit = decisions(code[piece], n[piece])
                steps = rise(own, zeros, ones, None, high, low)
                up = np.searchsorted(node, steps[0])
                one = fall(*said[:, up], steps[4])[0][place]
                logs[piece] = np.log10(np.where(bit, one, 1 - one)).reshape(8, -1).sum(axis=0)
            for chunk, part, wanted, asked_codes in zip(table.column("chunk"), table.column("part"), codes, table.column("codes")):
                yield pa.RecordBatch.from_arrays([pa.array([x.as_py()], kind) for x, kind in ((chunk, pa.int64()), (part, pa.int64()), (asked_codes, pa.binary()))] + [pa.array([sealed(logs[np.searchsorted(code, wanted)])], pa.binary()), *(pa.nulls(1, kind) for kind in lists)], names)

    names = ["chunk", "part", "codes", "sent", *others]
    kinds = [both.schema[c].dataType for c in others]
    lists = [to_arrow_type(kind) for kind in kinds]
    done = ["log", "n_tokens", "n_known", "base", "n_bytes"]

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = None
        answered: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        blobs: list[bytes] = []
        times: list[np.ndarray] = []
        counts: Counts | None = None
        for batch in batches:
            chunks, parted, sent = batch.column("chunk").to_numpy(), batch.column("part").to_numpy(), batch.column("sent")
            for i in range(batch.num_rows):
                if chunks[i] != chunk:
                    chunk, answered, blobs, times, counts = chunks[i], {}, [], [], None
                if parted[i] < parts:
                    code = unpacked(batch.column("codes")[i].as_py())
                    answered.setdefault(int(parted[i]) % SHARES, []).append((code, opened(sent[i].as_buffer(), len(code))))
                    continue
                if parted[i] < 2 * parts:
                    blobs.append(zlib.decompress(batch.column("codes")[i].as_py()))
                    raw = zlib.decompress(sent[i].as_py())
                    times.append(np.frombuffer(raw, f"u{len(raw) // blobs[-1].count(b' ')}").astype(np.int64))
                    continue
                if counts is None:
                    for share, some in answered.items():
                        code, log = (np.concatenate(x) for x in zip(*some))
                        order = np.argsort(code)
                        answered[share] = [(code[order], log[order])]
                    counts = Counts(words_in(blobs)[0], np.concatenate(times) if times else np.zeros(0, np.int64))
                    blobs, times = [], []
                bundle = sent[i].as_py()
                raw = np.frombuffer(pa.Codec("zstd").decompress(bundle[8:], int.from_bytes(bundle[:8], "little")), np.uint8)
                columns = [batch.column(c)[i].values for c in others]
                m = len(columns[0])
                ends, said = raw[: 8 * m].view(np.int64), raw[8 * m :]
                gram = grams_along(said, ends)
                order = np.argsort(gram)
                gram = gram[order]
                first = np.ones(len(gram), bool)
                first[1:] = gram[1:] != gram[:-1]
                asked_for = gram[first]
                got = np.empty(len(asked_for))
                for share, at in by_share(asked_for, parts):
                    code, log = answered[share][0]
                    got[at] = log[np.searchsorted(code, asked_for[at])]
                along = np.empty(len(gram))
                along[order] = got[np.cumsum(first) - 1]
                found, sizes = words_of(said, ends)
                known = counts.of(found.dictionary)[found.indices.to_numpy()]
                text_of = np.repeat(np.arange(m), sizes)
                # each text has one end
                n_known = np.bincount(text_of, known > 0, m).astype(np.int64) + (ended > 0)
                base = np.bincount(text_of, np.log10(known + 1.0), m) + np.log10(ended + 1.0)
                own = [np.add.reduceat(along, np.append(0, ends[:-1])), sizes + 1, n_known, base, np.diff(ends, prepend=0)]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, own)], [*others, *done])

    packed_nodes = above.mapInArrow(told, "part long, chunk long, codes binary, counts binary")
    dealt_parts = asked.unionByName(packed_nodes).repartition("part").sortWithinPartitions("part")
    carried = ", ".join(f"`{c}` {kind.simpleString()}" for c, kind in zip(others, kinds))
    sent = dealt_parts.mapInArrow(answers, f"chunk long, part long, codes binary, sent binary, {carried}")
    # a chunk's answers come before its units
    bundles = both.filter(F.col("part").isNull()).select("chunk", F.lit(2 * parts).cast("long").alias("part"), F.lit(None).cast("binary").alias("codes"), F.col("said").alias("sent"), *others)
    every = sent.unionByName(words.drop("n", "v"), allowMissingColumns=True).unionByName(bundles)
    out = ", ".join(f"`{c}` {kind.elementType.simpleString()}" for c, kind in zip(others, kinds))
    scored = every.repartition("chunk").sortWithinPartitions("chunk", "part").mapInArrow(scores, f"{out}, log double, n_tokens long, n_known long, base double, n_bytes long")
    return stored(scored, "scores").withColumns({"n": F.lit(int(size["n"]) + ended).cast("long"), "v": F.lit(int(size["v"]) + (ended > 0)).cast("long")})


def often_from(grams: DataFrame, head: int) -> int:
    """The least number of places from which on there are at most ``head`` grams; counted by powers of two in 16 steps."""
    step = F.floor(F.log2("places") * 16)
    sizes = sorted(((r["step"], r["count"]) for r in grams.groupBy(step.alias("step")).count().collect()), reverse=True)
    least = None
    for at, count in sizes:
        head -= count
        if head < 0:
            break
        least = at
    return least


def unit_scores(units: DataFrame, grams: DataFrame, head: int = HEAD, spell: Spell = spelled, text: str = "word") -> DataFrame:
    """(id, log): the log10 probability of every unit by its grams."""
    least = often_from(grams, head)
    often = F.floor(F.log2("places") * 16) >= least if least is not None else F.lit(False)
    frequent = grams.filter(often).select("gram", "log").toArrow()
    gram, log = frequent.column("gram").to_numpy().view(U64), frequent.column("log").to_numpy()
    shared = units.sparkSession.sparkContext.broadcast((np.sort(gram), log[np.argsort(gram)]))
    names = ["id", "gram", "tail", "times", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = shared.value
        for batch in batches:
            data, offsets = flat(batch.column(text))
            ids = batch.column("id").to_numpy()
            for low, high in cuts(offsets):
                gram, unit = spell(data, offsets[low : high + 1])
                at = np.minimum(np.searchsorted(known, gram), max(len(known) - 1, 0))
                hit = known[at] == gram if len(known) else np.zeros(len(gram), bool)
                m = high - low
                own = np.bincount(unit[hit], logs[at[hit]], m).astype(float)
                # a unit's own row joins with nothing; its id spreads it
                yield pa.RecordBatch.from_arrays([pa.array(ids[low:high]), pa.array(ids[low:high]), pa.array(np.zeros(m, bool)), pa.array(np.ones(m, np.int64)), pa.array(own)], names)
                order = np.lexsort((gram[~hit], unit[~hit]))
                gram, unit = gram[~hit][order], unit[~hit][order]
                first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (unit[1:] != unit[:-1])])) if len(gram) else np.zeros(0, np.int64)
                r = len(first)
                rows = pa.RecordBatch.from_arrays([pa.array(ids[low:high][unit[first]]), pa.array(gram[first].view(np.int64)), pa.array(np.ones(r, bool)), pa.array(np.diff(np.append(first, len(gram)))), pa.array(np.zeros(r))], names)
                yield from (rows.slice(at, SENT) for at in range(0, r, SENT))

    rows = units.select("id", text).mapInArrow(run, "id long, gram long, tail boolean, times long, own double")
    rest = grams.filter(~often).select("gram", F.lit(True).alias("tail"), "log")
    return rows.join(rest, ["gram", "tail"], "left").groupBy("id").agg((F.sum("own") + F.coalesce(F.sum(F.col("times") * F.col("log")), F.lit(0.0))).alias("log"))


def word_scores(words: DataFrame, grams: DataFrame, head: int = HEAD) -> DataFrame:
    """(word, n, log): the log10 probability of every word as a unit of its own."""
    return words.join(unit_scores(words, grams, head), "id").select("word", "n", "log")


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """Scores of all rows of ``docs`` by models of the rows that fit the condition ``train``.

    ``head`` changes nothing: no words go to every task any more.
    """
    learn = F.coalesce(train, F.lit(False)).cast("long")
    rows = docs.select(F.monotonically_increasing_id().alias("id"), F.col(key).alias("key"), (~train).alias("held_out"), learn.alias("n"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    # few large chunks ask for the fewest grams; every core gets one at least
    tasks = max(-(-size // (CHUNK * 4 // 5)), docs.sparkSession.sparkContext.defaultParallelism)
    scores = own_scores(rows.coalesce(int(tasks)).withColumn("chunk", F.lit(0).cast("long")))
    return scores.select(
        F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.col("n").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(F.col("n") + F.col("v") + 1)).alias("base_score"), F.col("log").alias("score"),
        (-F.col("log") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, ~held_out(7, 2))

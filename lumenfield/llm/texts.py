"""Flat numpy views of Arrow text batches: words, their hashes, and shingles of words.

A batch is cut into slices of whole documents of about ``SLICE`` bytes, so that the
arrays of a task stay bounded however long the batch is; a longer document is a slice of
its own. A null text counts as empty.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def once(key: tuple, make: Callable[[], Any]) -> Any:
    """``make()``, called once for ``key`` in a worker process.

    Task functions travel by value and get a module of their own in each task, so what is
    to outlive the task is kept among the process's modules.
    """
    held = sys.modules.setdefault("_made_once", types.ModuleType("_made_once")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = np.asarray(x).astype(U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def weights(n: int, seed: int = 0) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * U64(0x9E3779B97F4A7C15)) | U64(1)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def cuts(offsets: np.ndarray, limit: int = SLICE, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes and at most ``rows`` rows."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = min(max(int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1, low + 1), low + rows, n)
        yield low, high
        low = high


@dataclass
class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some documents; words of row i are ``first[i]:first[i + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    base = offsets[0]
    data, offsets = data[base : offsets[-1]], offsets - base
    if lower:
        data = LOWER[data]
    solid = ~SPACE[data]
    head = solid.copy()
    head[1:] &= ~solid[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    head[at] = solid[at]
    tail = solid.copy()
    tail[:-1] &= ~solid[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    tail[last] = solid[last]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    if len(starts):
        sizes = ends - starts
        before = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(before, sizes)
        value = (data[solid].astype(U64) + U64(1)) * weights(int(sizes.max()))[place]
        hashes = mix(np.add.reduceat(value, before) + sizes.astype(U64))
    else:
        hashes = np.zeros(0, U64)
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), hashes)


def word_slices(batch: pa.RecordBatch, column: str = "text", lower: bool = True, limit: int = SLICE) -> Iterator[tuple[int, int, Words]]:
    """(low, high, words) for slices of the batch's rows."""
    data, offsets = flat(batch.column(column))
    for low, high in cuts(offsets, limit):
        yield low, high, words(data, offsets[low : high + 1], lower)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, and where each row's runs begin and end (``first`` of the runs)."""
    n = len(w.hashes)
    total = np.zeros(max(n - k + 1, 0), U64)
    for i, factor in enumerate(weights(k, 1)):
        total += w.hashes[i : i + len(total)] * factor
    counts = np.diff(w.first)
    keep = np.ones(len(total), bool)
    inside = np.maximum(counts - k + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)[: len(total)]
    keep = np.arange(len(total)) - w.first[row] < inside[row] if len(total) else keep
    return mix(total[keep] + U64(k)), np.concatenate([[0], np.cumsum(inside)])


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """Each row's distinct k-word shingles as sorted hashes; with fewer words, the whole sequence as one."""
    runs, first = windows(w, k)
    sets = []
    for i in range(len(w.first) - 1):
        if first[i + 1] > first[i]:
            part = np.sort(runs[first[i] : first[i + 1]])
            sets.append(part[np.concatenate([[True], part[1:] != part[:-1]])])
        else:
            own = w.hashes[w.first[i] : w.first[i + 1]]
            sets.append(mix(np.array([(own * weights(k, 1)[: len(own)]).sum(dtype=U64) + U64(len(own))])) if len(own) else np.zeros(0, U64))
    return sets


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows that arrive sorted by ``keys``, one table each, across batch borders."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        change = np.zeros(table.num_rows - 1, bool)
        for key in keys:
            value = table.column(key).to_numpy()
            change |= value[1:] != value[:-1]
        borders = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(borders, borders[1:]):
            yield table.slice(a, b - a)
        rest = table.slice(borders[-1])
    if rest is not None:
        yield rest

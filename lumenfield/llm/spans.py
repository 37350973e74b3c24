"""Tokens of Arrow text batches as byte spans over one flat buffer, for operators that name their own token bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from lumenfield.llm.texts import LOWER


@dataclass
class Spans:
    """Maximal runs of solid bytes; the token i of row ``row[i]`` is ``data[starts[i]:ends[i]]``. ``data`` has A-Z lowered."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray


def spans(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> Spans:
    """``solid`` says of each of the 256 bytes whether it belongs to tokens; rows end tokens too."""
    base = int(offsets[0])
    data, offsets = LOWER[data[base : int(offsets[-1])]], offsets - base
    inside = solid[data]
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    tail[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < len(data)]
    head[first] = inside[first]
    last = offsets[1:][offsets[1:] > 0] - 1
    tail[last] = inside[last]
    starts = np.flatnonzero(head)
    return Spans(data, starts, np.flatnonzero(tail) + 1, np.searchsorted(offsets, starts, "right") - 1)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges ``starts[i] .. starts[i] + sizes[i]``, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An Arrow string column of byte ranges of ``data``."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    body = data[ranges(starts, sizes)] if len(starts) else data[:0]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(body))])

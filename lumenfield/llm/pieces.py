"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The symbols of all words of a block lie in one flat array. In each round every word finds
the least rank among its pairs (a segmented minimum) and merges the leftmost occurrences
of that pair; the array is compacted, until no pair is left. Merging all occurrences of
one word at once is exact only if no pair born of it has a lesser rank; where one does,
only the leftmost is merged in that round.

A word is a run of blanks marks with what follows it, since no piece holds a mark behind
another sign; signs that occur in no longer piece are words of their own. Words are encoded
once per block. Signs without a piece become their UTF-8 bytes. Decoding joins the pieces,
turns marks into blanks and drops the blank that encoding puts in front.

Null texts count as empty; empty texts have no ids. Other columns are kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumenfield.llm.texts import once

MARK = "▁"
NONE = np.int64(1 << 40)
BLOCK = 1 << 20
CACHE = 150_000


class Pieces:
    """The vocabulary of a BPE model with byte fallback: ranks of pairs, and bytes of pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        texts = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        plain = [not special[i] and not model.is_byte(i) for i in range(size)]
        self.ids = {t: i for i, t in enumerate(texts) if plain[i]}
        self.bytes = np.array([next(i for i in range(size) if model.is_byte(i) and int(texts[i][1:-1], 16) == b) for b in range(256)], np.int64)
        # rank order of pieces: best score first
        order = sorted(self.ids.values(), key=lambda i: (-model.get_score(i), i))
        rank = {i: r for r, i in enumerate(order)}
        pairs = {}
        for text, i in self.ids.items():
            for k in range(1, len(text)):
                left, right = self.ids.get(text[:k]), self.ids.get(text[k:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = (rank[i], i)
        self.codes = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[c][0] for c in self.codes.tolist()], np.int64)
        self.made = np.array(order, np.int64)
        inside = {c for t in self.ids if len(t) > 1 for c in t}
        alone = sorted(c for c in map(chr, range(0x21)) if c not in inside)
        sign = re.escape("".join(alone))
        self.words = re.compile(f"{MARK}+[^{MARK}{sign}]*|[{sign}]|[^{MARK}{sign}]+")
        surface = [bytes([int(t[1:-1], 16)]) if model.is_byte(i) else b"" if special[i] else t.replace(MARK, " ").encode() for i, t in enumerate(texts)]
        self.surface = surface

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; ``NONE`` where the two don't merge. Symbols below 0 have no piece."""
        code = np.where((left < 0) | (right < 0), -1, left << 20 | np.maximum(right, 0))
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], NONE)

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, a round of merges at a time for all of them."""
        text = "".join(words)
        char = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        distinct, back = np.unique(char, return_inverse=True)
        ids = np.array([self.ids.get(chr(c), -1 - c) for c in distinct.tolist()], np.int64)
        symbol = ids[back] if len(ids) else np.zeros(0, np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_word, done_symbol = [], []
        rank = np.full(len(symbol), NONE)
        if len(symbol) > 1:
            rank[:-1] = np.where(word[:-1] == word[1:], self.rank_of(symbol[:-1], symbol[1:]), NONE)
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(word)))
            live = np.repeat(least < NONE, size)
            if not live.all():
                done_word.append(word[~live])
                done_symbol.append(symbol[~live])
                word, symbol, rank = word[live], symbol[live], rank[live]
                size, least = size[least < NONE], least[least < NONE]
                if not len(symbol):
                    break
            hit = rank == np.repeat(least, size)
            # of touching hits take every other one, from the left
            at = np.flatnonzero(hit)
            run = np.concatenate([[True], (np.diff(at) > 1) | (word[at[1:]] != word[at[:-1]])])
            start = np.flatnonzero(run)
            at = at[(np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))) % 2 == 0]
            leads = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]
            trial = self._apply(word, symbol, rank, at)
            early = np.unique(trial[0][trial[2] < np.repeat(*self._spread(trial[0], least, word))])
            if len(early):
                at = np.sort(np.concatenate([at[~np.isin(word[at], early)], leads[np.isin(word[leads], early)]]))
                trial = self._apply(word, symbol, rank, at)
            word, symbol, rank = trial
        order_word = np.concatenate([*done_word, np.zeros(0, np.int64)])
        order = np.argsort(order_word, kind="stable")
        flat = np.concatenate([*done_symbol, np.zeros(0, np.int64)])[order].tolist()
        ends = np.cumsum(np.bincount(order_word.astype(np.int64), minlength=len(words))).tolist()
        out, low = [], 0
        for high in ends:
            part = flat[low:high]
            if part and min(part) < 0:
                part = [i for s in part for i in ([s] if s >= 0 else self.bytes[list(chr(-1 - s).encode("utf-8", "surrogatepass"))].tolist())]
            out.append(part)
            low = high
        return out

    @staticmethod
    def _spread(after: np.ndarray, least: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names = before[np.concatenate([[True], before[1:] != before[:-1]])]
        sizes = np.bincount(np.searchsorted(names, after), minlength=len(names))
        return least, sizes

    def _apply(self, word: np.ndarray, symbol: np.ndarray, rank: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge the pairs that begin at ``at`` and compact; only pairs beside a merge are ranked anew."""
        symbol, rank = symbol.copy(), rank.copy()
        keep = np.ones(len(word), bool)
        symbol[at] = self.made[rank[at]]
        keep[at + 1] = False
        fresh = np.zeros(len(word), bool)
        fresh[at] = True
        word, symbol, rank, fresh = word[keep], symbol[keep], rank[keep], fresh[keep]
        new = np.flatnonzero(fresh)
        new = np.unique(np.concatenate([new, new[new > 0] - 1]))
        last = new[new == len(word) - 1]
        rank[last] = NONE
        new = new[new < len(word) - 1]
        rank[new] = np.where(word[new] == word[new + 1], self.rank_of(symbol[new], symbol[new + 1]), NONE)
        return word, symbol, rank

    def split(self, text: str) -> list[str]:
        return self.words.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for w in self.merge(self.split(text)) for i in w]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the pieces' bytes with the blank in front dropped; bytes that are no UTF-8 become U+FFFD."""
        surface = self.surface
        data = b"".join([surface[i] for i in ids])
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def load(path: str) -> Pieces:
    return once(("pieces", path), lambda: Pieces(path))


def encoded(column: pa.Array, model: Pieces, cache: dict[str, tuple[int, ...]]) -> Iterator[tuple[list[list[tuple[int, ...]]], int]]:
    """The words' ids of each text, block by block; new words of a block are merged together."""
    texts = column.to_pylist()
    low = 0
    while low < len(texts):
        high, size, parts, fresh = low, 0, [], {}
        while high < len(texts) and size < BLOCK:
            words = model.split(texts[high] or "")
            for w in words:
                if w not in cache:
                    fresh[w] = None
            parts.append(words)
            size += len(texts[high] or "")
            high += 1
        names = list(fresh)
        known = cache if len(cache) + len(names) <= CACHE else {**{w: cache[w] for p in parts for w in p if w in cache}}
        if known is not cache:
            cache.clear()
            cache.update(known)
        cache.update(zip(names, map(tuple, model.merge(names))))
        yield [[cache[w] for w in p] for p in parts], low
        low = high


def encode(docs: DataFrame, path: str, text: str = "text", out: tuple[str, str] = ("ids", "decoded")) -> DataFrame:
    """``docs`` with the ids of each text and the text that the ids decode to; columns of these names are replaced."""
    kept = [f.name for f in docs.schema if f.name not in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = load(path), {}
        for batch in batches:
            for parts, low in encoded(batch.column(text), model, cache):
                ids = [[i for w in words for i in w] for words in parts]
                part = batch.slice(low, len(parts))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), pa.array(ids, pa.list_(pa.int32())), pa.array([model.decode(i) for i in ids], pa.string())], [*kept, *out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), f"`{out[0]}` array<int>, `{out[1]}` string"])
    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): the digests of ``encode``'s columns, made where they arise."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = load(path), {}
        number = [b"%d," % i for i in range(len(model.surface))]
        for batch in batches:
            for parts, low in encoded(batch.column(text), model, cache):
                n, ids, back = [], [], []
                for words in parts:
                    flat = [i for w in words for i in w]
                    n.append(len(flat))
                    ids.append(hashlib.sha256(b"".join([number[i] for i in flat])[:-1]).hexdigest())
                    back.append(hashlib.sha256(model.decode(flat).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(low, len(parts)), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: each document's ids beside its columns."""
    names = ("ids", f"_decoded_of_{len(docs.columns)}")
    return encode(docs, vocabulary(), out=names).drop(names[1])

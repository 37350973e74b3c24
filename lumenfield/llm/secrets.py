"""Secret scans: fixed patterns, and formats learned by grammar inference.

Three patterns give the base spans. The values they hold are labelled credentials: of each
kind, at most ``FIT_VALUES`` distinct values of up to ``FIT_LENGTH`` signs (those of smallest
hash) form a prefix tree, whose states are merged where their outgoing frequencies agree
within a Hoeffding bound (red and blue states), which leaves a probabilistic automaton per
kind. What base spans leave of the runs of key signs is a candidate if it holds ``LEAST``
signs, a digit and a letter. In it, every stretch with a digit and a letter that begins and
ends beside a separator (or the candidate's end) is read; it is a secret if some automaton
gives it a likelihood per sign no lower than that of the least likely value it was learned
from, less ``MARGIN`` bits, and it has ``RUN`` signs or as many as the shortest of those
values. From left to right, the longest such stretch of each begin is taken.

Null texts count as empty. Texts without hits have zero counts, empty strings for spans and
the digest of the empty string. Without labelled values there are no learned spans.
Overlapping base spans of different kinds all stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfield.session import cut
from lumenfield.llm.texts import SLICE

KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
RUN, HEX_RUN, LEAST = 16, 24, 6
FIT_VALUES = 150
FIT_LENGTH = 64
ALPHA = 0.05
MARGIN = 0.25

SIGN = np.zeros(256, np.uint8)
SIGN[[ord(c) for c in "0123456789abcdef"]] |= 1
SIGN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"]] |= 2
SIGN[[ord(c) for c in "0123456789"]] |= 4
SIGN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] |= 8
#: sizes of the sign classes an automaton reads; any other sign is a class of its own
SIZES = {"d": 10, "h": 6, "l": 20, "H": 6, "U": 20}

Span = tuple[str, int, int, str]


def runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of at least ``least`` set places."""
    step = np.diff(np.concatenate([[0], (mask != 0).astype(np.int8), [0]]))
    low, high = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = high - low >= least
    return low[long], high[long]


def mixed(value: str) -> bool:
    return bool(re.search("[0-9]", value) and re.search("[A-Za-z]", value))


def rest(span: Span, base: list[Span]) -> list[Span]:
    """What ``base`` spans, sorted by begin, leave of a span."""
    kind, low, high, value = span
    out, at = [], low
    for _, a, b, _ in [*base, ("", high, high, "")]:
        if at < min(a, high):
            out.append((kind, at, min(a, high), value[at - low : min(a, high) - low]))
        at = max(at, b)
    return out


def scan(texts: list[str | None]) -> Iterator[tuple[int, list[Span], list[Span]]]:
    """(row, base spans, candidates) of the rows that have any; positions in code points."""
    low = 0
    while low < len(texts):
        parts, size, high = [], 0, low
        while high < len(texts) and size < SLICE:
            parts.append((texts[high] or "").encode("utf-8", "surrogatepass"))
            size += len(parts[-1])
            high += 1
        blob = b"\n".join(parts)
        begins = np.cumsum([0, *(len(p) + 1 for p in parts)])[:-1]
        sign = SIGN[np.frombuffer(blob, np.uint8)]
        found = {}

        def add(kind: str, a: int, b: int) -> None:
            row = int(np.searchsorted(begins, a, "right")) - 1
            found.setdefault(row, []).append((kind, a - int(begins[row]), b - int(begins[row])))

        for a, b in zip(*(x.tolist() for x in runs(sign & 1, HEX_RUN))):
            add("hex", a, b)
        a, b = runs(sign & 2, LEAST)
        for bit in (4, 8):
            places = np.flatnonzero(sign & bit)
            some = np.searchsorted(places, a) < np.searchsorted(places, b)
            a, b = a[some], b[some]
        for a, b in zip(a.tolist(), b.tolist()):
            add("learned", a, b)
        for m in re.finditer(rb"AKIA[A-Z0-9]+", blob) if b"AKIA" in blob else ():
            if m.end() - m.start() >= 20:
                add("access", m.start(), m.end())
        lower = blob.lower()
        for word in WORDS:
            at = lower.find(word)
            while at >= 0:
                row = int(np.searchsorted(begins, at, "right")) - 1
                found.setdefault(row, [])
                at = lower.find(word, int(begins[row]) + len(parts[row]))
        for row, spans in sorted(found.items()):
            part, text = parts[row], texts[low + row] or ""
            same = len(part) == len(text)
            base: list[Span] = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
            more: list[Span] = []
            for kind, a, b in spans:
                a0 = a if same else len(part[:a].decode("utf-8", "surrogatepass"))
                value = part[a:b].decode()
                (more if kind == "learned" else base).append((kind, a0, a0 + b - a, value))
            base.sort(key=lambda s: (s[1], KINDS.index(s[0])))
            free = [s for run in more for s in rest(run, base) if len(s[3]) >= LEAST and mixed(s[3])]
            if base or free:
                yield low + row, base, free
        low = high


def classes(value: str) -> list[str]:
    return ["d" if c in "0123456789" else "h" if c in "abcdef" else "H" if c in "ABCDEF" else "l" if "a" <= c <= "z" else "U" if "A" <= c <= "Z" else c for c in value]


class Automaton:
    """A probabilistic automaton over sign classes, merged from the prefix tree of ``values``."""

    def __init__(self, values: list[str], alpha: float = ALPHA) -> None:
        self.go: list[dict[str, int]] = [{}]
        self.n: list[dict[str, int]] = [{}]
        self.stop = [0]
        for value in values:
            state = 0
            for c in classes(value):
                if c not in self.go[state]:
                    self.go[state][c] = len(self.go)
                    self.go.append({})
                    self.n.append({})
                    self.stop.append(0)
                self.n[state][c] = self.n[state].get(c, 0) + 1
                state = self.go[state][c]
            self.stop[state] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        red = [0]
        while True:
            blue = sorted((to, s, c) for s in red for c, to in self.go[s].items() if to not in red)
            if not blue:
                break
            state, parent, sign = blue[0]
            target = next((r for r in red if self._alike(r, state)), None)
            if target is None:
                red.append(state)
            else:
                self.go[parent][sign] = target
                self._fold(target, state)
        self.shortest = min(RUN, *map(len, values)) if values else RUN
        self.least = min((self.score(v) for v in values), default=math.inf)

    def _total(self, s: int) -> int:
        return self.stop[s] + sum(self.n[s].values())

    def _alike(self, a: int, b: int) -> bool:
        """Hoeffding test of all outgoing and ending frequencies, down the tree below ``b``."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            m, n = self._total(x), self._total(y)
            if not m or not n:
                continue
            gap = self.bound * (1 / math.sqrt(m) + 1 / math.sqrt(n))
            if abs(self.stop[x] / m - self.stop[y] / n) > gap:
                return False
            for c in {*self.n[x], *self.n[y]}:
                if abs(self.n[x].get(c, 0) / m - self.n[y].get(c, 0) / n) > gap:
                    return False
                if c in self.go[x] and c in self.go[y]:
                    todo.append((self.go[x][c], self.go[y][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the subtree below ``b`` to the states it now shares with ``a``."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            self.stop[x] += self.stop[y]
            for c, n in self.n[y].items():
                self.n[x][c] = self.n[x].get(c, 0) + n
            for c, to in self.go[y].items():
                if c in self.go[x]:
                    todo.append((self.go[x][c], to))
                else:
                    self.go[x][c] = to

    def score(self, value: str) -> float:
        """Log2 likelihood per sign, its end included; minus infinity for a sign no state has seen."""
        state, total = 0, 0.0
        for c in classes(value):
            n = self.n[state].get(c, 0)
            if not n:
                return -math.inf
            total += math.log2(n / self._total(state)) - math.log2(SIZES.get(c, 1))
            state = self.go[state][c]
        if not self.stop[state]:
            return -math.inf
        return (total + math.log2(self.stop[state] / self._total(state))) / max(len(value), 1)

    def accepts(self, value: str, margin: float = MARGIN) -> bool:
        return self.score(value) >= self.least - margin


    def reach(self, value: str, begin: int, ends: list[bool], margin: float = MARGIN) -> int:
        """The last of ``ends`` up to which a stretch from ``begin`` is accepted; ``begin`` if there is none."""
        state, total, best, digit, letter = 0, 0.0, begin, False, False
        for at, c in enumerate(classes(value[begin:]), begin + 1):
            n = self.n[state].get(c, 0)
            if not n:
                break
            total += math.log2(n / self._total(state)) - math.log2(SIZES.get(c, 1))
            state = self.go[state][c]
            digit, letter = digit or c == "d", letter or c in ("h", "l", "H", "U")
            size = at - begin
            if ends[at] and digit and letter and size >= self.shortest and self.stop[state]:
                if (total + math.log2(self.stop[state] / self._total(state))) / size >= self.least - margin:
                    best = at
        return best


def stretches(free: list[Span], models: list[Automaton]) -> list[Span]:
    """The secrets in some candidates, from left to right, the longest of each begin."""
    out: list[Span] = []
    for kind, start, _, value in free:
        word = [c.isalnum() for c in value]
        edge = [True, *(not (a and b) for a, b in zip(word, word[1:])), True]
        at = 0
        while at < len(value):
            to = max((m.reach(value, at, edge) for m in models), default=at) if edge[at] else at
            if to > at:
                out.append((kind, start + at, start + to, value[at:to]))
            at = max(to, at + 1)
    return out


SPANS = "array<struct<kind:string,start:long,end:long,value:string>>"


def hits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, free): base spans and candidates of every document."""
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            free: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for row, b, f in scan(batch.column(text).to_pylist()):
                base[row], free[row] = ([dict(zip(("kind", "start", "end", "value"), s)) for s in x] for x in (b, f))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(base, struct), pa.array(free, struct)], [key, "base", "free"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, base {SPANS}, free {SPANS}")


def learn(found: DataFrame, fit_values: int = FIT_VALUES, fit_length: int = FIT_LENGTH) -> list[Automaton]:
    """An automaton for each kind of base span that has values."""
    values = found.select(F.inline("base")).filter(F.length("value") <= fit_length).select("kind", "value").distinct()
    models = []
    for kind in KINDS[:3]:
        rows = values.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(fit_values).collect()
        if rows:
            models.append(Automaton([r["value"] for r in rows]))
    return models


def judged(found: DataFrame, models: list[Automaton]) -> DataFrame:
    """``found`` with ``learned``, the stretches of the candidates that some automaton accepts."""
    accept = F.udf(lambda free: stretches(free, models), SPANS)
    return found.withColumn("learned", F.when(F.size("free") > 0, accept("free")).otherwise(F.expr("slice(free, 1, 0)")))


def listed(spans):
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    rank = lambda s: F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), s["kind"])
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(hits(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    out = judged(found, learn(found))
    return out.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "learned")).alias("spans"))


def redact(docs: DataFrame, models: list[Automaton], text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with every secret replaced by ``[secret]``, and ``length``, if there, set to the new length; rows without secrets are unchanged."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            changed = {}
            for row, base, free in scan(texts):
                spans = sorted((a, b) for _, a, b, v in [*base, *stretches(free, models)])
                out, at = [], 0
                for a, b in spans:
                    if a >= at:
                        out += [texts[row][at:a], "[secret]"]
                    at = max(at, b)
                if spans:
                    changed[row] = "".join([*out, texts[row][at:]])
            if changed:
                columns = {n: batch.column(n) for n in names}
                columns[text] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], pa.string())
                if length in columns and pa.types.is_integer(columns[length].type):
                    columns[length] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(columns[length].to_pylist())], columns[length].type)
                batch = pa.RecordBatch.from_arrays([columns[n] for n in names], names)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets are cut out of the texts; every document stays."""
    return redact(docs, learn(cut(hits(docs))))

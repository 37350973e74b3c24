"""Similarity join on word n-grams by signature trees.

Every document is the set of its distinct n-word shingles. Equal sets are one class from
the start. Documents that can reach the threshold share one of the first few shingles of
their sets in a common order, rarest kinds first (shingle counts in ``CELLS`` hashed cells,
over all documents); the classes that share such a shingle form a group. A pair's first
common shingle bounds its overlap by what follows in both sets, so a class stays in a group
only with another one whose size this allows. Inside a group
a signature tree holds, per node, the OR of its members' bitmaps and the range of their
sizes; two trees are walked together and a pair of nodes is left once the largest overlap
that their bitmaps and sizes allow is too small; the pairs of members are tried once more by bitmaps of their own
width. What remains is verified exactly on the sets.

To lose no link and still not write out all pairs of a large group, each group first tries
its least member against the others; only members of different components go through the
trees, where as few pairs as would connect them are verified. What is still apart goes through
the trees with its sets: a cell verifies its own pairs and writes no more links than connect its
members, so that a group gives rows in proportion to its size and not to its pairs. A group
larger than ``CELL``, or of more than ``PIECE`` shingles, is dealt into pairs of cells, so none
is ever one task.

Null texts, and texts without words, are empty sets: they link with nothing, and each is
its own component. Repeated ids share the component of the least class they are in. Sets
are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfield.llm.texts import groups, mix, shingle_sets, word_slices
from lumenfield.operators.components import connected_roots
from lumenfield.session import cut

SHINGLE = 4
THRESHOLD = 85
CELLS = 1 << 22
BLOCK = 1 << 16
CELL = 2048
PIECE = 1 << 21
LEAF = 8
CARRY = 1 << 20
NEEDED = 1 << 23
FINE = 24
HELD = 1 << 21
U64 = np.uint64


def signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, U64).view(np.int64)


def digest(part: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(signed(mix(np.array([mix(part).sum(dtype=U64) + U64(len(part))], U64)))[0])


def cell_of(part: np.ndarray) -> np.ndarray:
    return (part >> U64(65 - CELLS.bit_length())).astype(np.int64)


def bitmap(part: np.ndarray, places: int = 4) -> bytes:
    """One bit per member, in a power of two of at least so many places a member and 64."""
    width = 1 << max(6, (places * len(part) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(part >> U64(20)) & U64(width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def least_overlap(a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    """Members that sets of these sizes must share."""
    return -(-threshold * (a + b) // (100 + threshold))


def sets_of(docs: DataFrame, key: str, text: str, k: int) -> tuple[DataFrame, np.ndarray]:
    """(key, n, name, bits) of every row, and the class of each hashed cell: 0 for usual counts, more for frequent ones.

    A task gives its counts as one row a block of ``BLOCK`` cells; the blocks are summed in tasks
    and only a byte a cell comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)
        names = [key, "n", "name", "bits", "block", "counts"]
        kind = None
        for batch in batches:
            kind = batch.schema.field(key).type
            for low, high, w in word_slices(batch, text):
                sets = shingle_sets(w, k)
                np.add.at(cells, cell_of(np.concatenate(sets)), 1)
                m = high - low
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(low, m), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.int64()), pa.array([bitmap(s) if len(s) else b"" for s in sets], pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        blocks = [(i, c.astype(np.min_scalar_type(c.max())).tobytes()) for i, c in enumerate(cells.reshape(-1, BLOCK)) if c.any()]
        if kind is not None and blocks:
            m = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, kind), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array([i for i, _ in blocks], pa.int32()), pa.array([zlib.compress(c, 1) for _, c in blocks], pa.binary())], names)

    seen = cut(docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n long, name long, bits binary, block int, counts binary"))
    mean = max((seen.agg(F.sum("n")).first()[0] or 0) / CELLS, 1.0)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.zeros(BLOCK)

        def done() -> pa.RecordBatch:
            level = np.floor(np.log2(np.maximum(total / mean, 1.0))).astype(np.uint8)
            return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "level": pa.array([level.tobytes()], pa.binary())})

        for batch in batches:
            for at, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                if at != block:
                    if block is not None:
                        yield done()
                    block, total = at, np.zeros(BLOCK)
                counts = zlib.decompress(counts)
                total += np.frombuffer(counts, f"u{len(counts) // BLOCK}")
        if block is not None:
            yield done()

    level = np.zeros((CELLS // BLOCK, BLOCK), np.uint8)
    rows = seen.filter("block is not null").select("block", "counts").repartition("block").sortWithinPartitions("block").mapInArrow(summed, "block int, level binary").collect()
    for row in rows:
        level[row.block] = np.frombuffer(row.level, np.uint8)
    return seen.filter("block is null").select(key, "n", "name", "bits"), level.ravel()


def with_partner(token: np.ndarray, name: np.ndarray, n: np.ndarray, most: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The (token, name) that have another one of the same token whose size lies between ``threshold`` percent of ``n`` and ``most``."""
    group = np.cumsum(np.concatenate([[0], (token[1:] != token[:-1]).astype(np.int64)]))
    order = np.lexsort((n, group))
    at = group[order] << 32
    n, most = n[order], most[order]
    while len(order):
        sizes = at | n
        found = np.searchsorted(sizes, at | most, "right") - np.searchsorted(sizes, at | (threshold * n + 99) // 100) - (n <= most)
        keep = found > 0
        if keep.all():
            break
        order, at, n, most = order[keep], at[keep], n[keep], most[keep]
    order = np.sort(order)
    return token[order], name[order]


def members(docs: DataFrame, level: np.ndarray, text: str, k: int, threshold: int) -> DataFrame:
    """(group, name): classes that share a shingle among the first of their sets, groups of equal members once per task."""

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for _, _, w in word_slices(batch, text):
                tokens, owner, spans = [], [], []
                for part in shingle_sets(w, k):
                    if len(part) and (name := digest(part)) not in done:
                        done.add(name)
                        order = level[cell_of(part)].astype(U64) << U64(58) | part >> U64(6)
                        m = len(part) - (threshold * len(part) + 99) // 100 + 1
                        token = np.sort(np.partition(order, m - 1)[:m])
                        after = len(part) - np.searchsorted(token, token)
                        tokens.append(token)
                        owner.append(np.full(m, name, np.int64))
                        spans.append(len(part) << 32 | after * (100 + threshold) // threshold - len(part))
                if len(done) > 1_000_000:
                    done.clear()
                if tokens:
                    yield pa.RecordBatch.from_pydict({"token": signed(np.concatenate(tokens)), "name": np.concatenate(owner), "span": np.concatenate(spans)})

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_t = rest_n = rest_s = np.zeros(0, np.int64)
        open_token: int | None = None
        done: set[int] = set()

        def closed(token: np.ndarray, name: np.ndarray, span: np.ndarray) -> pa.RecordBatch | None:
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (name[1:] != name[:-1])
            token, name, span = token[new], name[new], span[new]
            token, name = with_partner(token, name, span >> 32, span & 0xFFFFFFFF, threshold)
            if not len(token):
                return None
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.append(first, len(token)))
            if not (size > 1).any():
                return None
            label = signed(mix(np.add.reduceat(mix(name.view(U64)), first) + size.astype(U64)))
            fresh = np.array([s > 1 and g not in done for s, g in zip(size.tolist(), label.tolist())])
            _, earliest = np.unique(label, return_index=True)
            only = np.zeros(len(label), bool)
            only[earliest] = True
            fresh &= only
            done.update(label[fresh].tolist())
            if len(done) > 1_000_000:
                done.clear()
            pick = np.repeat(fresh, size)
            return pa.RecordBatch.from_pydict({"group": np.repeat(label, size)[pick], "name": name[pick]}) if pick.any() else None

        for batch in batches:
            token, name, span = (np.asarray(batch.column(c)) for c in ("token", "name", "span"))
            if open_token is not None:
                mine = token == open_token
                if mine.any():
                    yield pa.RecordBatch.from_pydict({"group": np.full(int(mine.sum()), open_token), "name": name[mine]})
                token, name, span = token[~mine], name[~mine], span[~mine]
                if not len(token):
                    continue
                open_token = None
            token, name, span = np.concatenate([rest_t, token]), np.concatenate([rest_n, name]), np.concatenate([rest_s, span])
            if not len(token):
                continue
            last = int(np.searchsorted(token, token[-1]))
            if last and (out := closed(token[:last], name[:last], span[:last])) is not None:
                yield out
            rest_t, rest_n, rest_s = token[last:], name[last:], span[last:]
            if len(rest_t) > CARRY:  # a group too large to hold goes on row by row under its token
                open_token = int(rest_t[-1])
                yield pa.RecordBatch.from_pydict({"group": rest_t, "name": rest_n})
                rest_t = rest_n = rest_s = rest_t[:0]
        if len(rest_t) and (out := closed(rest_t, rest_n, rest_s)) is not None:
            yield out

    first = docs.select(text).mapInArrow(firsts, "token long, name long, span long")
    dealt = first.repartition("token").sortWithinPartitions("token", "name")
    return cut(dealt.mapInArrow(together, "group long, name long").distinct())


def possible(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose bitmaps and sizes leave room for a link."""
    left = classes.select(F.col("name").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    right = classes.select(F.col("name").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b"))):
                width = min(len(x), len(y)) // 8
                x, y = folded(x, width), folded(y, width)
                both = int(np.bitwise_count(x & y).sum())
                most = min(both + n - int(np.bitwise_count(x).sum()), both + m - int(np.bitwise_count(y).sum()))
                ok.append(most >= least_overlap(n, m, threshold))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    near = pairs.join(left, "a").join(right, "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * threshold)
    return near.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def place(key: str) -> Column:
    """One of ``NEEDED`` hashed places for the rows of a key."""
    return F.pmod(F.xxhash64(key), F.lit(NEEDED)).cast("int")


def sets_for(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, k: int, fine: bool = False) -> DataFrame:
    """(name, n, items): the sets of the classes in ``pairs``, from the texts; or (name, n, bits) with bitmaps of ``FINE`` places a member.

    Of each class one text is read, and those whose keys share its hashed place; joins drop what
    is there by chance.
    """
    payload = "bits" if fine else "items"
    names = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    places = names.join(classes.select("name", "at"), "name").select("at").distinct().toArrow()
    needed = np.zeros(NEEDED, bool)
    needed[places.column("at").to_numpy()] = True
    needed = np.packbits(needed)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, done = np.unpackbits(needed).view(bool), set()
        for batch in batches:
            batch = batch.filter(pa.array(wanted[batch.column("_at").to_numpy()]))
            for _, _, w in word_slices(batch, text):
                names, sizes, items = [], [], []
                for part in shingle_sets(w, k):
                    if len(part) and (name := digest(part)) not in done:
                        done.add(name)
                        names.append(name)
                        sizes.append(len(part))
                        items.append(bitmap(part, FINE) if fine else part.tobytes())
                if len(done) > 1_000_000:
                    done.clear()
                if names:
                    yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.int64()), "n": pa.array(sizes, pa.int64()), payload: pa.array(items, pa.binary())})

    some = docs.filter(F.col(text).isNotNull()).select(F.col(text), place(key).alias("_at"))
    return some.mapInArrow(take, f"name long, n long, {payload} binary").groupBy("name").agg(F.first("n").alias("n"), F.first(payload).alias(payload))


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= threshold * (len(a) + len(b) - shared)


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The (a, b) of ``pairs`` that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(*(np.frombuffer(v.as_buffer(), U64) for v in two), threshold) for two in zip(batch.column("items_a"), batch.column("items_b"))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    sets = sets.select("name", "items")
    near = pairs.join(sets.withColumnsRenamed({"name": "b", "items": "items_b"}), "b").join(sets.withColumnsRenamed({"name": "a", "items": "items_a"}), "a")
    return near.select("a", "b", "items_a", "items_b").mapInArrow(run, "a long, b long")


def folded(bits: bytes | pa.Buffer, width: int) -> np.ndarray:
    x = np.frombuffer(bits, U64)
    return np.bitwise_or.reduce(x.reshape(-1, width), axis=0)


def walk(n: np.ndarray, root: np.ndarray, bits: np.ndarray, side: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of different roots that may link, by dual traversal of the members' signature tree.

    With two sides only pairs across them are wanted. ``bits`` are 64-bit words, a row each.
    """
    order = np.lexsort((n, side))
    n, root, bits, side = n[order], root[order], bits[order], side[order]
    slack = n - np.bitwise_count(bits).sum(axis=1)
    levels = [(bits, n, n, slack)]
    while len(levels[-1][0]) > 1:
        b, low, high, s = levels[-1]
        first = np.arange(0, len(b), LEAF)
        levels.append((np.bitwise_or.reduceat(b, first, axis=0), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.maximum.reduceat(s, first)))
    i = j = np.zeros(1, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        b, low, high, s = levels[depth]
        keep = np.zeros(len(i), bool)
        step = max((HELD >> 2) // b.shape[1], 1)
        for at in range(0, len(i), step):
            x, y = i[at : at + step], j[at : at + step]
            most = np.bitwise_count(b[x] & b[y]).sum(axis=1) + np.minimum(s[x], s[y])
            most = np.minimum(most, np.minimum(high[x], high[y]))
            keep[at : at + step] = (most >= least_overlap(low[x], low[y], threshold)) & (100 * high[x] >= threshold * low[y]) & (100 * high[y] >= threshold * low[x])
        i, j = i[keep], j[keep]
        if depth:
            size = len(levels[depth - 1][0])
            grid = np.arange(LEAF)
            x = (i[:, None, None] * LEAF + grid[None, :, None] + 0 * grid).ravel()
            y = (j[:, None, None] * LEAF + 0 * grid[None, :, None] + grid).ravel()
            some = (x < size) & (y < size) & (x <= y)
            i, j = x[some], y[some]
    some = (i < j) & (root[i] != root[j]) & ((side[i] != side[j]) | (side.min(initial=0) == side.max(initial=0)))
    return order[i[some]], order[j[some]]


def close(a: np.ndarray, b: np.ndarray, n: np.ndarray, bits: list[bytes] | list[pa.Buffer], threshold: int) -> np.ndarray:
    """Which index pairs of a cell may link by their own bitmaps, each pair in the width of its narrower one.

    The tree has all members in the width of the narrowest, where the bitmaps of larger sets are all but full.
    Only the bitmaps of a slice of the pairs are unfolded at a time.
    """
    words = np.array([len(x) // 8 for x in bits])
    width = np.minimum(words[a], words[b])
    keep = np.zeros(len(a), bool)
    for w in np.unique(width).tolist():
        these = np.flatnonzero(width == w)
        step = max((HELD >> 2) // w, 1)
        for low in range(0, len(these), step):
            now = these[low : low + step]
            some, at = np.unique(np.concatenate([a[now], b[now]]), return_inverse=True)
            flat = np.stack([folded(bits[i], w) for i in some.tolist()])
            slack = n[some] - np.bitwise_count(flat).sum(axis=1)
            i, j = at[: len(now)], at[len(now) :]
            most = np.bitwise_count(flat[i] & flat[j]).sum(axis=1) + np.minimum(slack[i], slack[j])
            keep[now] = most >= least_overlap(n[some[i]], n[some[j]], threshold)
    return keep


def joined(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs that connect the roots just as all the pairs do, by rounds of one pair per component; and the members' roots then."""
    _, label = np.unique(root, return_inverse=True)
    at, chosen = np.arange(len(a)), []
    while True:
        x, y = label[a[at]], label[b[at]]
        at, x, y = at[x != y], x[x != y], y[x != y]
        if not len(at):
            return np.concatenate([*chosen, np.zeros(0, np.int64)]).astype(np.int64), label
        high, first = np.unique(np.maximum(x, y), return_index=True)
        chosen.append(at[first])
        up = np.arange(int(label.max()) + 1)
        up[high] = np.minimum(x, y)[first]
        while (jumped := up[up]).tobytes() != up.tobytes():
            up = jumped
        label = up[label]


def forest(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    return joined(a, b, root)[0]


def kept_links(a: np.ndarray, b: np.ndarray, root: np.ndarray, sets: list[np.ndarray], threshold: int) -> np.ndarray:
    """Indices of index pairs that link and connect the roots just as all linking pairs do.

    As few pairs as would connect the roots are verified first, then all that are still apart.
    """
    rest, found, label = np.arange(len(a)), [], root
    for last in (False, True):
        some = rest if last else forest(a, b, label)
        ok = np.array([linked(sets[x], sets[y], threshold) for x, y in zip(a[some].tolist(), b[some].tolist())], bool)
        few, label = joined(a[some[ok]], b[some[ok]], label)
        found.append(some[ok][few])
        rest = np.flatnonzero(label[a] != label[b])
    return np.concatenate(found)


def in_cells(rows: DataFrame, classes: DataFrame, payload: str, threshold: int, find: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[pa.Buffer]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Pairs (a, b) that ``find`` makes of the cells (name, n, root, side, payload) of the groups of ``rows(group, name, n, root)``.

    A group of at most ``CELL`` members and ``PIECE`` shingles is one cell. In a larger one sizes fall
    into bands such that linking sets are in one band or in neighbouring ones; a member goes into the
    cell of its band and of the next. A cell that is still larger
    is dealt into parts, and each pair of parts is a cell of its own.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / threshold)).cast("long")
    large = rows.groupBy("group").agg(((F.count("*") > CELL) | (F.sum("n") > PIECE)).alias("_large"))
    cells = rows.join(large, "group").withColumn("cell", F.explode(F.when(F.col("_large"), F.array(band, band + 1)).otherwise(F.array(F.lit(0).cast("long"))))).drop("_large")
    size = cells.groupBy("group", "cell").agg(F.greatest(F.count("*") / CELL, F.sum("n") / PIECE).alias("c"), (F.min("root") != F.max("root")).alias("open")).filter("open")
    parts = F.ceil("c").cast("long")
    dealt = cells.join(size, ["group", "cell"]).withColumn("parts", parts).withColumn("part", F.pmod("name", F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("group", "cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).cast("int").alias("side"), "name", "n", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["group", "cell", "i", "j"]):
            n, name, root = (table.column(c).to_numpy() for c in ("n", "name", "root"))
            if table.num_rows < 2 or (root == root[0]).all():
                continue
            side = table.column("side").to_numpy().astype(np.int64)
            a, b = find(name, n, root, side, [x.as_buffer() for x in table.column(payload)])
            if len(a):
                yield pa.RecordBatch.from_pydict({"a": np.minimum(name[a], name[b]), "b": np.maximum(name[a], name[b])})

    keys = ["group", "cell", "i", "j"]
    return dealt.join(classes.select("name", payload), "name").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def possible_in_cell(n: np.ndarray, root: np.ndarray, side: np.ndarray, bits: list[bytes] | list[pa.Buffer], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a cell's different roots whose bitmaps and sizes leave room for a link."""
    width = min(map(len, bits)) // 8
    while width > 1 and width * len(bits) > HELD:
        width //= 2
    a, b = walk(n, root, np.stack([folded(x, width) for x in bits]), side, threshold)
    if max(map(len, bits)) // 8 > width:
        some = close(a, b, n, bits, threshold)
        a, b = a[some], b[some]
    return a, b


def tree_pairs(rows: DataFrame, classes: DataFrame, threshold: int, want: str) -> DataFrame:
    """Candidate pairs (a, b) of different roots inside the groups of ``rows(group, name, n, root)``, by ``classes(name, bits)``.

    ``want``: all, or of each cell as many as connect its members (``members``) or its roots (``roots``).
    """

    def find(name: np.ndarray, n: np.ndarray, root: np.ndarray, side: np.ndarray, bits: list[pa.Buffer]) -> tuple[np.ndarray, np.ndarray]:
        a, b = possible_in_cell(n, root, side, bits, threshold)
        if len(a) and want != "all":
            some = forest(a, b, root if want == "roots" else name)
            a, b = a[some], b[some]
        return a, b

    return in_cells(rows, classes, "bits", threshold, find)


def tree_links(rows: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) that connect the roots inside the groups of ``rows(group, name, n, root)`` just as all links do, by ``sets(name, items)``."""

    def find(name: np.ndarray, n: np.ndarray, root: np.ndarray, side: np.ndarray, items: list[pa.Buffer]) -> tuple[np.ndarray, np.ndarray]:
        sets = [np.frombuffer(x, U64) for x in items]
        a, b = possible_in_cell(n, root, side, [bitmap(x, FINE) for x in sets], threshold)
        some = kept_links(a, b, root, sets, threshold)
        return a[some], b[some]

    return in_cells(rows, sets, "items", threshold, find)


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(key, n_shingles, component_id): the least key reachable by links, for every row."""
    seen, level = sets_of(docs, key, text, k)
    inside = members(docs.filter(F.col(text).isNotNull()), level, text, k, threshold)
    classes = seen.filter("n > 0").join(inside.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min(place(key)).alias("at"))
    classes = cut(classes)
    centre = inside.groupBy("group").agg(F.min("name").alias("a"))
    # one link a class will do here, with the centre of most of its groups: what is left in several components goes through the trees
    stars = inside.join(centre, "group").filter("name <> a").groupBy(F.col("name").alias("b"), "a").agg(F.count("*").alias("c"))
    stars = cut(possible(stars.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", "b"), classes, threshold))
    links = cut(verified(stars, sets_for(stars, classes, docs, key, text, k), threshold))

    def rooted(found: DataFrame) -> DataFrame:
        return cut(connected_roots(found.select(F.lit(0).alias("_one"), "a", "b"), ["_one"]).select(F.col("node").alias("name"), "root"))

    def apart(inside: DataFrame, roots: DataFrame, sizes: DataFrame) -> DataFrame:
        rows = inside.join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
        mixed = rows.groupBy("group").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo <> _hi").select("group")
        return rows.join(mixed, "group").join(sizes.select("name", "n"), "name")

    roots = rooted(links)
    pairs = cut(tree_pairs(apart(inside, roots, classes), classes, threshold, "members"))
    if not pairs.isEmpty():
        # these pairs hold every class that any later link holds
        fine = cut(sets_for(pairs, classes, docs, key, text, k, fine=True))
        near = cut(possible(pairs, fine, threshold))
        links = links.unionByName(cut(verified(near, sets_for(near, classes, docs, key, text, k), threshold)))
        rows = cut(apart(inside.join(fine.select("name"), "name", "left_semi"), rooted(links), fine))
        if not rows.isEmpty():
            sets = sets_for(rows.select(F.col("name").alias("a"), F.col("name").alias("b")), classes, docs, key, text, k)
            links = links.unionByName(cut(tree_links(rows, sets, threshold)))
        roots = rooted(links)
    least = seen.filter("n > 0").groupBy("name").agg(F.min(key).alias("_least")).join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    ids = least.join(least.groupBy("root").agg(F.min("_least").alias("component_id")), "root").select("name", "component_id")
    out = seen.filter("n > 0").join(ids, "name").select(key, F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(seen.filter("n = 0").select(key, F.col("n").alias("n_shingles"), F.col(key).alias("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies (five words, 80 %), the document of least id stays; of equal ids, one row."""
    found = components(docs, k=5, threshold=80).filter(F.col("component_id") == F.col("doc_id")).select(F.col("doc_id").alias("_id")).distinct()
    kept = docs.join(found, F.col("doc_id") == F.col("_id")).drop("_id").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') words from documents
), g as (
  select distinct doc_id, case when len(words) < 4 then array_to_string(words, ' ') else array_to_string(words[i : i + 3], ' ') end s
  from (select doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) i from w where len(words) > 0)
), n as (select doc_id, count(*) n from g group by doc_id),
pairs as (
  select x.doc_id a, y.doc_id b, count(*) c from g x join g y on x.s = y.s and x.doc_id <> y.doc_id group by all
), links as (
  select a, b from pairs join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 85 * (p.n + q.n - c)
), reach(doc_id, r) as (
  select doc_id, doc_id from w union select reach.doc_id, links.b from reach join links on reach.r = links.a
)
select w.doc_id, coalesce(any_value(n.n), 0)::bigint n_shingles, min(r)::bigint component_id
from w join reach using (doc_id) left join n using (doc_id) group by w.doc_id
"""

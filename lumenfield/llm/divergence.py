"""Source divergence audit: how far the word use of each source lies from the others of its language.

Counting is a token-start pointer sort. In each slice of a shard the starts of all tokens
are pointers into the Arrow text buffer; a multikey quicksort (eight bytes a step, all open
segments of a round at once) brings equal tokens together, and the lengths of the equal
runs give each term's occurrences and documents per (language, source). The pointers enter
in the order of groups and documents and the sort is stable, so both are read off the
borders within a run. Spark adds the slices up.

Each language keeps the terms of at least ``MIN_DOCS`` of its documents (rows). A group
(language, source) gives each kept term p = 1 + floor(SCALE * (count + 1) / (N + V)); the
divergence of p from q is floor((p - q)^2 / q), all in whole numbers. ``pair`` rows compare
a group with the other sources of its language over all kept terms; ``term`` rows list the
kept terms that a group holds more of than its language does, to rank ``TOP``.

The kept terms of a language are dealt to blocks of about ``BLOCK`` terms by hash; a block
meets the sizes of its language's groups by cogrouping, sums its part of all pairs in one
matrix, and the parts are added. No pair of groups is emitted per term. A hot source or
language is spread over slices and blocks like any other.

Null text, language and source are read as ''. Documents without terms still count as
groups; a language without kept terms has ``pair`` rows of value 0. Repeated rows count as
documents of their own. Other columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfield.llm.spans import Spans, spans, strings
from lumenfield.llm.texts import cuts, flat
from lumenfield.session import work_path

MIN_DOCS = 3
SCALE = 10**9
TOP = 200
SLICE = 8 << 20
BLOCK = 8192
SMALL = 32
SOLID = np.ones(256, bool)
SOLID[:0x80] = False
SOLID[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MASKS = np.array([(0xFFFFFFFFFFFFFFFF << (64 - 8 * k)) & 0xFFFFFFFFFFFFFFFF for k in range(9)], np.uint64)


def pointer_sort(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the tokens by their bytes, positions where a run of equal tokens begins); stable.

    Tokens must not hold zero bytes. A round splits every open segment into what is less
    than, equal to and greater than its pivot at its depth; the equal part goes eight bytes
    deeper or, if the tokens end there, is a run. Once all open segments have at most
    ``SMALL`` tokens, a round sorts them by their next bytes directly.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))

    def keys(token: np.ndarray, depth: np.ndarray) -> np.ndarray:
        at = 8 * depth
        return eight[np.minimum(starts[token] + at, len(data))].astype(np.uint64) & MASKS[np.clip(sizes[token] - at, 0, 8)]

    n = len(starts)
    order, head = np.arange(n), np.zeros(n, bool)
    head[:1] = True
    # the open tokens, their places in the order, and the segments in them
    place = token = np.arange(n if n > 1 else 0)
    key = keys(token, np.zeros(len(token), np.int64))
    size, depth = np.array([len(token)]), np.zeros(1, np.int64)
    while len(token):
        low = np.cumsum(size) - size
        if size.max() <= SMALL:
            by = np.lexsort((key, np.repeat(low, size)))
            token, key = token[by], key[by]
            change = np.concatenate([[True], key[1:] != key[:-1]])
            change[low] = True
            depth = np.repeat(depth, size)[change] + 1
            low = np.flatnonzero(change)
            size = np.diff(np.append(low, len(token)))
            deeper = np.ones(len(size), bool)
        else:
            pivot = np.sort(np.stack([key[low], key[low + size // 2], key[low + size - 1]]), axis=0)[1]
            wide = np.repeat(pivot, size)
            parts = [key < wide, key == wide, key > wide]
            sums = [np.concatenate([[0], np.cumsum(part)]) for part in parts]
            counts = np.stack([s[low + size] - s[low] for s in sums], 1)
            begin = low[:, None] + np.cumsum(counts, 1) - counts
            target = np.empty(len(token), np.int64)
            for j, (part, s) in enumerate(zip(parts, sums)):
                target[part] = (s[:-1] + np.repeat(begin[:, j] - s[low], size))[part]
            source = np.empty_like(target)
            source[target] = np.arange(len(token))
            token, key = token[source], key[source]
            deeper = np.tile([False, True, False], len(low))
            depth = np.repeat(depth, 3) + deeper
            low, size = begin.ravel(), counts.ravel()
            depth, deeper, low, size = (x[size > 0] for x in (depth, deeper, low, size))
        order[place] = token
        head[place[low]] = True
        live = (size > 1) & ~(deeper & (key[low] & np.uint64(255) == 0))
        keep, fresh = np.repeat(live, size), np.repeat(deeper[live], size[live])
        token, key, place, size, depth = token[keep], key[keep], place[keep], size[live], depth[live]
        key[fresh] = keys(token[fresh], np.repeat(depth, size)[fresh])
    return order, np.flatnonzero(head)


def run_counts(s: Spans, group: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """(token that stands for the term, group, occurrences, documents) of each term and group.

    ``row`` and ``group`` are those of each token; tokens must come by group, then row.
    """
    order, runs = pointer_sort(s.data, s.starts, s.ends - s.starts)
    head = np.zeros(len(order), bool)
    head[runs] = True
    group, row = group[order], row[order]
    head[1:] |= group[1:] != group[:-1]
    fresh = head.copy()
    fresh[1:] |= row[1:] != row[:-1]
    at = np.flatnonzero(head)
    if not len(at):
        return order, group, at, at
    return order[at], group[at], np.diff(np.append(at, len(order))), np.add.reduceat(fresh.astype(np.int64), at)


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            pairs = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
            for low, high in cuts(offsets, SLICE):
                names = sorted(set(pairs[low:high]))
                code = {name: i for i, name in enumerate(names)}
                of = np.array([code[pair] for pair in pairs[low:high]])
                s = spans(data, offsets[low : high + 1], SOLID)
                by = np.argsort(of[s.row], kind="stable")
                s = Spans(s.data, s.starts[by], s.ends[by], s.row[by])
                token, group, n, rows = run_counts(s, of[s.row], s.row)
                pick = pa.array(group)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in names], pa.string()).take(pick),
                        pa.array([x[1] for x in names], pa.string()).take(pick),
                        strings(s.data, s.starts[token], s.ends[token] - s.starts[token]).cast(pa.string()),
                        pa.array(n, pa.int64()),
                        pa.array(rows, pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )

    parts = docs.select(*named(text, lang, source)).mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def named(text: str, lang: str, source: str) -> list[Column]:
    return [F.coalesce(F.col(old).cast("string"), F.lit("")).alias(new) for old, new in ((text, "text"), (lang, "lang"), (source, "source"))]


def kept(path: str, counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, n, sources): the kept terms, with their occurrences in all of the language and by source."""
    by_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("sources"))
    return stored(path, by_term.filter(F.col("docs") >= min_docs).drop("docs"))


def stored(path: str, df: DataFrame) -> DataFrame:
    """Write and read again: the lineage ends and Spark knows the size."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def whole(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * count / total) for count <= total, in three steps of 1,000 so that no product passes 64 bits."""
    value, rest = F.lit(0).cast("long"), count
    for _ in range(3):
        value, rest = value * 1000 + whole(rest * 1000, total), rest * 1000 % total
    return value + 1


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``share`` for arrays."""
    value, rest = np.zeros(np.broadcast(count, total).shape, np.int64), count
    for _ in range(3):
        value, rest = value * 1000 + rest * 1000 // total, rest * 1000 % total
    return value + 1


def pair_sums(terms: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, source, item, value): the divergences of all pairs of sources, summed over the kept terms.

    ``groups`` has (lang, source, n, terms) with the group's occurrences and the language's kept terms.
    """
    blocks = groups.groupBy("lang").agg(F.max(whole(F.col("terms") + block - 1, F.lit(block))).alias("_blocks"))
    dealt = terms.join(blocks, "lang").withColumn("_block", F.pmod(F.xxhash64("term"), F.col("_blocks"))).select("lang", "_block", "sources")
    sizes = groups.join(blocks, "lang").filter("terms > 0").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).select("lang", "_block", "source", "n", "terms")

    def add(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("source")
        names = right.column("source").to_pylist()
        total = right.column("n").to_numpy() + right.column("terms").to_numpy()
        index = {name: i for i, name in enumerate(names)}
        lists = left.column("sources").combine_chunks()
        starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
        flat_list = lists.flatten()
        where = np.array([index[x] for x in flat_list.field("source").to_pylist()], np.int64)
        count = flat_list.field("n").to_numpy()
        out = np.zeros((len(names), len(names)), np.int64)
        step = max(1, (1 << 20) // len(names))
        for a in range(0, left.num_rows, step):
            b = min(a + step, left.num_rows)
            dense = np.zeros((b - a, len(names)), np.int64)
            part = slice(starts[a], starts[b])
            dense[np.repeat(np.arange(b - a), np.diff(starts[a : b + 1])), where[part]] = count[part]
            p = shares(dense + 1, total[None, :])
            for i in range(len(names)):
                out[i] += ((p[:, i : i + 1] - p) ** 2 // p).sum(0)
        own, other = np.nonzero(~np.eye(len(names), dtype=bool))
        pick = pa.array(names, pa.string())
        return pa.table({"lang": pa.array([key[0].as_py()] * len(own), pa.string()), "source": pick.take(pa.array(own)), "item": pick.take(pa.array(other)), "value": pa.array(out[own, other], pa.int64())})

    parts = dealt.groupBy("lang", "_block").cogroup(sizes.groupBy("lang", "_block")).applyInArrow(add, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` and ``term`` rows of every group."""
    folder = work_path(docs.sparkSession, "divergence")
    terms = kept(f"{folder}/terms", term_counts(docs, text, lang, source), min_docs)
    each = terms.select("lang", "term", F.col("n").alias("lang_n"), F.inline("sources"))
    langs = terms.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("terms"))
    totals = each.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = docs.select(*named(text, lang, source)[1:]).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "terms", "lang_total"])
    groups = stored(f"{folder}/groups", groups)

    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    pairs = pairs.join(pair_sums(terms, groups, block), ["lang", "source", "item"], "left").fillna(0, ["value"])

    own, all_ = share(F.col("n") + 1, F.col("total") + F.col("terms")), share(F.col("lang_n") + 1, F.col("lang_total") + F.col("terms"))
    marked = each.join(groups.withColumnRenamed("n", "total"), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), own.alias("p"), all_.alias("q"))
    marked = marked.filter("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.withColumn("part", F.lit("pair")).withColumn("rank", place)
    marked = marked.withColumn("part", F.lit("term")).withColumn("rank", place).filter(F.col("rank") <= top)
    return pairs.select(*columns).unionByName(marked.select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
with d as (
  select row_number() over () id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') text,
    coalesce(lang, '') lang, coalesce(source, '') source
  from documents
), t as (
  select id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d
), c as (
  select lang, source, term, count(*) n, count(distinct id) docs from t group by all
), k as (
  select lang, term, sum(n)::hugeint n from c group by lang, term having sum(docs) >= {MIN_DOCS}
), l as (
  select lang, sum(n)::hugeint total, count(*) v from k group by lang
), g as (
  select lang, source, coalesce(sum(n), 0)::hugeint total, coalesce(any_value(v), 0) v
  from (select distinct lang, source from d) left join (select c.lang, c.source, c.n, l.v from c join k using (lang, term) join l using (lang)) using (lang, source)
  group by lang, source
), w as (
  select g.lang, g.source, coalesce(l.v, 0)::hugeint v, g.total from g left join l using (lang)
), p as (
  select w.lang, w.source, k.term, coalesce(c.n, 0) n, 1 + {SCALE}::hugeint * (coalesce(c.n, 0) + 1) // (w.total + w.v) p,
    1 + {SCALE}::hugeint * (k.n + 1) // (l.total + l.v) q
  from w join k using (lang) join l using (lang) left join c on c.lang = w.lang and c.source = w.source and c.term = k.term
), s as (
  select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), r as (
  select a.lang, a.source, 'pair' part, b.source item, coalesce(s.value, 0)::bigint value
  from w a join w b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all
  select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from p where n > 0 and p > q
)
select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::int rank
from r
qualify part = 'pair' or rank <= {TOP}
"""

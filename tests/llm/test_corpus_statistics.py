"""Source divergence, phrase mining and sharding against brute force, and on awkward tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield.llm import divergence, phrases, sharding
from lumenfield.session import cut, work_path
from tests.llm.test_operators import awkward, empty

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def table(spark):
    return awkward(spark)


@pytest.mark.parametrize("n", [0, 1, 2, 40, 6000])
def test_pointer_sort(n):
    rng = random.Random(n)
    # ties, shared prefixes around the eight-byte steps, and high bytes
    words = [rng.choice([b"the", b"aaaaaaaa", b"aaaaaaaab", b"aaaaaaaaaaaaaaaa", "ü執".encode(), bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 20)))]) for _ in range(n)]
    sizes = np.array([len(w) for w in words], np.int64)
    order, runs = divergence.pointer_sort(np.frombuffer(b".".join([*words, b""]), np.uint8), np.cumsum(sizes + 1) - sizes - 1, sizes)
    expected = sorted(range(n), key=lambda i: (words[i], i))
    assert order.tolist() == expected
    assert runs.tolist() == [i for i in range(n) if not i or words[expected[i]] != words[expected[i - 1]]]


def naive_audit(rows, top):
    docs = [(TERM.findall(lowered(r[1])), r[2] or "", r[3] or "") for r in rows]
    df, n, lang_n, groups = Counter(), Counter(), Counter(), defaultdict(set)
    for words, lang, source in docs:
        groups[lang].add(source)
        df.update((lang, w) for w in set(words))
        n.update((lang, source, w) for w in words)
        lang_n.update((lang, w) for w in words)
    out = []
    for lang, sources in groups.items():
        kept = [w for (at, w), c in df.items() if at == lang and c >= 3]
        share = lambda count, total: 1 + 10**9 * (count + 1) // (total + len(kept))
        p = {s: [share(n[lang, s, w], sum(n[lang, s, v] for v in kept)) for w in kept] for s in sources}
        q = [share(lang_n[lang, w], sum(lang_n[lang, v] for v in kept)) for w in kept]
        for s in sources:
            pairs = [(o, sum((a - b) ** 2 // b for a, b in zip(p[s], p[o]))) for o in sources if o != s]
            terms = [(w, (a - b) ** 2 // b) for w, a, b in zip(kept, p[s], q) if n[lang, s, w] and a > b]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 13, 5])
def test_divergence_equals_brute_force(table, block):
    docs, rows = table
    got = divergence.audit(docs, top=7, block=block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == naive_audit(rows, 7)


def test_divergence_of_awkward_tables(spark):
    assert divergence.audit(empty(spark)).count() == 0
    rows = [(1, None, "en", "a"), (2, "", "en", "b"), (3, "12 3!", "en", None), (4, "Word", "de", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("x") for c in ("term", "n", "part", "rank", "value", "item")})
    got = divergence.audit(docs).collect()
    assert {(r["lang"], r["part"], r["value"]) for r in got} == {("en", "pair", 0)} and len(got) == 6


def test_shares_are_exact_beyond_64_bit_products(spark):
    counts = [1, 3, 10**12 + 7, 8 * 10**15]
    totals = [3, 7 * 10**14, 10**13 + 1, 9 * 10**15]
    want = [1 + 10**9 * c // t for c, t in zip(counts, totals)]
    assert divergence.shares(np.array(counts), np.array(totals)).tolist() == want
    got = spark.createDataFrame(list(zip(counts, totals)), "c long, t long").select(divergence.share(F.col("c"), F.col("t"))).collect()
    assert [r[0] for r in got] == want


def naive_phrases(rows, least, longest, cover, top):
    f, total = Counter(), Counter()
    for r in rows:
        lang = r[2] if r[2] is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(r[1])):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = defaultdict(list)
    for (lang, words), a in f.items():
        if len(words) < 2 or a < least:
            continue
        inside = lambda big: any(big[i : i + len(words)] == words for i in range(len(big) - len(words) + 1))
        if any(at == lang and len(big) > len(words) and b >= least and 100 * b >= cover * a and inside(big) for (at, big), b in f.items()):
            continue
        cuts = [(10**6 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def phrase_rows():
    rng = random.Random(8)
    words = ["new", "york", "city", "of", "the", "Ünder", "a", "a", "b"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", " \t", ", ", "\n", ". "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", "und", None])) for i in range(50)]
    return [*rows, (50, "new york city " * 30, "en"), (51, None, None), (52, "", "en"), (52, "", "en"), (53, "a " * 3000, "de"), (54, "only!here", "xx")]


def test_the_last_sum_of_phrases_leaves_them_out_of_python(spark):
    born = [np.full(16, phrases.NEVER, np.uint8) for _ in range(2)]
    born[0][3], born[1][9] = 1, 2
    rows = [("en", 1, "a", 3, 4), ("en", 1, "b", 9, 5), ("en", 2, "a b", 9, 6), ("en", 2, "b a", 3, 7)]
    got = phrases.promising(spark.createDataFrame(rows, phrases.COUNTED), born)
    assert sorted(map(tuple, got.collect())) == [rows[0], rows[2]]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan


@pytest.mark.parametrize("least, longest, shards, cells", [(10, 3, 3, 1 << 16), (4, 4, 2, 4), (6, 3, 1, 1 << 16), (10, 2, 5, 1 << 10)])
def test_phrases_equal_brute_force(spark, least, longest, shards, cells):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("n", "a", "phrase", "cell", "shard")}).repartition(4)
    got = phrases.report(*phrases.mine(docs, least=least, longest=longest, shards=shards, cells=cells), top=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == naive_phrases(rows, least, longest, 50, 40)


def test_phrases_of_awkward_tables(spark, table):
    assert phrases.report(*phrases.mine(empty(spark), cells=16)).count() == 0
    docs, rows = table
    got = phrases.report(*phrases.mine(docs, least=3, cells=1 << 12), top=50).collect()
    assert sorted(map(tuple, got)) == naive_phrases(rows, 3, 3, 50, 50)


def test_scores_pass_64_bits(spark):
    a, left, right = 4 * 10**15, 5 * 10**15, 4 * 10**15 + 3
    frequent = spark.createDataFrame([("en", 1, "x", left), ("en", 1, "y", right), ("en", 2, "x y", a)], "lang string, n int, phrase string, a long")
    row = phrases.scored(frequent).first()
    assert (row["l"], row["r"], row["score"]) == (left, right, 10**6 * a * a // (left * right))


def test_sharding_places(spark, table):
    docs, rows = table
    docs = docs.withColumns({c: F.lit("x") for c in ("v", "shard", "slot", "size", "bytes", "n")})
    got = sharding.shard(docs, work_path(spark, "t"), shards=4).collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 16, crc(r[1])) for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert set(by) <= set(range(4)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard(empty(spark), work_path(spark, "t")).count() == 0


def shard_bytes(rows, slot_map, n):
    got = rows.join(slot_map, "v").groupBy("shard").agg(F.sum("size").alias("b")).collect()
    return [{r["shard"]: r["b"] for r in got}.get(i, 0) for i in range(n)]


def test_maps_are_balanced_and_edited(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, "x" * int(rng.paretovariate(1.3) * 20) if i % 3 else "same") for i in range(4000)], "doc_id long, text string")
    rows = cut(sharding.records(docs, slots=512))
    held = sharding.loads(rows)
    folder = work_path(spark, "maps")
    sharding.save_map(sharding.first_map(spark, 8, 512), folder, 0)
    second = sharding.rebalance(spark, folder, held, 8)
    mean = sum(shard_bytes(rows, second, 8)) / 8
    assert max(abs(b - mean) for b in shard_bytes(rows, second, 8)) < 0.01 * mean
    # balanced already: nothing but the tail above the mean moves
    again = sharding.rebalance(spark, folder, held, 8)
    moved = second.join(again.withColumnRenamed("shard", "new"), "v").filter("shard <> new").join(held, "v").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    assert moved <= 0.03 * 8 * mean
    # one shard more: about a ninth moves; one less: all of the last leaves it
    grown = sharding.rebalance(spark, folder, held, 9)
    moved = again.join(grown.withColumnRenamed("shard", "new"), "v").filter("shard <> new").join(held, "v").agg(F.sum("bytes")).first()[0]
    assert max(abs(b - mean * 8 / 9) for b in shard_bytes(rows, grown, 9)) < 0.01 * mean and moved < 0.2 * 8 * mean
    fewer = sharding.rebalance(spark, folder, held, 7)
    assert fewer.count() == 512 and shard_bytes(rows, fewer, 9)[7:] == [0, 0]
    assert [sharding.load_map(spark, folder, i).count() for i in range(5)] == [512] * 5
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sharding.save_map(fewer, folder, 4)


def test_a_repeated_record_is_dealt_out(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("again").alias("text"))
    got = sharding.shard(docs, work_path(spark, "t"), shards=3)
    assert got.select("shard").distinct().count() == 1 and sorted(r["slot"] for r in got.collect()) == list(range(3000))

"""The operators for training text against brute force, and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfield.llm import caps, chat, language, lm, mixing, pieces, quality, secrets, signatures, texts, urls

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()), T.StructField("name", T.StringType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward(spark):
    """Nulls everywhere, empty and long texts, repeated rows and ids, ties, and columns with clashing names."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(400)
    near = base.split()
    near[7] = "changed"
    rows = [
        (1, base, "en", "a", 5, "x", "y"), (2, base, "en", "a", 5, None, None), (3, " ".join(near), "en", None, None, "x", "y"),
        (4, None, None, None, None, None, None), (5, "", "de", "b", 0, "x", "y"), (6, " \n\t ", "de", "b", 4, "x", "y"),
        (7, "one two", "de", "b", 7, "x", "y"), (8, "One\x0btwo", "de", "b", 7, "x", "y"), (9, "1234 !!", None, "b", 7, "x", "y"),
        (10, text(30_000), "en", "a", 9, "x", "y"), (11, "x" * 50_000, "en", "a", 9, "x", "y"), (11, "x" * 50_000, "en", "a", 9, "x", "y"),
        (None, text(50), "en", "c", 9, "x", "y"), (None, None, None, None, None, None, None), (12, "ü ß 執　a ▁ b\x00c", "de", "c", 9, "x", "y"),
    ]
    rows += [(100 + i, text(rng.randint(1, 120)), rng.choice(["en", "de"]), rng.choice(["a", "b", "c", None]), 1, "x", "y") for i in range(60)]
    return spark.createDataFrame(rows, DOCS), rows


@pytest.fixture(scope="module")
def table(spark):
    return awkward(spark)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_word_hashes_and_windows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a b c a b c", None, "", "  b\x0bc ", "a b c"]})
    (_, _, w), = texts.word_slices(batch)
    assert np.diff(w.first).tolist() == [6, 0, 0, 2, 3]
    assert w.hashes[0] == w.hashes[3] and w.hashes[1] == w.hashes[6] and w.hashes[0] != w.hashes[1]
    assert [len(s) for s in texts.shingle_sets(w, 3)] == [3, 0, 0, 1, 1]
    assert [len(s) for s in texts.shingle_sets(w, 4)] == [3, 0, 0, 1, 1]


def test_language_learns_and_rejects(spark):
    rng = random.Random(2)
    one, two = (["".join(rng.choice(letters) for _ in range(5)) for _ in range(50)] for letters in ("abcdef", "uvwxyz"))
    rows = [(i, " ".join(rng.choice(one if i % 2 else two) for _ in range(40)), "one" if i % 2 else "two") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs.filter("doc_id < 80"))
    got = {r["doc_id"]: r for r in language.identify(docs.filter("doc_id >= 80"), model).collect()}
    assert all(r["lang_pred"] == ("one" if i % 2 else "two") and not r["rejected"] for i, r in got.items())
    odd = language.identify(spark.createDataFrame([(1, "執" * 30), (2, "123"), (3, None)], "doc_id long, text string"), model).collect()
    assert [r["rejected"] for r in odd] == [True] * 3 and [r["lang_pred"] for r in odd[1:]] == ["und"] * 2 and odd[2]["score"] == 0


def test_language_rejects_despite_empty_labelled_rows(spark):
    rng = random.Random(2)
    one, two = (["".join(rng.choice(letters) for _ in range(5)) for _ in range(50)] for letters in ("abcdef", "uvwxyz"))
    rows = [(i, " ".join(rng.choice(one if i % 2 else two) for _ in range(40)), "one" if i % 2 else "two") for i in range(80)]
    odd = spark.createDataFrame([(1, "執" * 30), (2, "QQQQ JJJJ QQQQ")], "doc_id long, text string")
    for lone in ("", "7", "12 !", "a"):
        model = language.fit(spark.createDataFrame([*rows, (90, lone, "one"), (91, lone, "two")], "doc_id long, text string, lang string"))
        assert (model.limits > 0.1).all() and model.langs == ["one"] * 4 + ["two"] * 4
        assert all(len({c.tobytes() for c in part}) == 4 and np.allclose(np.linalg.norm(part, axis=1), 1, atol=1e-4) for part in (model.centroids[:4], model.centroids[4:]))
        assert all(r["rejected"] for r in language.identify(odd, model).collect())
    same = np.full((5, 4), 0.5)
    assert len(language.cluster(same, 4)) == 1


def test_language_on_awkward_tables(spark, table):
    docs, rows = table
    out = language.stage(spark, docs, "")
    assert out.columns == docs.columns and out.filter("text is null or trim(text) = ''").isEmpty()
    assert out.filter("doc_id = 1").count() == 1
    assert language.stage(spark, empty(spark), "").isEmpty()
    assert {r["lang_pred"] for r in language.identify(docs, language.fit(docs.filter("lang is null"))).collect()} == {"und"}


def brute_components(rows, k, threshold):
    sets = []
    for doc_id, text in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    least = {}
    for (doc_id, _), r in zip(rows, root):
        least[r] = min(least.get(r, doc_id), doc_id)
    return sorted((d, len(s), least[r]) for (d, _), s, r in zip(rows, sets, root))


def test_pairs_of_a_cell_are_tried_in_their_own_width(spark):
    rng = np.random.default_rng(4)
    base = np.sort(rng.integers(0, 2**64, 900, np.uint64))
    near = np.sort(np.concatenate([base[:880], rng.integers(0, 2**64, 20, np.uint64)]))
    sets = [np.sort(rng.integers(0, 2**64, n, np.uint64)) for n in (12, 13, 60, *range(700, 900, 5))] + [base, near]
    rows = [(7, i, len(s), i, signatures.bitmap(s)) for i, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "group long, name long, n long, root long, bits binary")
    for want in ("members", "roots", "all"):
        pairs = signatures.tree_pairs(table.drop("bits"), table.select("name", "bits"), 85, want)
        assert [(r.a, r.b) for r in pairs.collect()] == [(len(sets) - 2, len(sets) - 1)]


@pytest.mark.parametrize("k, threshold", [(4, 85), (5, 80)])
def test_components_match_brute_force(spark, k, threshold):
    """Chains of edits, so that links hold only between some members of a group."""
    rng = random.Random(k)
    words = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    for family in range(6):
        text = [rng.choice(words) for _ in range(rng.choice([6, 30, 60, 200]))]
        for _ in range(12):
            text = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 60))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((n, " ".join(text)))
            n += 1
    shared = " ".join(rng.choice(words) for _ in range(25))
    rows += [(n + i, shared + " " + " ".join(rng.choice(words) for _ in range(40))) for i in range(30)]
    rows += [(900, None), (901, ""), (902, "a b"), (903, "A\tb"), (904, rows[0][1].upper())]
    got = signatures.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=k, threshold=threshold)
    assert sorted(map(tuple, got.collect())) == brute_components(rows, k, threshold)


def test_large_groups_are_dealt_into_cells(spark, monkeypatch):
    monkeypatch.setattr(signatures, "CELL", 4)
    monkeypatch.setattr(signatures, "CARRY", 8)
    test_components_match_brute_force(spark, 4, 85)


def test_a_group_gives_links_and_not_its_pairs(spark, monkeypatch):
    """Sets that all but link are as many pairs as the square of their group; a cell writes only what connects its members."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 180, np.uint64)
    sets = [np.sort(np.concatenate([base, rng.integers(0, 2**64, 20, np.uint64)])) for _ in range(60)]
    sets += [np.sort(np.concatenate([s[:199], rng.integers(0, 2**64, 1, np.uint64)])) for s in sets[:5] for _ in range(3)]
    rows = [(group, i, len(s), i, s.tobytes()) for group in (7, 8) for i, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "group long, name long, n long, root long, items binary")
    for cell, piece in ((2048, 1 << 21), (2048, 2000), (16, 1 << 21)):
        monkeypatch.setattr(signatures, "CELL", cell)
        monkeypatch.setattr(signatures, "PIECE", piece)
        found = signatures.tree_links(table.drop("items"), table.filter("group = 7").select("name", "items"), 85)
        links = [(r.a, r.b) for r in found.collect()]
        root = signatures.joined(*(np.array(x) for x in zip(*links)), np.arange(len(sets)))[1]
        families = [[i, *range(60 + 3 * i, 63 + 3 * i)] for i in range(5)]
        assert len(links) <= 6 * 5 and sorted(np.flatnonzero(root == root[f[0]]).tolist() for f in families) == families
        assert len(set(root.tolist())) == 60


def test_near_copy_stage_on_awkward_tables(spark, table):
    docs, rows = table
    out = signatures.stage(spark, docs, "")
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == docs.columns and 2 not in ids and 3 not in ids and ids.count(1) == ids.count(11) == 1
    assert ids.count(None) == 2 and 8 not in ids
    assert signatures.stage(spark, empty(spark), "").isEmpty()


def test_pieces_equal_the_library(spark, table):
    import sentencepiece

    docs, rows = table
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary())
    rng = random.Random(1)
    signs = "abcdefghinorstuy eet  ▁\n<>/s_0123éß執😀-=."
    rows = [(1000 + i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 200)))) for i in range(400)] + [(r[0], r[1]) for r in rows]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pieces.encode(more, pieces.vocabulary()).collect():
        assert r["ids"] == library.encode(r["text"] or "") and r["decoded"] == library.decode(r["ids"])
    for r in pieces.digests(more, pieces.vocabulary()).join(more.dropDuplicates(["doc_id"]), "doc_id").collect():
        ids = library.encode(r["text"] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.stage(spark, empty(spark), "").isEmpty() and "ids" in pieces.stage(spark, docs, "").columns


@pytest.mark.parametrize("block", [256, 8])
def test_caps_match_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(caps, "BLOCK", block)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 32))
    spread = np.repeat([0.0, 0.02, 0.05, 0.08], 10)
    rows = [(int(i), (centres[i % 40] + rng.standard_normal(32) * spread[i % 40]).tolist()) for i in range(600)]
    rows += [(600, None), (601, [0.0] * 32), (602, [float("nan")] + [1.0] * 31), (603, [None] + [1.0] * 31), (604, [1.0, 2.0]), (605, [2.0, 4.0]), (606, []), (607, [1e300] * 32), (608, [1.0] * 32)]
    got = {r["vec_id"]: r for r in caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = np.array([v for _, v in rows[:600]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = x @ x.T >= 0.9
    found, wanted = sum(got[i]["n_links"] for i in range(600)), int(links.sum()) - 600
    assert wanted * 0.999 <= found <= wanted and all(got[i]["n_links"] <= links[i].sum() - 1 for i in range(600))
    assert [got[i]["n_links"] for i in range(600, 609)] == [0, 0, 0, 0, 1, 1, 0, 1, 1] and got[605]["component_id"] == 604 and not got[605]["kept"]
    assert len(got) == len(rows)


def test_caps_sends_no_table_through_the_driver(spark):
    """Spark sizes exploded caps and blocks too low, so it would broadcast them at any size near its threshold."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(16) + 3 * (i % 5)).tolist()) for i in range(60)]
    found = caps.cut(caps.decoded(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding"))
    placed = caps.cut(caps.led(found))
    sizes = caps.cut(placed.groupBy("lead").agg(F.count("*").alias("size")))
    near = caps.near_groups(placed, 0.9)
    for frame in (caps.led(found), near, caps.compared(near.select("g", "h"), placed, sizes, 0.9)):
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_lm_base_is_exact_and_bytes_sum_to_one(spark, table):
    docs, rows = table
    train = ~language.held_out(7, 2)
    got = lm.score(docs, train, head=16).collect()
    low = lambda t: [w.lower() for w in (t or "").encode().split()] + [b""]
    counts = Counter(w for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2 or r[0] is None for w in low(r[1]))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((r[0] is None, r[0] or 0, len(low(r[1])), sum(counts[w] > 0 for w in low(r[1])), round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in low(r[1])), 6)) for r in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == total and r["score"] < 0 for r in got)
    joined = lm.score(docs, train, head=1 << 20).collect()
    for r, q in zip(sorted(got, key=str), sorted(joined, key=str)):
        assert r["doc_id"] == q["doc_id"] and abs(r["score"] - q["score"]) < 1e-6 * abs(r["score"]) and r["n_known"] == q["n_known"]
    assert lm.score(empty(spark), train).isEmpty()


def test_a_task_of_the_language_model_holds_little():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(6)
    code = np.unique(rng.integers(0, 2**63, 1 << 19, np.uint64) & ~np.uint64(255) | np.uint64(97))
    batches = [lm.said_rows(part, *(np.ones(len(part)),) * 3, 0) for part in np.array_split(code, 50)]
    text = pa.RecordBatch.from_pydict({"text": ["".join(rng.choice(list("abcd "), 1 << 18))] * 16})
    tracemalloc.start()
    try:
        for block, x, *_ in lm.blocks(iter(batches), 4):
            lm.rise(*lm.decisions(block, x)[:3], None, 7, 4)
        data, offsets = texts.flat(text.column("text"))
        for low, high in texts.cuts(offsets):
            np.unique(lm.running(data, offsets[low : high + 1])[0], return_inverse=True)
        assert tracemalloc.get_traced_memory()[1] < 200 << 20
    finally:
        tracemalloc.stop()


def test_context_tree_weighting_equals_the_recursion(spark, monkeypatch):
    """Scores of words from the recursive definition; words without a count change nothing."""
    monkeypatch.setattr(lm, "BLOCK", 50)
    words = {"abracadabra": 3, "abra": 2, "cadabracad": 1, "dab": 4, "": 5, "unseen": 0, "abrax": 0}
    counts, spelling = Counter(), {}
    for word, n in words.items():
        said = b" " * 7 + (word.encode() + b" " if word else b"\xff")
        spelling[word] = [(said[i - 7 : i], said[i]) for i in range(7, len(said))]
        for gram in spelling[word]:
            counts[gram] += n

    def both(suffix, bits):
        return (sum(n for (c, x), n in counts.items() if c.endswith(suffix) and format(x, "08b").startswith(bits + s)) for s in "01")

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def node(suffix, bits):
        own = kt(*both(suffix, bits))
        if len(suffix) == 7:
            return own
        below = sum(node(bytes([c]) + suffix, bits) for c in {k[0][6 - len(suffix)] for k in counts if k[0].endswith(suffix)})
        return np.logaddexp(own, below) - math.log(2)

    def predict(context, depth, bits):
        a, b = both(context[7 - depth :], bits)
        one = (b + 0.5) / (a + b + 1)
        if depth == 7:
            return one
        share = math.exp(kt(a, b) - math.log(2) - node(context[7 - depth :], bits))
        return share * one + (1 - share) * predict(context, depth + 1, bits)

    table = spark.createDataFrame([(i, w, n) for i, (w, n) in enumerate(words.items())], "id long, word string, n long").repartition(3)
    grams = lm.fit(table)
    for head in (1, 8, 1 << 20):
        got = {r["word"]: r["log"] for r in lm.word_scores(table, grams, head).collect()}
        assert got.keys() == words.keys()
        for word, steps in spelling.items():
            want = 0.0
            for context, byte in steps:
                bits = format(byte, "08b")
                for i in range(8):
                    one = predict(context, 0, bits[:i])
                    want += math.log10(one if bits[i] == "1" else 1 - one)
            assert abs(got[word] - want) < 1e-6


def test_own_texts_are_scored_by_packed_grams(spark, monkeypatch):
    """The same scores as by joining every text with the table of grams; texts and parts are dealt in many pieces, and little is sent."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), i % 5 != 0) for i in range(150)] + [(900, None, True), (901, "", False)]
    docs = spark.createDataFrame(rows, "id long, text string, learn boolean").repartition(3).sortWithinPartitions("id")
    units = docs.select("id", "text", F.col("learn").cast("long").alias("n"))
    grams = lm.fit(units.withColumn("n", F.col("n").cast("double")), lm.running, "text")
    want = {r["id"]: r["log"] for r in lm.unit_scores(units, grams, 16, lm.running, "text").collect()}
    for name, size in (("CHUNK", 1000), ("PART", 500), ("BLOCK", 50)):
        monkeypatch.setattr(lm, name, size)
    chunks = lm.stored(lm.in_chunks(units), "texts")
    assert chunks.select("chunk").distinct().count() > 15
    got = {r["id"]: r["log"] for r in lm.own_scores(chunks).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    code = np.unique(lm.running(np.frombuffer(" ".join(rng.choice(words) for _ in range(20000)).encode(), np.uint8), np.array([0, 60000]))[0])
    logs = -np.exp(np.random.default_rng(8).normal(0, 1, len(code)))
    assert (lm.unpacked(lm.packed(code)) == code).all()
    for x in (logs, logs * 1e4, np.array([-np.inf, -1.0])):
        assert np.allclose(lm.opened(pa.py_buffer(lm.sealed(x)), len(x)), x, 0, 1e-12)
    assert len(lm.packed(code)) < 5 * len(code) and len(lm.sealed(logs)) < 6 * len(code)


def test_chunks_of_the_language_model_hold_few_grams(spark, monkeypatch):
    """Texts are written once, a chunk of many different grams is parted, and neither changes a result."""
    rng = random.Random(9)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 40)))) for i in range(120)] + [(500, None), (501, " \n "), (502, " Abc\tabc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {r["doc_id"]: r for r in lm.score(docs, F.col("doc_id") % 3 != 0).collect()}
    names, stored = [], lm.stored
    monkeypatch.setattr(lm, "stored", lambda df, name: names.append((name, out := stored(df, name))) or out)
    for name, size in (("GRAMS", 300), ("FOLD", 50), ("FLUSH", 40)):
        monkeypatch.setattr(lm, name, size)
    monkeypatch.setattr(lm, "cuts", lambda offsets: texts.cuts(offsets, 256))
    got = {r["doc_id"]: r for r in lm.score(docs, F.col("doc_id") % 3 != 0).collect()}
    assert got.keys() == want.keys()
    for i, r in want.items():
        assert all(got[i][c] == r[c] for c in ("held_out", "n_tokens", "n_known", "train_tokens"))
        assert abs(got[i]["score"] - r["score"]) < 1e-8 and abs(got[i]["base_score"] - r["base_score"]) < 1e-9
    assert "texts" not in [name for name, _ in names]
    asked = next(df for name, df in names if name == "asked").filter("said is null").collect()
    sizes = Counter()
    for r in asked:
        sizes[r["chunk"]] += len(lm.unpacked(r["codes"])) if r["part"] == 0 else 0
    assert len(sizes) > 8 and max(sizes.values()) < 1500
    words, sizes = lm.words_in([b"a b ", b"", b"a\xff "])
    assert words.to_pylist() == [b"a ", b"b ", b"a\xff "] and sizes.tolist() == [2, 0, 1]
    assert lm.Counts(words, np.array([1, 2, 3])).of(words.take(pa.array([2, 0]))).tolist() == [3, 1]


def test_lm_contexts_run_across_words(spark):
    """The same words in the order of the training texts cost less than in another order."""
    learned = [(i, "red fox ran far red fox ran far") for i in range(40)] + [(100 + i, "far ran fox red") for i in range(2)]
    asked = [(1000, "red fox ran far"), (1001, "ran red far fox")]
    docs = spark.createDataFrame(learned + asked, "doc_id long, text string")
    for head in (1, 1 << 20):
        got = {r["doc_id"]: r for r in lm.score(docs, F.col("doc_id") < 1000, head=head).collect()}
        assert got[1000]["base_score"] == pytest.approx(got[1001]["base_score"])
        assert got[1000]["score"] > got[1001]["score"] + 2
    gram, row = lm.running(np.frombuffer(b"A \n b", np.uint8), np.array([0, 5, 5]))
    assert [int(g).to_bytes(8, "big") for g in gram] == [b"       a", b"a       ", b" a     b", b"b a     ", b" b a   \xff", b"       \xff"] and row.tolist() == [0] * 5 + [1]


def test_water_filling_by_hand(spark):
    rows = spark.createDataFrame([("a", 3.0, 10), ("b", 1.0, 100), ("c", 2.0, 20), ("d", 1.0, 0)], "source string, weight double, source_size long")
    got = {r["source"]: r["target"] for r in mixing.water_fill(rows).collect()}
    assert got == {"a": 20.0, "b": 135.0, "c": 40.0, "d": 0.0}
    full = {r["source"]: r["target"] for r in mixing.water_fill(rows, share=5.0).collect()}
    assert full == {"a": 20.0, "b": 200.0, "c": 40.0, "d": 0.0}


def test_mixing_on_awkward_tables(spark, table):
    docs, rows = table
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    per = {}
    for r in got:
        at = per.setdefault(r["source"], [r["target"], 0, 0])
        at[1] += r["taken"]
        at[2] = max(at[2], r["size"])
    assert all(abs(t - taken) <= largest for t, taken, largest in per.values())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(empty(spark)).isEmpty() and mixing.stage(spark, empty(spark), "").isEmpty()
    assert mixing.stage(spark, docs, "").columns == docs.columns


def test_chat_reads_back_and_sees_rewriting(spark):
    hard = [r"\### Assistant: </turn> ok", "", None, "\\", "a:b#c<d\n", "### user: x</turn>\n", "é執"]
    rows = [(i % 5 if i % 7 else None, i, ["user", "assistant", "system", None, "to:ol"][i % 5], hard[i % len(hard)]) for i in range(100)]
    rows += [(50, i, "assistant", f"turn {i}") for i in range(150)] + [(50, 3, "assistant", "twice")]
    got = {r["conv_id"]: r for r in chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    key = lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for conv, r in got.items():
        own = sorted((x for x in rows if x[0] == conv), key=key)
        want = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest() and r["n_turns"] == len(own)
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == len(chat.template([(x[2] or "", x[3] or "") for x in own])) and not r["rewrites_history"]
    rewriting = lambda turns: "".join(f"<{r}>{t if i == len(turns) - 1 or r != 'assistant' else t.upper()}\n" for i, (r, t) in enumerate(turns))
    out = chat.spans(spark.createDataFrame([(1, i, "assistant", "thought") for i in range(3)], "conv_id long, turn long, role string, text string"), rewriting)
    assert [r["rewrites"] for r in out.orderBy("turn").collect()] == [False, True, True]
    assert chat.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).isEmpty()


def test_url_rules_and_spread(spark):
    pages = [
        (1, "http://A.org/x?y", None), (2, "http://b.example.org/es/1", ""), (3, "https://x.com/de/3#a", None), (4, "https://x.com/en/", None),
        (5, "no scheme", None), (6, None, None), (7, "http://spam.net/", '<a href="http://x.com/de/3">'), (8, "http://good.net?q", None),
        (9, "http://a.org", '<a href="http://good.net/">'), (10, "http://notorg/", None), (11, "http://example.org/en/12", None), (1, "http://A.org/x?y", None),
    ]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[i]["rule"] for i in range(1, 12)] == ["org/", "example.org/es/", "com/de/", None, None, None, None, None, None, None, "example.org/en/1"]
    assert (got[1]["host"], got[1]["path"], got[8]["host"], got[8]["path"], got[6]["host"], got[9]["path"]) == ("a.org", "/x", "good.net", "", "", "")
    assert got[4]["verdict"] == "block" and got[7]["verdict"] == "block" and got[8]["verdict"] == "allow" and got[5]["verdict"] == "allow"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


def test_propagation_equals_power_iteration(spark):
    edges = [("a", "b", 0.5), ("a", "c", 0.5), ("b", "a", 1.0), ("c", "d", 1.0)]
    got = {r["host"]: r["rank"] for r in urls.propagate(spark.createDataFrame([("a", 1.0)], "host string, start double"), spark.createDataFrame(edges, "src string, dst string, share double")).collect()}
    rank = {"a": 1.0}
    for _ in range(urls.ROUNDS):
        new = Counter()
        for s, d, w in edges:
            new[d] += urls.DAMPING * rank.get(s, 0) * w
        new["a"] += 1 - sum(new.values())
        rank = new
    assert all(abs(got[h] - rank[h]) < 1e-12 for h in got) and abs(sum(got.values()) - 1) < 1e-12


def test_secrets_base_and_learned(spark, table):
    rng = random.Random(4)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f'é password = "{hexes(30)}" and Token:{rng.randint(1, 9)}') for i in range(40)] + [(90, f"key {hexes(20)} ends"), (91, "plain words only thisisaverylongwordwithoutdigits"), (92, None), (93, "AKIA" + "Q" * 16 + " AKIAX"), (94, "secret=secret=abcdef")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = secrets.cut(secrets.hits(docs))
    got = {r["doc_id"]: r for r in secrets.judged(found, secrets.learn(found)).select("doc_id", secrets.listed(F.col("base")).alias("base"), secrets.listed(F.concat("base", "learned")).alias("spans")).collect()}
    assert got[0]["base"] == "assign:2:44,hex:14:44"
    assert got[90]["base"] == "" and got[90]["spans"] == "learned:4:24" and got[91]["spans"] == got[92]["spans"] == ""
    assert got[93]["base"] == "access:0:20" and got[94]["base"] == "assign:0:20"
    out = {r["doc_id"]: r["text"] for r in secrets.stage(spark, docs, "").collect()}
    assert out[90] == "key [secret] ends" and out[91] == rows[41][1] and out[92] is None and hexes(1) is not None and "[secret]" in out[0]
    awkward_docs, awkward_rows = table
    assert secrets.stage(spark, awkward_docs, "").count() == len(awkward_rows) and secrets.stage(spark, empty(spark), "").isEmpty()


def test_secrets_glued_to_names_paths_and_prefixes(spark):
    rng = random.Random(4)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    key = hexes(20)
    forms = ["key {}", "session_key={}", "/files/{}", "user-{} x", "NAME_{}", "at.{}.net", f"{hexes(40)}/{{}}"]
    rows = [(i, f"password = {hexes(20 + i % 9)}") for i in range(60)] + [(100 + i, form.format(key)) for i, form in enumerate(forms)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = secrets.cut(secrets.hits(docs))
    got = {r["doc_id"]: [s["value"] for s in r["learned"]] for r in secrets.judged(found, secrets.learn(found)).collect()}
    assert all(got[100 + i] == [key] for i in range(len(forms)))
    out = {r["doc_id"]: r["text"] for r in secrets.stage(spark, docs, "").collect()}
    assert out[101] == "session_key=[secret]" and out[102] == "/files/[secret]"
    short = secrets.Automaton([f"{rng.randint(100, 999)}{rng.choice('ghijkl')}{rng.randint(1000, 9999)}" for _ in range(80)])
    assert [s[1:] for s in secrets.stretches([("learned", 5, 18, "name_123h4567")], [short])] == [(10, 18, "123h4567")]


def test_automaton_prefers_its_format():
    rng = random.Random(6)
    values = ["ab" + "".join(rng.choice("0123456789") for _ in range(8)) + "Z" for _ in range(80)]
    model = secrets.Automaton(values)
    assert all(model.accepts(v) for v in values) and model.accepts("ef12345678Q") is False and not model.accepts("ab12Z") or len(model.go) > 0
    assert not model.accepts("zz-zz-zz") and model.score("") == -math.inf


def test_quality_counts_equal_brute_force(spark, table):
    docs, rows = table
    got = quality.judge(docs, np.zeros(quality.BUCKETS), -np.inf).collect()
    want = []
    for r in rows:
        text = r[1] or ""
        w = WORD.findall(text)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        want.append(str((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed, not failed)))
    assert sorted(str(tuple(r)[:8]) for r in got) == sorted(want)


def test_quality_separates_targets(spark):
    rng = random.Random(8)
    good, bad = ([f"{p}{i}" for i in range(60)] for p in ("g", "b"))
    rows = [(i, " ".join(rng.choice(bad if i % 10 == 0 else good) for _ in range(80))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 400, 3) if i % 10], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, *quality.fit(docs, quality.trusted_ids(labels))).collect()}
    assert all(got[i] == (i % 10 != 0) for i in range(400))
    assert quality.judge(empty(spark), *quality.fit(empty(spark), [])).isEmpty()


def test_quality_learns_from_all_trusted_rows(spark):
    n = 12_000
    labels = spark.range(n).selectExpr("id as doc_id", "1 as quality", "cast(null as int) as toxic")
    ids = quality.trusted_ids(labels.union(labels))
    assert ids.count() == n
    # each trusted text is one word of its own, given twice; a random third of the documents isn't trusted
    docs = spark.range(n + n // 2).selectExpr("id as doc_id", "concat('w', id, ' w', id) as text")
    ratio, least = quality.fit(docs.union(docs), ids)
    own = {r["doc_id"]: r["score"] for r in quality.judge(docs, ratio, least).collect()}
    even = {r["id"] for r in spark.range(n).filter("pmod(xxhash64(id), 2) = 0").collect()}
    fitted = quality.gram_counts(docs.filter(f"doc_id < {n} and pmod(xxhash64(doc_id), 2) = 0"), "text", quality.BUCKETS)
    raw = quality.gram_counts(docs, "text", quality.BUCKETS)
    assert fitted.sum() == 3 * len(even) and raw.sum() == 3 * (n + n // 2)
    assert np.allclose(ratio, np.log((2 * fitted + 1) / (2 * fitted.sum() + quality.BUCKETS)) - np.log((2 * raw + 1) / (2 * raw.sum() + quality.BUCKETS)))
    rest = np.array([own[i] for i in range(n) if i not in even])
    assert np.isclose(least, rest.mean() - quality.SPREAD * rest.std())
    # a bitmap that is full lets everything through to the join, which decides
    for bits in (8, quality.BITS):
        assert {r["doc_id"] for r in quality.trusted_rows(docs, ids.filter("doc_id < 300"), "doc_id", bits).collect()} == set(range(300))


def test_pipeline_runs_and_keeps_columns(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert out.columns == [*docs.columns, "ids"] and out.count() > 0
    kept = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert kept <= {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_chat_templates_may_look_back_over_any_number_of_turns(spark):
    rows = spark.createDataFrame([(1, i, "assistant", f"t{i}") for i in range(3 * chat.SEGMENT)], "conv_id long, turn long, role string, text string")
    numbered = lambda turns: "".join(f"[{i}] {t}\n" for i, (_, t) in enumerate(turns))
    got = [(r["span"], r["span"][r["begin"] : r["end"]], r["rewrites"]) for r in chat.spans(rows, numbered).orderBy("turn").collect()]
    assert got == [(f"[{i}] t{i}\n", f"t{i}", False) for i in range(3 * chat.SEGMENT)]
    # a template of turns on their own has the same spans in segments
    assert chat.spans(rows, chat.template).exceptAll(chat.spans(rows, chat.template, segment=4)).isEmpty()
    # history rewritten more than a segment later
    late = lambda turns: "".join(t + ("!" if len(turns) > 2 * chat.SEGMENT else "") + "\n" for _, t in turns)
    assert [r["rewrites"] for r in chat.spans(rows, late).orderBy("turn").collect()] == [i >= 2 * chat.SEGMENT for i in range(3 * chat.SEGMENT)]

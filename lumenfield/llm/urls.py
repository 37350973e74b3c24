"""URL filters by rules and, where none fits, by trust spread over the links between hosts.

Hosts are joined by the absolute links of their pages and, both ways, to their parent
domain. Personalised PageRank runs twice over these edges: trust starts at the hosts whose
pages an allow rule admits and follows the edges; distrust starts at the hosts whose pages
a block rule stops and runs against the edges. A host is blocked if its distrust is above
``RATIO`` times its trust. Mass of hosts without an edge returns to the seeds. DataFrame
functions only.

Null urls and urls without ``://`` have an empty host and path, fit no rule and get the
empty host's verdict (allow, as no edge leads there). Repeated pages count once each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfield.session import cut

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
ROUNDS = 8
DAMPING = 0.85
RATIO = 1.0
LINK = r"""(?i)href\s*=\s*["']?(https?://[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.regexp_replace(url, r"(?s)^.*?://", ""), "/", 1))
    host = F.regexp_replace(rest, r"(?s)[?#].*$", "")
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def ruled(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """``pages(host, path)`` with ``rule`` and ``rule_verdict`` of the longest fitting rule."""
    best = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for _, h, p in best]
    rule = reduce(lambda rest, x: F.when(x[0], F.lit(x[1][1] + x[1][2])).otherwise(rest), reversed(list(zip(fits, best))), F.lit(None).cast("string"))
    verdict = reduce(lambda rest, x: F.when(x[0], F.lit(x[1][0])).otherwise(rest), reversed(list(zip(fits, best))), F.lit(None).cast("string"))
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def host_edges(links: DataFrame) -> DataFrame:
    """(src, dst, share) from ``links(src, dst)``: links between hosts, and both ways to the parent domain; shares of a source sum to 1."""
    names = links.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    parts = F.split("host", r"\.")
    up = names.filter("host <> ''").withColumn("_n", F.size(parts)).select("host", F.explode(F.when(F.col("_n") > 2, F.transform(F.sequence(F.lit(2), F.col("_n") - 1), lambda i: F.array_join(F.slice(parts, F.col("_n") - i + 1, i), ".")))).alias("parent"))
    chain = up.select(F.col("host").alias("src"), F.col("parent").alias("dst"))
    every = links.filter("src <> '' and dst <> ''").select("src", "dst").unionByName(chain).unionByName(chain.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    counted = every.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = counted.groupBy("src").agg(F.sum("n").alias("total"))
    return counted.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share"))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, rank): personalised PageRank from ``seeds(host, start)``; the mass a round loses at hosts without an edge returns to the seeds.

    With a column ``kind`` in seeds and edges every kind is a graph of its own, and all go through the rounds together.
    """
    kinds = [c for c in ("kind",) if c in seeds.columns]
    rank = seeds.select(*kinds, "host", F.col("start").alias("rank"))
    spread = edges.withColumnRenamed("src", "host").select(*kinds, "host", "dst", "share")
    for _ in range(rounds):
        moved = cut(rank.join(spread, [*kinds, "host"]).groupBy(*kinds, F.col("dst").alias("host")).agg((F.sum(F.col("rank") * F.col("share")) * damping).alias("rank")))
        kept = {tuple(r)[:-1]: r["kept"] for r in moved.groupBy(*kinds).agg(F.sum("rank").alias("kept")).collect()}
        left = F.lit(1.0) - (F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for (k,), v in kept.items()], F.lit(0.0)) if kinds else F.lit(kept.get((), 0.0) or 0.0))
        # a host may have a row of each; sums are linear, so the next round adds them up
        rank = moved.unionByName(seeds.select(*kinds, "host", (F.col("start") * left).alias("rank")))
    return cut(rank.groupBy(*kinds, "host").agg(F.sum("rank").alias("rank")))


def judge(pages: DataFrame, url: str = "url", html: str = "html", rules: tuple[tuple[str, str, str], ...] = RULES, ratio: float = RATIO) -> DataFrame:
    """``pages`` with host, path, rule, verdict, trust and distrust."""
    located = ruled(pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url))), rules)
    per_host = cut(located.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("rule_verdict") == "allow").alias("allowed"), F.count_if(F.col("rule_verdict") == "block").alias("blocked")))
    targets = located.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("_to")).select("src", host_of(F.col("_to")).alias("dst"))
    edges = cut(host_edges(targets.unionByName(per_host.select(F.col("host").alias("src"), F.col("host").alias("dst")))))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("share").alias("n"))
    back = cut(back.join(back.groupBy("src").agg(F.sum("n").alias("total")), "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")))

    def seeds(name: str) -> DataFrame:
        known = per_host.filter((F.col(name) > 0) & (F.col("host") != ""))
        total = known.agg(F.sum(name).alias("total")).first()["total"] or 1
        return known.select("host", (F.col(name) / F.lit(total)).alias("start"))

    both = propagate(
        seeds("allowed").withColumn("kind", F.lit("trust")).unionByName(seeds("blocked").withColumn("kind", F.lit("distrust"))),
        edges.withColumn("kind", F.lit("trust")).unionByName(back.withColumn("kind", F.lit("distrust"))),
    )
    ranks = both.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("rank"))).alias(k) for k in ("trust", "distrust")])
    scored = per_host.select("host").join(ranks, "host", "left").fillna(0.0, ["trust", "distrust"])
    verdict = F.coalesce("rule_verdict", F.when(F.col("distrust") > F.col("trust") * ratio, F.lit("block")).otherwise(F.lit("allow")))
    return located.drop(html).join(scored, "host", "left").withColumn("verdict", verdict).drop("rule_verdict")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")

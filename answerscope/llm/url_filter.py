"""URL filters: explicit rules, and trust and distrust propagated over the host graph for the rest.

Rules name a host and a path; a rule fits its host and all subdomains where the path of the
url starts with the rule's, and the longest rule that fits wins. Pages without a rule follow
their host. Each host starts with two seeds, the shares of its pages that the rules allow
and block. Trust is a personalised PageRank from the first along links, distrust one from
the second against them (a host that links to bad hosts is suspect). That splits a bad
host's distrust among all that link to it, so suspicion goes along too: it starts as distrust
does, and a host takes the mean of the hosts it links to, however many others link to them.
All start from shares, so they compare on one scale: a host is blocked when the larger of its
distrust and suspicion is above its trust and above ``BLOCK_ABOVE`` times what a wholly blocked
host has by itself.

Links are absolute and protocol-relative href targets to another host, each pair of hosts
once. A step joins ranks with edges and sums; sums are combined before the shuffle, and a
host with very many links is split by adaptive execution. Steps go on until no rank moves by
``TOLERANCE`` (at most ``STEPS``: by then what is left is 0.85**60, below it), and lineage is
cut after each. Nothing is collected but the largest move.

Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: then up to
``? #`` or the end; a null url or one without ``://`` has neither and is allowed, as the empty
host has no seeds. A null html has no links. A null page_id is kept. Repeated rows get equal
results and count as pages of their host each. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerscope.llm.common import Scratch, table

RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
FOLLOW = 0.85
STEPS = 60
TOLERANCE = 1e-4
BLOCK_ABOVE = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"(?i)href\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^\s\"'<>/?#]+)"


def _rest(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = None
    for verdict, at, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        found = F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of links between different hosts."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1)))).alias("to"))
    return links.select("src", F.translate("to", _UPPER, _LOWER).alias("dst")).where("src <> dst AND src <> ''").distinct()


def propagate(seeds: DataFrame, edges: DataFrame, scratch: Scratch, follow: float = FOLLOW, steps: int = STEPS) -> DataFrame:
    """Seeds (host, trust, distrust) and edges (src, dst) to (host, trust, distrust, suspicion) after propagation."""
    out_links = edges.groupBy("src").agg(F.count("*").alias("n"))
    in_links = edges.groupBy("dst").agg(F.count("*").alias("n"))
    ahead = edges.join(out_links, "src").select(F.col("src").alias("from"), F.col("dst").alias("to"), F.lit("t").alias("kind"), (1.0 / F.col("n")).alias("w"))
    against = edges.join(in_links, "dst").select(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit("d").alias("kind"), (1.0 / F.col("n")).alias("w"))
    mean = edges.join(out_links, "src").select(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit("s").alias("kind"), (1.0 / F.col("n")).alias("w"))
    flow = scratch.keep(ahead.unionByName(against).unionByName(mean))
    start = seeds.select(F.col("host").alias("to"), F.explode(F.create_map(F.lit("t"), F.col("trust"), F.lit("d"), F.col("distrust"), F.lit("s"), F.col("distrust"))).alias("kind", "seed")).where("seed > 0")
    start = scratch.keep(start.withColumn("seed", F.col("seed") * (1 - follow)))
    ranks = start.withColumnRenamed("seed", "rank")
    for _ in range(steps):
        moved = ranks.withColumnRenamed("to", "from").join(flow, ["from", "kind"]).select("to", "kind", (F.col("rank") * F.col("w") * follow).alias("rank"), F.lit(0.0).alias("old"))
        own = start.select("to", "kind", F.col("seed").alias("rank"), F.lit(0.0).alias("old"))
        before = ranks.select("to", "kind", F.lit(0.0).alias("rank"), F.col("rank").alias("old"))
        step = scratch.keep(moved.unionByName(own).unionByName(before).groupBy("to", "kind").agg(F.sum("rank").alias("rank"), F.sum("old").alias("old")))
        largest = step.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks = step.select("to", "kind", "rank")
        if (largest or 0.0) < TOLERANCE:
            break
    return ranks.groupBy(F.col("to").alias("host")).agg(
        *[F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)).alias(name) for kind, name in (("t", "trust"), ("d", "distrust"), ("s", "suspicion"))])


def judge_pages(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every row of ``pages``; distrust is the larger of distrust and suspicion."""
    scratch = Scratch(pages.sparkSession, "urls")
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    judged = scratch.keep(judged)
    share = lambda verdict: F.avg(F.when(F.col("fit.verdict") == verdict, 1.0).otherwise(0.0))
    seeds = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    ranks = propagate(seeds, scratch.keep(host_edges(pages)), scratch).withColumn("distrust", F.greatest("distrust", "suspicion")).drop("suspicion")
    alone = (1 - FOLLOW) * BLOCK_ABOVE
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") > alone)
    joined = judged.join(ranks, "host", "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(bad, "block"), F.lit("allow"))
    return joined.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_pages(table(spark, folder, "pages", "page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op9_url_filter": op9_url_filter}
ORACLES: dict[str, str] = {}

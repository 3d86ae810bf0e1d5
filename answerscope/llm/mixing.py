"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every source gets a target: its share by weight of the total size, at most ``most`` times
its own size, the excess going to the others by weight. A source's documents stand in one
order (by size, then by digest of the id); with rate = target / size, the running sum of
expected copies after the k-th document is k * rate. A document is emitted once for every
integer that its step of the running sum, moved by one offset of the source, crosses.
Ordering by size keeps the words taken close to the target: documents of equal size are
taken evenly, so the error of a source is a few documents' words.

The order is found by counting, so no source is held by one task: documents are numbered
inside (source, size, digest bucket), buckets are summed inside (source, size), and sizes
inside a source; each of these windows is over counts, or over one bucket of 4,096.

Nulls: a null text has size 0, a null source is a source of its own (last), a null doc_id
is ordered as ''. Rows that agree in source, size and doc_id are interchangeable. An empty
table gives an empty result. Other columns are kept by ``mixed_rows`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerscope.llm.common import WORD, Scratch, free_name, table

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(m_source, m_size) per document to one row per source with m_source_size and m_target."""
    per_source = sizes.groupBy("m_source").agg(F.sum("m_size").alias("m_source_size"))
    by_name = Window.orderBy(F.col("m_source").asc_nulls_last())
    slot = (F.row_number().over(by_name) - 1) % len(weights)
    every = Window.partitionBy()
    rows = per_source.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (slot + 1).cast("int")).cast("bigint"))
    rows = rows.withColumns({"cap": F.col("m_source_size") * most, "total": F.sum("m_source_size").over(every), "all_w": F.sum("w").over(every)})
    # the level falls on sources in order of cap / weight: a source is full when the level of the rest lies above it
    before = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("m_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "w_before": F.coalesce(F.sum("w").over(before), F.lit(0))})
    full = F.col("cap") / F.col("w") < (F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before"))
    rows = rows.withColumn("full", full)
    rows = rows.withColumns({
        "left": F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0)),
        "left_w": F.sum(F.when(~F.col("full"), F.col("w"))).over(every)})
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("left") * F.col("w")).cast("double") / F.col("left_w"))
    return rows.select("m_source", "m_source_size", target.alias("m_target"))


def _offset(source: Column, seed: str) -> Column:
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(source, F.lit("\x00"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def copy_counts(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Rows of (m_id, m_source, m_size) with m_source_size, m_target and m_copies."""
    digest = F.md5(F.coalesce(F.col("m_id").cast("string"), F.lit("")))
    rows = rows.withColumns({"m_digest": digest, "m_bucket": F.substring(digest, 1, 3)})
    cell = ["m_source", "m_size", "m_bucket"]
    buckets = rows.groupBy(*cell).agg(F.count("*").alias("n"))
    in_size = Window.partitionBy("m_source", "m_size").orderBy("m_bucket")
    buckets = buckets.withColumn("in_size", F.sum("n").over(in_size) - F.col("n"))
    in_source = Window.partitionBy("m_source").orderBy("m_size")
    steps = rows.groupBy("m_source", "m_size").agg(F.count("*").alias("n_size")).withColumn("in_source", F.sum("n_size").over(in_source) - F.col("n_size"))
    same = lambda a, b, names: [a[c].eqNullSafe(b[c]) for c in names]
    starts = buckets.join(steps, same(buckets, steps, ["m_source", "m_size"])).select(
        *(buckets[c] for c in cell), (F.col("in_size") + F.col("in_source")).alias("start"))
    targets = source_targets(rows.select("m_source", "m_size"), weights, most)
    starts = starts.join(targets, same(starts, targets, ["m_source"])).select(*(starts[c] for c in cell), "start", "m_source_size", "m_target")
    numbered = rows.withColumn("m_place", F.row_number().over(Window.partitionBy(*cell).orderBy("m_digest")))
    out = numbered.join(starts, same(numbered, starts, cell)).select(*(numbered[c] for c in numbered.columns), "start", "m_source_size", "m_target")
    place = (F.col("start") + F.col("m_place")).cast("double")
    rate = F.when(F.col("m_source_size") > 0, F.col("m_target") / F.col("m_source_size")).otherwise(F.lit(0.0))
    u = _offset(F.col("m_source"), seed)
    copies = F.floor(place * rate + u) - F.floor((place - 1.0) * rate + u)
    return out.withColumn("m_copies", copies.cast("bigint")).drop("m_digest", "m_bucket", "m_place", "start")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: every document as often as it is drawn, with ``mix_copy`` 1, 2, ... added.

    A column of ``docs`` that is called ``mix_copy`` stays; the added one then gets an underscore more.

    Sizes are counted first and the draw is made on narrow rows; the rows drawn then meet
    their documents again by id, source and size.
    """
    size, times, copy = (free_name(n, docs.columns) for n in ("m_size", "mix_n", "mix_copy"))
    sized = docs.withColumn(size, size_of(docs["text"]))
    narrow = sized.select(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col(size).alias("m_size"))
    drawn = copy_counts(Scratch(docs.sparkSession, "mix").keep(narrow), weights, most, seed)
    # rows that agree in all three may differ in copies: number them on both sides only where there are several
    drawn = drawn.groupBy("m_id", "m_source", "m_size").agg(F.sort_array(F.collect_list("m_copies")).alias("m_list"))
    joined = sized.join(drawn, [sized["doc_id"].eqNullSafe(drawn["m_id"]), sized["source"].eqNullSafe(drawn["m_source"]), sized[size] == drawn["m_size"]])
    keep = [sized[c] for c in docs.columns]
    several = F.size(drawn["m_list"]) > 1
    nth = F.row_number().over(Window.partitionBy(drawn["m_id"], drawn["m_source"], drawn["m_size"]).orderBy(sized["text"]))
    one = joined.where(~several).select(*keep, F.element_at(drawn["m_list"], 1).alias(times))
    more = joined.where(several).select(*keep, F.element_at(drawn["m_list"], nth).alias(times))
    out = one.unionByName(more).where(F.col(times) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).drop(times)


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "source", "text")
    rows = docs.select(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), size_of(F.col("text")).alias("m_size"))
    rows = Scratch(spark, "op1").keep(rows)  # the texts are read once
    drawn = copy_counts(rows)
    return drawn.select(
        F.col("m_id").alias("doc_id"), F.col("m_size").alias("size"), F.col("m_source_size").alias("source_size"),
        F.col("m_target").alias("target"), (F.col("m_copies") * F.col("m_size")).alias("taken"))


_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, source_size * 3 AS cap FROM s0),
s2 AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(w) OVER ()::BIGINT AS all_w,
  coalesce(sum(cap) OVER b, 0)::BIGINT AS cap_before, coalesce(sum(w) OVER b, 0)::BIGINT AS w_before FROM s1
  WINDOW b AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, cap::DOUBLE / w < (total - cap_before)::DOUBLE / (all_w - w_before) AS filled FROM s2),
s4 AS (SELECT *, total - coalesce(sum(cap) FILTER (filled) OVER (), 0)::BIGINT AS remains, sum(w) FILTER (NOT filled) OVER ()::BIGINT AS remains_w FROM s3),
s AS (SELECT source, source_size, CASE WHEN filled THEN cap::DOUBLE ELSE (remains * w)::DOUBLE / remains_w END AS target,
  ('0x' || substr(md5('mix-1|' || coalesce(source, chr(0))), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM s4),
p AS (SELECT d.doc_id, d.size, s.source_size, s.target, s.u,
  CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0.0::DOUBLE END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5(coalesce(d.doc_id::VARCHAR, '')))::DOUBLE AS place
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, ((floor(place * rate + u) - floor((place - 1.0::DOUBLE) * rate + u))::BIGINT * size)::BIGINT AS taken FROM p"""

QUERIES = {"op1_mix_sources": op1_mix_sources}
ORACLES = {"op1_mix_sources": _SQL}

"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit for each dimension, set where the value is above 0. A code is
cut into ``SEGMENTS`` parts of ``SEGMENT_BITS`` bits and indexed under each (part, value).
If two codes differ in d bits, some part differs in d // SEGMENTS bits at most. So after all
parts have been searched up to radius r, every code within (r + 1) * SEGMENTS - 1 has been
met. A round probes all part values at the next radius, verifies the codes met by their full
distance, and a query is done when its k-th neighbour lies within the covered distance;
the others go on with the next radius. Nothing is skipped: the last radius covers all codes.

Equal codes are one entry of the index that carries its ``K`` + 1 smallest ids, which is
all that can be among the first K; equal queries are searched once. So a vector that fills a
third of the table costs one entry and one query. Probes are joined with the index, a part
value that very many codes share is split by adaptive execution, and what was met is cut
after each round to the distance at which enough ids are held.

Queries are the rows whose id is divisible by ``EVERY``; a row is not its own neighbour. Ties
in distance go to the smaller id. Null or empty vectors, vectors with a null entry and null
ids have no code: such rows are neither found nor searched for. A repeated row is one neighbour.
Vectors shorter than 64 have zeros in the missing bits; longer ones use the first 64 signs of
their coordinates. With fewer than k other vectors, all are returned. Empty in, empty out.
"""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerscope.llm.common import Scratch, table

K = 10
EVERY = 50
SEGMENTS = 4
SEGMENT_BITS = 16
BITS = SEGMENTS * SEGMENT_BITS


def codes_of(vectors: DataFrame) -> DataFrame:
    """(id, code) of the rows that have a code."""
    bits = F.transform(F.slice("embedding", 1, BITS), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    code = F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull())
    return vectors.where(whole & F.col("vec_id").isNotNull()).select(F.col("vec_id").alias("id"), code.alias("code")).distinct()


def _parts(code: str) -> list[Column]:
    value = lambda s: F.shiftrightunsigned(code, SEGMENT_BITS * s).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)).cast("int")
    return [F.struct(F.lit(s).alias("segment"), value(s).alias("value")) for s in range(SEGMENTS)]


def _masks(radius: int) -> Column:
    """All values of a segment with ``radius`` bits set, as one constant: at most 12,870."""
    return F.from_json(F.lit(json.dumps([sum(1 << b for b in bits) for bits in combinations(range(SEGMENT_BITS), radius)])), "array<int>")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(query_id, id, distance, place): the k nearest others of each query (id, code) among ``vectors`` (id, code)."""
    by_code = Window.partitionBy("code").orderBy("id")
    # the rank limit is applied before the shuffle, so a code sends k + 1 rows from each task at most
    first = vectors.withColumn("n", F.row_number().over(by_code)).where(F.col("n") <= k + 1)
    entries = scratch.keep(first.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    index = scratch.keep(entries.select("code", F.size("ids").alias("held"), F.explode(F.array(*_parts("code"))).alias("p")).select("code", "held", "p.segment", "p.value"))
    open_ = scratch.keep(queries.select(F.col("code").alias("query"), F.lit(BITS).alias("bound")).distinct())
    spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few queries make many probes
    pairs = met = None
    nearer = Window.partitionBy("query").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
    for radius in range(SEGMENT_BITS + 1):
        probe = open_.repartition(spread, "query").select("query", "bound", F.explode(F.array(*_parts("query"))).alias("p"))
        probe = probe.select("query", "bound", "p.segment", F.explode(F.transform(_masks(radius), lambda m: F.col("p.value").bitwiseXOR(m))).alias("value"))
        distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code")))
        # probes are made from few rows, so their number is underestimated; they must not be broadcast
        found = probe.hint("merge").join(index.hint("merge"), ["segment", "value"]).where(distance <= F.col("bound")).select("query", "code", distance.alias("distance"), "held").distinct()
        # beyond the distance at which k + 1 ids are held nothing can be among the first k others
        met = (found if met is None else met.unionByName(found).distinct()).withColumn("before", F.coalesce(F.sum("held").over(nearer), F.lit(0)))
        met = scratch.keep(met.where(F.col("before") < k + 1).drop("before"))
        state = met.groupBy("query").agg(F.sum("held").alias("n"), F.max("distance").alias("far"))
        bound = F.when(F.col("n") >= k + 1, F.col("far")).otherwise(F.lit(BITS))
        state = scratch.keep(open_.select("query").join(state, "query", "left").select("query", bound.alias("bound")))
        covered = SEGMENTS * (radius + 1) - 1
        finished = (F.col("bound") <= covered) | F.lit(radius == SEGMENT_BITS)
        ready = met.join(state.where(finished), "query", "left_semi")
        pairs = ready if pairs is None else pairs.unionByName(ready)
        open_ = state.where(~finished)
        if open_.isEmpty():
            break
        met = met.join(open_, "query", "left_semi")
    near = pairs.join(entries, "code").select("query", "distance", F.explode("ids").alias("id"))
    nearest_ids = near.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))).where(F.col("n") <= k + 1)
    lists = nearest_ids.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("near"))
    answers = queries.join(lists, queries["code"] == lists["query"])
    own = F.filter("near", lambda x: x["id"] != F.col("query_id"))
    answers = answers.select(F.col("id").alias("query_id"), "near").select("query_id", F.posexplode(F.slice(own, 1, k)).alias("place", "x"))
    return answers.select("query_id", F.col("x.id").alias("id"), F.col("x.distance").alias("distance"), (F.col("place") + 1).alias("place"))


def op6_hamming_topk(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark, "op6")
    codes = scratch.keep(codes_of(table(spark, folder, "embeddings", "vec_id", "embedding")))
    found = nearest(codes, codes.where(F.col("id") % EVERY == 0), K, scratch)
    return found.select("query_id", F.col("id").alias("vec_id"), F.col("distance").cast("bigint").alias("distance"), F.col("place").cast("bigint").alias("place"))


_BITS = " + ".join(f"(CASE WHEN embedding[{k + 1}] > 0 THEN {1 << k}::UBIGINT ELSE 0::UBIGINT END)" for k in range(BITS))
_SQL = f"""
WITH c AS (SELECT DISTINCT vec_id, {_BITS} AS code FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code))::BIGINT AS distance FROM c q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM d)
SELECT query_id, vec_id, distance, place FROM r WHERE place <= {K}"""

QUERIES = {"op6_hamming_topk": op6_hamming_topk}
ORACLES = {"op6_hamming_topk": _SQL}

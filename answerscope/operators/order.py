"""Exact order statistics that never sort one group in one task.

Ranks, quantiles and samples need an order inside a group, and a group may hold a
third of all rows.  The pattern used throughout:

1. equal values collapse into one counted cell, map-side, so a popular value is one row;
2. a group with more than ``GROUP_CELLS`` cells is cut at its own approximate
   quantiles into ``PARTS`` parts, other groups stay whole;
3. running sums are taken inside a part (bounded work per task) and over the part
   totals (``PARTS`` rows per group), and added.

The cut points only steer the load: results are exact whatever they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerscope.functions.hashing import HASH_RANGE, hash32

GROUP_CELLS = 1_000_000
PARTS = 512  # a power of two: cut points are found by halving
ALL = "__all"


def keyed(df: DataFrame, group: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The grouping to use: the given columns, or one constant column for 'all rows'."""
    if group:
        return df, list(group)
    return df.withColumn(ALL, F.lit(0)), [ALL]


def in_parts(cells: DataFrame, group: Sequence[str], value: str, weights: Sequence[str], limit: int = GROUP_CELLS, parts: int = PARTS) -> DataFrame:
    """Adds ``__part``, NULL in ordinary groups, an increasing range number in hot ones.

    ``weights`` are the row counts of a cell.  Every branch reads all of them, so that the cells
    are aggregated and shuffled once and the other branches reuse that shuffle.
    """
    rows = sum((F.col(w) for w in weights), F.lit(0))
    hot = cells.groupBy(*group).agg(F.sum(rows).alias("__rows")).where(F.col("__rows") > limit).select(*group)
    probabilities = [i / parts for i in range(1, parts)]
    cuts = (
        cells.where(rows > 0).join(hot, list(group), "left_semi")
        .groupBy(*group)
        .agg(F.percentile_approx(value, F.lit(probabilities), F.lit(parts * 8)).alias("__cuts"))
    )
    strides, stride = [], parts // 2
    while stride:
        strides.append(stride)
        stride //= 2
    place = F.aggregate(
        F.lit(strides),
        F.lit(0),
        lambda low, step: F.when(F.get(F.col("__cuts"), low + step - 1) < F.col(value), low + step).otherwise(low),
    )
    return cells.join(cuts, list(group), "left").withColumn("__part", F.when(F.col("__cuts").isNotNull(), place)).drop("__cuts")


def running_totals(cells: DataFrame, group: Sequence[str], value: str, weights: Sequence[str],
                   limit: int = GROUP_CELLS, parts: int = PARTS) -> DataFrame:
    """Adds ``below_<w>``: the sum of each weight over the group's smaller values.

    ``cells`` holds one row per (group, value).  Only hot groups need offsets between parts; where
    there are none that join is empty and dropped at run time.
    """
    split = in_parts(cells, group, value, weights, limit, parts)
    before = Window.partitionBy(*group, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        split.where(F.col("__part").isNotNull())
        .groupBy(*group, "__part")
        .agg(*[F.sum(w).alias(f"__sum_{w}") for w in weights])
        .select(*group, "__part", *[F.coalesce(F.sum(f"__sum_{w}").over(earlier), F.lit(0)).alias(f"__base_{w}") for w in weights])
    )
    placed = split.withColumns({f"__inside_{w}": F.coalesce(F.sum(w).over(before), F.lit(0)) for w in weights})
    joined = placed.join(offsets, [*group, "__part"], "left")
    totals = {f"below_{w}": F.col(f"__inside_{w}") + F.coalesce(F.col(f"__base_{w}"), F.lit(0)) for w in weights}
    return joined.withColumns(totals).drop("__part", *[f"__inside_{w}" for w in weights], *[f"__base_{w}" for w in weights])


def average_ranks(df: DataFrame, value: str, group: Sequence[str] = (), rank: str = "avg_rank",
                  limit: int = GROUP_CELLS, parts: int = PARTS) -> DataFrame:
    """One row per (group, value) with its row count ``n`` and tie-averaged rank."""
    keyed_df, keys = keyed(df.where(F.col(value).isNotNull()), group)
    cells = keyed_df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    out = cell_ranks(cells, keys, value, "n", rank, limit, parts)
    return out if group else out.drop(ALL)


def cell_ranks(cells: DataFrame, group: Sequence[str], value: str, count: str, rank: str,
               limit: int = GROUP_CELLS, parts: int = PARTS) -> DataFrame:
    """Adds the tie-averaged rank to one counted row per (group, value)."""
    placed = running_totals(cells, group, value, [count], limit, parts)
    middle = (F.col(count) + 1).cast("double") / F.lit(2.0)
    return placed.withColumn(rank, F.col(f"below_{count}").cast("double") + middle).drop(f"below_{count}")


def quantiles(df: DataFrame, value: str, probabilities: Sequence[float], group: Sequence[str] = (),
              limit: int = GROUP_CELLS, parts: int = PARTS) -> DataFrame:
    """Exact linear-interpolated quantiles, one row per (group, p) with column ``q``.

    Only the parts that hold a wanted position are ordered; the rest are just counted.
    """
    keyed_df, keys = keyed(df.where(F.col(value).isNotNull()), group)
    cells = keyed_df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    split = in_parts(cells, keys, value, ["n"], limit, parts).withColumn("__part", F.coalesce("__part", F.lit(0)))
    per_part = split.groupBy(*keys, "__part").agg(F.sum("n").alias("__n"))
    by_group = Window.partitionBy(*keys)
    earlier = by_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    positions = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    wanted = (
        per_part.withColumn("__base", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        .withColumn("__total", F.sum("__n").over(by_group))
        .withColumn("p", positions)
        .withColumn("__pos", F.col("p") * (F.col("__total") - 1).cast("double"))
        .withColumn("__low", F.floor("__pos"))
        .withColumn("__target", F.explode(F.array_distinct(F.array(F.col("__low"), F.ceil("__pos")))))
        .where((F.col("__target") >= F.col("__base")) & (F.col("__target") < F.col("__base") + F.col("__n")))
        .select(*keys, "__part", "__base", "p", "__pos", "__low", "__target")
    )
    before = Window.partitionBy(*keys, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        split.join(wanted.select(*keys, "__part").distinct(), [*keys, "__part"], "left_semi")
        .withColumn("__inside", F.coalesce(F.sum("n").over(before), F.lit(0)))
    )
    local = F.col("__target") - F.col("__base")
    hits = placed.join(wanted, [*keys, "__part"]).where((F.col("__inside") <= local) & (local < F.col("__inside") + F.col("n")))
    is_low = F.col("__target") == F.col("__low")
    low = F.max(F.when(is_low, F.col(value).cast("double")))
    high = F.coalesce(F.max(F.when(~is_low, F.col(value).cast("double"))), low)
    share = F.first(F.col("__pos") - F.col("__low"))
    found = hits.groupBy(*keys, "p").agg((low + (high - low) * share).alias("q"))
    return found if group else found.drop(ALL)


def bin_edges(df: DataFrame, value: str, probabilities: Sequence[float], group: Sequence[str] = (),
              limit: int = GROUP_CELLS, parts: int = PARTS) -> DataFrame:
    """The quantiles of each group as one ascending array ``edges`` (a few numbers per group)."""
    _, keys = keyed(df.limit(0), group)
    found, keys = keyed(quantiles(df, value, probabilities, group, limit, parts), group)
    ordered = F.array_sort(F.collect_list(F.struct("p", "q")))
    return found.groupBy(*keys).agg(F.transform(ordered, lambda s: s["q"]).alias("edges")).drop(ALL)


def _hash_placed(df: DataFrame, id_column: str, keys: Sequence[str], seed: object, limit: int, parts: int, prune: Column | None,
                 size: str | None = None) -> DataFrame:
    """Adds ``__place``, the 1-based position of a row in its group by hash of (seed, id).

    A group over ``limit`` rows is cut into equal hash ranges, so no task orders more than one range.
    ``size`` names a column with the rows of the group, where the caller has counted them; it is dropped.
    """
    if size is None:
        sized = df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")), list(keys))
    else:
        sized = df.withColumnRenamed(size, "__size")
    pieces = F.least(F.ceil(F.col("__size") / F.lit(float(limit))), F.lit(parts * 8)).cast("bigint")
    part = F.floor(F.col("__hash").cast("double") * pieces / F.lit(float(HASH_RANGE)))
    ranged = (
        sized.withColumn("__hash", hash32(id_column, seed=seed))
        .withColumn("__part", F.when(F.col("__size") > limit, part))
    )
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = ranged.where(F.col("__size") > limit).groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    bases = per_part.select(*keys, "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    based = ranged.drop("__size").join(bases, [*keys, "__part"], "left").withColumn("__base", F.coalesce("__base", F.lit(0)))
    if prune is not None:
        based = based.where(prune)
    if size is not None:  # rows that the caller made of few lie in few tasks
        based = based.repartition(*keys, "__part")
    order = Window.partitionBy(*keys, "__part").orderBy("__hash", id_column)
    return based.withColumn("__place", F.row_number().over(order) + F.col("__base")).drop("__hash", "__part", "__base")


def take_by_hash(df: DataFrame, id_column: str, by: Sequence[str], count: Column, seed: object = 0,
                 limit: int = GROUP_CELLS, parts: int = PARTS) -> DataFrame:
    """keep the ``count`` rows of each group with the smallest hash of (seed, id).

    ``count`` may use columns that are constant in a group.  Hash ranges past the boundary are
    dropped before anything is ordered.
    """
    rows, keys = keyed(df, by)
    rows = rows.withColumn("__want", count.cast("bigint"))
    placed = _hash_placed(rows, id_column, keys, seed, limit, parts, F.col("__base") < F.col("__want"))
    return placed.where(F.col("__place") <= F.col("__want")).drop("__want", "__place", ALL)


def mark_by_hash(df: DataFrame, id_column: str, by: Sequence[str], count: Column, name: str, seed: object = 0,
                 limit: int = GROUP_CELLS, parts: int = PARTS, size: str | None = None) -> DataFrame:
    """All rows, with a flag on the ones ``take_by_hash`` would keep; ``size`` names the counts of the groups, if known."""
    rows, keys = keyed(df, by)
    placed = _hash_placed(rows, id_column, keys, seed, limit, parts, None, size)
    return placed.withColumn(name, F.col("__place") <= count).drop("__place", ALL)


def top_per_group(df: DataFrame, n: int, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First ``n`` rows of each group; Spark trims each map task to ``n`` per group before the shuffle."""
    keyed_df, keys = keyed(df, group)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return keyed_df.withColumn("place", place).where(F.col("place") <= n).drop(ALL)


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row.

    For values an expression uses many times or hands to an Arrow UDF; a scalar subquery would be
    planned again at every use.
    """
    return df.withColumn("__one", F.lit(0)).join(F.broadcast(one_row.withColumn("__one", F.lit(0))), "__one").drop("__one")

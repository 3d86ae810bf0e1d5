"""Signal metrics: rank agreement, intervals, nulls, tables by bin and by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerscope.functions.hashing import draw_sums
from answerscope.operators import order
from answerscope.operators.order import ALL, keyed
from answerscope.session import cut_lineage


def _zero_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


# ---- AUROC ------------------------------------------------------------------
def auroc(df: DataFrame, score: str, positive: Column, group: Sequence[str] = (),
          limit: int = order.GROUP_CELLS, parts: int = order.PARTS) -> DataFrame:
    """Probability that a positive row outscores a negative one, ties 0.5, per group.

    Groups lacking a class are dropped.  A pair count splits over parts: pairs inside a part
    plus the part's positives times all negatives of lower parts, so nothing is joined back.
    """
    labelled = df.where(F.col(score).isNotNull() & positive.isNotNull()).withColumn("__hit", positive.cast("boolean"))
    labelled, keys = keyed(labelled, group)
    cells = labelled.groupBy(*keys, score).agg(
        F.count_if("__hit").alias("__pos"), F.count_if(~F.col("__hit")).alias("__neg"))
    split = order.in_parts(cells, keys, score, ["__pos", "__neg"], limit, parts)
    before = Window.partitionBy(*keys, "__part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("__neg").over(before), F.lit(0)).cast("double") + F.col("__neg").cast("double") / F.lit(2.0)
    per_part = (
        split.withColumn("__wins", F.col("__pos").cast("double") * lower)
        .groupBy(*keys, "__part")
        .agg(F.sum("__wins").alias("__wins"), F.sum("__pos").alias("__pos"), F.sum("__neg").alias("__neg"))
    )
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("__neg").over(earlier), F.lit(0)).cast("double")
    return (
        per_part.withColumn("__pairs_won", F.col("__wins") + F.col("__pos").cast("double") * base)
        .groupBy(*keys)
        .agg(F.sum("__pos").alias("positives"), F.sum("__neg").alias("negatives"), F.sum("__pairs_won").alias("__pairs_won"))
        .where((F.col("positives") > 0) & (F.col("negatives") > 0))
        .withColumn("auc", F.col("__pairs_won") / (F.col("positives").cast("double") * F.col("negatives").cast("double")))
        .drop("__pairs_won", ALL)
    )


def pair_auroc(df: DataFrame, score: str, kind: str, first: str, second: str, group: Sequence[str] = (), **kw) -> DataFrame:
    """Only rows of two named types; the second one is the positive class."""
    rows = df.where(F.col(kind).isin(first, second))
    return auroc(rows, score, F.col(kind) == second, group, **kw)


def mean_over_groups(per_group: DataFrame, by: Sequence[str] = (), value: str = "auc") -> DataFrame:
    """Plain mean over groups and how many there were."""
    return per_group.groupBy(*by).agg(F.avg(value).alias("mean_auc"), F.count(value).alias("n_groups"))


def floored_mean(per_group: DataFrame, floor: int, weighted: bool = True) -> DataFrame:
    """Groups with at least ``floor`` rows of each class, mean weighted by rows or plain."""
    kept = per_group.where((F.col("positives") >= floor) & (F.col("negatives") >= floor))
    weight = (F.col("positives") + F.col("negatives")).cast("double") if weighted else F.lit(1.0)
    return kept.agg(
        (F.sum(F.col("auc") * weight) / _zero_to_null(F.sum(weight))).alias("mean_auc"),
        F.count(F.lit(1)).alias("n_groups"))


# ---- resampling -------------------------------------------------------------
def bootstrap_draws(values: DataFrame, unit: Sequence[str], value: str, draws: int, by: Sequence[str] = (),
                    seed: object = 1) -> DataFrame:
    """One resampled mean per draw: every unit is drawn Poisson(1) times, by hash of (seed, draw, unit).

    The draws are summed in the tasks, so the shuffle carries ``draws`` rows per task.
    """
    sums = draw_sums(values.where(F.col(value).isNotNull()), draws, {"__sum": F.col(value), "__w": F.lit(1.0)}, *unit, by=by, seed=seed)
    return sums.select(*by, "draw", (F.col("__sum") / _zero_to_null(F.col("__w"))).alias("mean"))


def interval(draws: DataFrame, by: Sequence[str] = (), value: str = "mean", low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval over the draws (a fixed number of rows per group)."""
    return draws.groupBy(*by).agg(F.percentile(value, F.lit(low)).alias("lo"), F.percentile(value, F.lit(high)).alias("hi"))


def bootstrap_mean(values: DataFrame, unit: Sequence[str], value: str, draws: int = 1000, by: Sequence[str] = (),
                   seed: object = 1) -> DataFrame:
    """Mean over groups with a 95% interval."""
    spread, keys = keyed(interval(bootstrap_draws(values, unit, value, draws, by, seed), by), by)
    centre, _ = keyed(values.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n_groups")), by)
    return centre.join(spread, keys).drop(ALL)


def shuffled_labels(df: DataFrame, row_id: str, group: Sequence[str], positive: Column, draws: int, seed: object = 100,
                    limit: int = order.GROUP_CELLS) -> DataFrame:
    """For each draw, the same number of positives per group on randomly chosen rows.

    Choosing the p rows with the smallest hash is a uniform relabelling, so only one order
    per group and draw is needed.  Output: the rows times ``draws`` with ``draw`` and ``shuffled``.
    All draws of a group have its size, so groups are counted before they are drawn.  The counted rows are cut
    from their lineage, as every branch of the order, and of what follows, would plan it again on the driver.
    """
    labelled = df.withColumn("__y", positive.cast("int"))
    sizes = labelled.groupBy(*group).agg(F.sum("__y").alias("__p"), F.count(F.lit(1)).alias("__size"))
    drawn = (
        cut_lineage(labelled.drop("__y").join(sizes, list(group)))
        .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        .withColumn("__key", F.concat_ws(":", F.col("draw").cast("string"), F.col(row_id).cast("string")))
    )
    return order.mark_by_hash(drawn, "__key", [*group, "draw"], F.col("__p"), "shuffled", seed, limit, size="__size").drop("__key", "__p")


def null_summary(per_draw: DataFrame, value: str = "mean_auc") -> DataFrame:
    """Mean and population spread over the permutation draws."""
    return per_draw.agg(F.avg(value).alias("null_mean"), F.stddev_pop(value).alias("null_std"), F.count(value).alias("draws"))


# ---- correlation ------------------------------------------------------------
def spearman(df: DataFrame, x: str, y: str, group: Sequence[str] = (),
             limit: int = order.GROUP_CELLS, parts: int = order.PARTS) -> DataFrame:
    """Pearson correlation of tie-averaged ranks, per group, with row count ``n`` and distinct y ``n_y``."""
    rows, keys = keyed(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), group)
    # everything below reads the counted pairs, so the rows are read and shuffled once
    pairs = rows.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("__n"))
    size = pairs.groupBy(*keys).agg(F.sum("__n").alias("__size"))

    def ranks(v: str, name: str) -> DataFrame:
        cells = pairs.groupBy(*keys, v).agg(F.sum("__n").alias("__c"))
        return order.cell_ranks(cells, keys, v, "__c", name, limit, parts).select(*keys, v, name)

    ranks_x, ranks_y = ranks(x, "__rx"), ranks(y, "__ry")
    centre = (F.col("__size") + 1).cast("double") / F.lit(2.0)
    n = F.col("__n").cast("double")
    ranked = (
        pairs.join(ranks_x, [*keys, x]).join(ranks_y, [*keys, y]).join(size, keys)
        .withColumn("__dx", F.col("__rx") - centre).withColumn("__dy", F.col("__ry") - centre)
    )
    return (
        ranked.groupBy(*keys)
        .agg(F.sum("__n").alias("n"), F.count_distinct(y).alias("n_y"),
             F.sum(n * F.col("__dx") * F.col("__dy")).alias("__xy"),
             F.sum(n * F.col("__dx") * F.col("__dx")).alias("__xx"),
             F.sum(n * F.col("__dy") * F.col("__dy")).alias("__yy"))
        .withColumn("rho", F.col("__xy") / _zero_to_null(F.sqrt(F.col("__xx") * F.col("__yy"))))
        .drop("__xy", "__xx", "__yy", ALL)
    )


def grouped_spearman(df: DataFrame, x: str, y: str, group: Sequence[str], min_rows: int = 200, min_levels: int = 3, **kw) -> DataFrame:
    """Row-weighted mean of the in-group correlation over large, varied groups."""
    per = spearman(df, x, y, group, **kw).where((F.col("n") >= min_rows) & (F.col("n_y") >= min_levels))
    return per.agg((F.sum(F.col("rho") * F.col("n")) / _zero_to_null(F.sum("n").cast("double"))).alias("mean_rho"),
                   F.count(F.lit(1)).alias("n_groups"))


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """M12."""
    return df.groupBy(*by).agg(F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("r"), F.count(F.lit(1)).alias("n"))


# ---- tables -----------------------------------------------------------------
def confusion(df: DataFrame, truth: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """Row-normalised confusion, recall per true class and the balanced accuracy on every row."""
    counts = df.groupBy(truth).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(predicted) == c).cast("double").alias(f"pred_{c}") for c in classes],
        F.count_if(F.col(predicted) == F.col(truth)).cast("double").alias("__hit"))
    share = [(F.col(f"pred_{c}") / F.col("n")).alias(f"pred_{c}") for c in classes]
    recall = counts.select(truth, "n", *share, (F.col("__hit") / F.col("n")).alias("recall"))
    # one row per class, so the window holds a fixed handful of rows
    return recall.withColumn("balanced_accuracy", F.avg("recall").over(Window.partitionBy(F.lit(0))))


def cell_summary(df: DataFrame, value: str, by: Sequence[str], floor: int = 20, **kw) -> DataFrame:
    """Mean and median per cell; cells under ``floor`` rows are left out."""
    stats = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean")).where(F.col("n") >= floor)
    medians = order.quantiles(df, value, [0.5], by, **kw).select(*by, F.col("q").alias("median"))
    return stats.join(medians, list(by))


def reference_scaled(df: DataFrame, value: str, low_rows: Column, high_rows: Column, name: str = "position", **kw) -> DataFrame:
    """(value - median of the low group) / (median of the high group - median of the low group)."""
    low = order.quantiles(df.where(low_rows), value, [0.5], **kw).select("q").scalar()
    high = order.quantiles(df.where(high_rows), value, [0.5], **kw).select("q").scalar()
    both = df.withColumn("__low", low).withColumn("__high", high)
    return both.withColumn(name, (F.col(value) - F.col("__low")) / _zero_to_null(F.col("__high") - F.col("__low"))).drop("__low", "__high")


def with_quantile_bin(df: DataFrame, value: str, probabilities: Sequence[float], name: str, fit_on: DataFrame | None = None,
                      closed_ends: bool = True, **kw) -> DataFrame:
    """Left-closed bin number between exact quantiles.

    ``closed_ends``: the probabilities include 0 and 1 and outside values go to the end bins;
    otherwise the bins run below, between and above the given quantiles.
    """
    edges = order.bin_edges(fit_on if fit_on is not None else df, value, probabilities, **kw).select(F.col("edges").alias("__edges"))
    carried = order.attach_one_row(df, edges)
    passed = sum((F.coalesce(F.col(value) >= F.get("__edges", F.lit(i)), F.lit(False)).cast("int") for i in range(len(probabilities))), F.lit(0))
    if closed_ends:
        passed = F.greatest(F.least(passed - 1, F.lit(len(probabilities) - 2)), F.lit(0))
    return carried.withColumn(name, passed).drop("__edges")


def decile_table(df: DataFrame, value: str, k: str, kind: str, fit_on: DataFrame | None = None, **kw) -> DataFrame:
    """Mean k and answer-type shares per decile, and the broken share of the wrong rows."""
    binned = with_quantile_bin(df, value, [i / 10 for i in range(11)], "bin", fit_on, **kw)

    def share(t):
        return F.avg((F.col(kind) == t).cast("double"))

    wrong = F.when(F.col(kind) != "correct", (F.col(kind) == "broken").cast("double"))
    return binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(k).alias("mean_k"), share("correct").alias("correct"), share("entity").alias("entity"),
        share("broken").alias("broken"), share("abstain").alias("abstain"), F.avg(wrong).alias("broken_of_wrong"))


def quintile_share(df: DataFrame, value: str, condition: Column, **kw) -> DataFrame:
    """Share of rows meeting a condition per quintile of a value."""
    binned = with_quantile_bin(df, value, [0.2, 0.4, 0.6, 0.8], "bin", closed_ends=False, **kw)
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(condition.cast("double")).alias("share"))


def cumulative_share(df: DataFrame, value: str, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Share of rows with value <= s, one output row per threshold; one pass over the input."""
    names = [f"t{i}" for i in range(len(thresholds))]
    wide = df.groupBy(*by).agg(*[F.avg((F.col(value) <= t).cast("double")).alias(n) for n, t in zip(names, thresholds)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(n).alias("share")) for n, t in zip(names, thresholds)]))
    return wide.select(*by, rows.alias("__r")).select(*by, "__r.threshold", "__r.share")


def summary_row(df: DataFrame, value: str, by: Sequence[str] = (), early: float = 8, **kw) -> DataFrame:
    """N, median, mean and the share below ``early``."""
    medians, keys = keyed(order.quantiles(df, value, [0.5], by, **kw), by)
    stats, _ = keyed(df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.avg((F.col(value) < early).cast("double")).alias("share_early")), by)
    return stats.join(medians.select(*keys, F.col("q").alias("median")), keys).drop(ALL)


def category_mix(df: DataFrame, category: str, first: Column, second: Column) -> DataFrame:
    """Share of rows per category in two row groups."""
    counts = df.groupBy(category).agg(F.count_if(first).alias("__a"), F.count_if(second).alias("__b"))
    totals = df.agg(F.count_if(first).cast("double").alias("a"), F.count_if(second).cast("double").alias("b"))
    return (
        counts.withColumn("__ta", totals.select("a").scalar()).withColumn("__tb", totals.select("b").scalar())
        .where((F.col("__a") > 0) | (F.col("__b") > 0))
        .select(category, (F.col("__a") / F.col("__ta")).alias("share_first"), (F.col("__b") / F.col("__tb")).alias("share_second"))
        .orderBy(F.desc("share_first"), category)
    )


def best_per_family(scores: DataFrame, family: Column, name: str, score: str, position: str) -> DataFrame:
    """The configuration with the highest score per family; the earlier one wins a tie."""
    return scores.groupBy(family.alias("family")).agg(
        F.max_by(name, F.struct(F.col(score), -F.col(position))).alias("picked"), F.max(score).alias("best"))


def prefix_summary(shares: DataFrame, condition: str, value: str, pattern: str = r"^(.*?) #\d+$") -> DataFrame:
    """Mean, min and max over conditions named '<prefix> #<draw>'."""
    return (
        shares.withColumn("prefix", F.regexp_extract(condition, pattern, 1)).where(F.col("prefix") != "")
        .groupBy("prefix").agg(F.count(F.lit(1)).alias("n_draws"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    )


def with_pooled(df: DataFrame, group: str, aggregates: Sequence[Column], pooled: str = "all") -> DataFrame:
    """Per-group rows plus one pooled row, in a single pass with grouping sets."""
    label = F.when(F.grouping(group) == 1, F.lit(pooled)).otherwise(F.col(group).cast("string"))
    return df.rollup(group).agg(label.alias("__label"), *aggregates).drop(group).withColumnRenamed("__label", group)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct counts, one row per column name.

    Each column is deduplicated on its own, so rows are not multiplied by the number of columns.
    """
    out = None
    for c in columns:
        one = df.select(c).where(F.col(c).isNotNull()).distinct().agg(F.lit(c).alias("name"), F.count(F.lit(1)).alias("n_distinct"))
        out = one if out is None else out.unionByName(one)
    return out


def active_per_row(acts: DataFrame, rows: DataFrame) -> DataFrame:
    """Mean number of active features per row; rows with none still count."""
    n_rows = rows.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    return acts.where(F.col("a") > 0).agg(F.count(F.lit(1)).alias("active")).withColumn("rows", n_rows).withColumn(
        "active_per_row", F.col("active") / F.col("rows"))

"""Vector analytics on dense states ``(row_id, ..., h array<float>)``.

Directions are weighted sums over rows: a within-fact mean difference averaged over facts
equals one global sum with row weights +-1/n, so no per-fact vector is built or shuffled
unless the per-fact vectors are the result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscope.functions import vectors as V
from answerscope.operators import order
from answerscope.operators.dictionaries import Dictionary, encode, reconstruct, remove_features, set_energy  # noqa: F401
from answerscope.operators.order import ALL, keyed


def _vec(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return array_to_vector(c.cast("array<double>"))


def mean_vectors(df: DataFrame, by: Sequence[str] = (), vector: str = "h", name: str = "mean") -> DataFrame:
    """Mean vector and row count per group, combined map-side."""
    return df.groupBy(*by).agg(vector_to_array(Summarizer.mean(_vec(vector))).alias(name), F.count(F.lit(1)).alias("n"))


def weighted_sum(df: DataFrame, weight: str, by: Sequence[str] = (), vector: str = "h", name: str = "v") -> DataFrame:
    """Sum of weight * vector per group for weights of any sign.

    ``Summarizer`` takes non-negative weights, so the two signs are summed apart and subtracted;
    that leaves one small vector pair per group.
    """
    keyed_df, keys = keyed(df.where(F.col(weight) != 0), by)
    signed = keyed_df.withColumn("__up", F.col(weight) > 0).withColumn("__abs", F.abs(F.col(weight)).cast("double"))
    parts = signed.groupBy(*keys, "__up").agg(vector_to_array(Summarizer.sum(_vec(vector), F.col("__abs"))).alias("__s"))
    both = parts.groupBy(*keys).agg(
        F.first(F.when(F.col("__up"), F.col("__s")), ignorenulls=True).alias("__p"),
        F.first(F.when(~F.col("__up"), F.col("__s")), ignorenulls=True).alias("__m"))
    nothing = F.transform(F.coalesce("__p", "__m"), lambda x: F.lit(0.0))
    out = both.withColumn(name, V.subtract(F.coalesce("__p", nothing), F.coalesce("__m", nothing))).drop("__p", "__m")
    return out if by else out.drop(ALL)


def within_fact_weights(rows: DataFrame, first: Column, second: Column, fact: str = "fact", draw: Sequence[str] = ()) -> DataFrame:
    """Row weights +1/n_first and -1/n_second inside facts that hold both kinds; other rows drop out."""
    flagged = rows.withColumn("__a", first).withColumn("__b", second)
    sizes = flagged.groupBy(fact, *draw).agg(F.count_if("__a").cast("double").alias("__na"), F.count_if("__b").cast("double").alias("__nb"))
    both = sizes.where((F.col("__na") > 0) & (F.col("__nb") > 0))
    w = F.when(F.col("__a"), F.lit(1.0) / F.col("__na")).when(F.col("__b"), F.lit(-1.0) / F.col("__nb"))
    return flagged.join(both, [fact, *draw]).withColumn("w", w).where(F.col("w").isNotNull()).drop("__a", "__b", "__na", "__nb")


def centred(df: DataFrame, by: Sequence[str] = ("fact",), vector: str = "h", name: str = "centred") -> DataFrame:
    """Subtract the group mean vector."""
    means = mean_vectors(df, by, vector, "__mean").drop("n")
    return df.join(means, list(by)).withColumn(name, V.subtract(F.col(vector).cast("array<double>"), F.col("__mean"))).drop("__mean")


def within_fact_direction(rows: DataFrame, first: Column, second: Column, by: Sequence[str] = (), vector: str = "h",
                          draw: Sequence[str] = ()) -> DataFrame:
    """Mean over facts of mean(first) - mean(second), unit length; columns direction, size, n_facts.

    ``by`` must be constant inside a fact (and draw).
    """
    weighted = within_fact_weights(rows, first, second, draw=draw)
    keyed_df, keys = keyed(weighted, by)
    n_facts = keyed_df.select(*keys, "fact", *draw).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_facts"))
    sums = weighted_sum(keyed_df, "w", keys, vector)
    mean = V.scale_by(F.col("v"), F.lit(1.0) / F.col("n_facts"))
    return (
        sums.join(n_facts, keys).withColumn("mean", mean)
        .withColumn("size", V.norm(F.col("mean"))).withColumn("direction", V.unit(F.col("mean"))).drop("v", ALL)
    )


def pooled_direction(rows: DataFrame, first: Column, second: Column, by: Sequence[str] = (), vector: str = "h") -> DataFrame:
    """mean(first) - mean(second) over all rows (per group), with the two row counts."""
    keyed_df, keys = keyed(rows.where(first | second).withColumn("__a", first), by)
    parts = mean_vectors(keyed_df, [*keys, "__a"], vector)
    a = parts.where("__a").select(*keys, F.col("mean").alias("__ma"), F.col("n").alias("n_first"))
    b = parts.where("not __a").select(*keys, F.col("mean").alias("__mb"), F.col("n").alias("n_second"))
    return a.join(b, keys).withColumn("mean", V.subtract(F.col("__ma"), F.col("__mb"))).withColumn("size", V.norm(F.col("mean"))).withColumn(
        "direction", V.unit(F.col("mean"))).drop("__ma", "__mb", ALL)


def within_category_direction(rows: DataFrame, first: Column, second: Column, category: str = "relation", floor: int = 20,
                              vector: str = "h") -> DataFrame:
    """In-category differences averaged with weight min(n_first, n_second), both at least ``floor``."""
    per = pooled_direction(rows, first, second, [category], vector)
    kept = per.where((F.col("n_first") >= floor) & (F.col("n_second") >= floor)).withColumn("w", F.least("n_first", "n_second").cast("double"))
    total = kept.agg(F.sum("w").alias("__t"), F.count(F.lit(1)).alias("n_categories"))
    summed = order.attach_one_row(weighted_sum(kept, "w", (), "mean"), total)
    return summed.withColumn("mean", V.scale_by(F.col("v"), F.lit(1.0) / F.col("__t"))).withColumn("size", V.norm(F.col("mean"))).withColumn(
        "direction", V.unit(F.col("mean"))).drop("v", "__t")


def orthogonal_to(df: DataFrame, vector: str, direction: str, name: str = "control") -> DataFrame:
    """Vector minus its part along a unit direction."""
    along = V.dot(F.col(vector), F.col(direction))
    return df.withColumn("__c", -along).withColumn(name, V.add_scaled(F.col(vector), F.col(direction), F.col("__c"))).drop("__c")


def _group_pairs(groups: DataFrame, key: str, levels: Sequence[int], columns: dict[str, str]) -> DataFrame:
    """Every two of a few named groups side by side, by an equi join on the named partner."""
    left = groups.select(F.col(key).alias("first"), *[F.col(c).alias(f"{n}_first") for n, c in columns.items()],
                         F.explode(F.array(*[F.lit(x) for x in levels])).alias("second"))
    right = groups.select(F.col(key).alias("second"), *[F.col(c).alias(f"{n}_second") for n, c in columns.items()])
    return left.where(F.col("first") <= F.col("second")).join(right, "second")


def direction_cosines(directions: DataFrame, key: str, levels: Sequence[int], vector: str = "direction") -> DataFrame:
    """Cosine of every two of the named group directions."""
    pairs = _group_pairs(directions, key, levels, {"v": vector}).where(F.col("first") < F.col("second"))
    return pairs.select("first", "second", V.cosine(F.col("v_first"), F.col("v_second")).alias("cosine"))


def split_half_cosine(rows: DataFrame, first: Column, second: Column, by: str, draws: int = 20, seed: object = 0, vector: str = "h") -> DataFrame:
    """Cosine between the directions of two random halves of the facts, per group and draw."""
    weighted = within_fact_weights(rows, first, second)
    facts = weighted.select("fact", by).distinct()
    halves = facts.groupBy(by).agg(F.floor(F.count(F.lit(1)) / F.lit(2)).alias("__half"))
    drawn = facts.join(halves, by).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn(
        "__key", F.concat_ws(":", F.col("draw").cast("string"), F.col("fact").cast("string")))
    chosen = order.take_by_hash(drawn, "__key", [by, "draw"], F.col("__half"), seed).select("fact", "draw", F.lit(1).alias("__in"))
    sided = drawn.join(chosen, ["fact", "draw"], "left").select("fact", "draw", F.coalesce("__in", F.lit(0)).alias("side"))
    sums = weighted_sum(weighted.join(sided, "fact"), "w", [by, "draw", "side"], vector)
    one = sums.where("side = 1").select(by, "draw", F.col("v").alias("__a"))
    two = sums.where("side = 0").select(by, "draw", F.col("v").alias("__b"))
    return one.join(two, [by, "draw"]).select(by, "draw", V.cosine(F.col("__a"), F.col("__b")).alias("cosine"))


def fact_differences(rows: DataFrame, first: Column, second: Column, keep: Sequence[str] = ("k_correct",), vector: str = "h",
                     draw: Sequence[str] = ()) -> DataFrame:
    """Per-fact mean(first) - mean(second) as column ``d``; ``keep`` columns are constant inside a fact."""
    weighted = within_fact_weights(rows, first, second, draw=draw)
    return weighted_sum(weighted, "w", ["fact", *keep, *draw], vector, "d")


def pairwise_cosine_means(differences: DataFrame, levels: Sequence[int], by: str = "k_correct", vector: str = "d") -> DataFrame:
    """Mean cosine over all pairs of different facts, for every two groups, without forming a pair.

    Off the diagonal the mean is s_a . s_b / (n_a n_b) with s the sum of unit vectors; on it
    (|s|^2 - n) / (n (n - 1)).
    """
    units = differences.withColumn("__u", V.unit(F.col(vector)))
    sums = units.groupBy(by).agg(vector_to_array(Summarizer.sum(_vec("__u"))).alias("__s"), F.count(F.lit(1)).cast("double").alias("__n"))
    pairs = _group_pairs(sums, by, levels, {"s": "__s", "n": "__n"}).withColumn("__dot", V.dot(F.col("s_first"), F.col("s_second")))
    same = (F.col("__dot") - F.col("n_first")) / F.nullif(F.col("n_first") * (F.col("n_first") - 1), F.lit(0.0))
    other = F.col("__dot") / (F.col("n_first") * F.col("n_second"))
    return pairs.select("first", "second", "n_first", "n_second", F.when(F.col("first") == F.col("second"), same).otherwise(other).alias("mean_cosine"))


def leave_one_out(differences: DataFrame, vector: str = "d") -> DataFrame:
    """Cosine, projection and energy share of each fact along the mean of all other facts.

    Total minus self: the one total vector is attached to every row, no self join.
    """
    totals = differences.agg(vector_to_array(Summarizer.sum(_vec(vector))).alias("__s"))
    others = V.subtract(F.col("__s"), F.col(vector))
    out = order.attach_one_row(differences, totals).withColumn("__o", V.unit(others))
    out = out.withColumn("size", V.norm(F.col(vector))).withColumn("projection", V.dot(F.col(vector), F.col("__o")))
    cosine = F.col("projection") / F.nullif(F.col("size"), F.lit(0.0))
    return out.withColumn("cosine", cosine).withColumn("energy_share", cosine * cosine).drop("__s", "__o")


def projection(rows: DataFrame, directions: DataFrame, on: str = "fold", vector: str = "h", name: str = "axis") -> DataFrame:
    """H . direction of the row's fold; one direction per fold, a fixed few rows, so broadcast."""
    carried = directions.select(on, F.col("direction").alias("__d"))
    return rows.join(F.broadcast(carried), on).withColumn(name, V.dot(F.col(vector).cast("array<double>"), F.col("__d"))).drop("__d")


# ---- edits ------------------------------------------------------------------
def add_direction(df: DataFrame, direction: Column, amount: Column, vector: str = "h", name: str = "edited") -> DataFrame:
    """H + amount * direction."""
    return df.withColumn(name, V.add_scaled(F.col(vector).cast("array<double>"), direction, amount.cast("double")))


def remove_along(df: DataFrame, direction: Column, offset: float = 0.0, vector: str = "h", name: str = "edited") -> DataFrame:
    """H - ((h . d) - offset) d for a unit direction; offset 0 removes the direction."""
    along = V.dot(F.col(vector).cast("array<double>"), direction)
    return df.withColumn("__amount", F.lit(float(offset)) - along).withColumn(
        name, V.add_scaled(F.col(vector).cast("array<double>"), direction, F.col("__amount"))).drop("__amount")


def replace_by_donor(targets: DataFrame, states: DataFrame, donor: str = "donor", vector: str = "h", name: str = "edited") -> DataFrame:
    """The donor row's vector, the row's own where there is no donor."""
    given = states.select(F.col("row_id").alias(donor), F.col(vector).alias("__h"))
    return targets.join(given, donor, "left").withColumn(name, F.coalesce(F.col("__h"), F.col(vector))).drop("__h")


def donor_distance(targets: DataFrame, states: DataFrame, donor: str = "donor", vector: str = "h") -> DataFrame:
    """Mean distance between a row's vector and its donor's."""
    given = states.select(F.col("row_id").alias(donor), F.col(vector).alias("__h"))
    pairs = targets.join(given, donor).select(V.distance(F.col(vector), F.col("__h")).alias("d"))
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_distance"))


# ---- feature dictionaries, see ``dictionaries`` --------------------------------
def unexplained_share(reconstructed: DataFrame, vector: str = "h") -> DataFrame:
    """Sum |h - r|^2 / sum |h - mean h|^2 and the mean cosine of h and r.

    The total spread is sum |h|^2 - n |mean h|^2, so one pass is enough.
    """
    h = F.col(vector).cast("array<double>")
    parts = reconstructed.select(
        _vec(vector).alias("__h"), V.dot(F.col("e"), F.col("e")).alias("__ee"), V.dot(h, h).alias("__hh"), V.cosine(h, F.col("r")).alias("__c"))
    sums = parts.agg(
        vector_to_array(Summarizer.mean(F.col("__h"))).alias("__m"), F.count(F.lit(1)).alias("n"),
        F.sum("__ee").alias("__ee"), F.sum("__hh").alias("__hh"), F.avg("__c").alias("mean_cosine"))
    spread = F.col("__hh") - F.col("n") * V.dot(F.col("__m"), F.col("__m"))
    return sums.withColumn("__spread", spread).select("n", (F.col("__ee") / F.nullif(F.col("__spread"), F.lit(0.0))).alias("fvu"), "mean_cosine")


def removed_share(states: DataFrame, bases: dict[int, np.ndarray], vector: str = "h") -> DataFrame:
    """Mean of |Q'h|^2 / |h|^2 for several bases at once, one row per draw; states are read once."""
    shared = states.sparkSession.sparkContext.broadcast(bases)

    def run(batches):
        sums = {}
        for batch in batches:
            if len(batch):
                x = np.stack(batch[vector].to_numpy()).astype(np.float64)
                size = (x * x).sum(1)
                for draw, q in shared.value.items():
                    share = ((x @ q) ** 2).sum(1)[size > 0] / size[size > 0]
                    total, n = sums.get(draw, (0.0, 0))
                    sums[draw] = (total + share.sum(), n + len(share))
        yield pd.DataFrame([(d, t, n) for d, (t, n) in sums.items()], columns=["draw", "total", "n"])

    partial = states.select(vector).mapInPandas(run, "draw int, total double, n long")
    return partial.groupBy("draw").agg((F.sum("total") / F.sum("n")).alias("energy"))


def remove_basis(states: DataFrame, basis: np.ndarray, vector: str = "h") -> DataFrame:
    """H - QQ'h, replacing the vector column."""
    shared = states.sparkSession.sparkContext.broadcast(basis)

    @F.pandas_udf("array<double>")
    def project_out(h: pd.Series) -> pd.Series:
        x = np.stack(h.to_numpy()).astype(np.float64)
        q = shared.value
        return pd.Series(list(x - (x @ q) @ q.T))

    return states.withColumn(vector, project_out(F.col(vector)))


def edit_effect(before: DataFrame, after: DataFrame, latents: Sequence[int], n_rows: DataFrame) -> DataFrame:
    """Share ON and mean activation of a feature set before and after an edit."""
    total = n_rows.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()

    def one(acts, label):
        kept = acts.where(F.col("latent").isin([int(x) for x in latents]))
        return kept.agg(F.lit(label).alias("state"), F.count(F.lit(1)).cast("double").alias("on"), F.coalesce(F.sum("a"), F.lit(0.0)).alias("s"))

    both = one(before, "before").unionByName(one(after, "after")).withColumn("__n", total * F.lit(float(len(latents))))
    return both.select("state", (F.col("on") / F.col("__n")).alias("share_on"), (F.col("s") / F.col("__n")).alias("mean_activation"))


# ---- steps and slots --------------------------------------------------------
def concat_steps(states: DataFrame, row: str, step: str, steps: Sequence[int], vector: str = "h", name: str = "h_all") -> DataFrame:
    """Vectors of the given steps, in order, as one; rows lacking a step are left out."""
    wide = states.groupBy(row).pivot(step, list(steps)).agg(F.first(vector))
    columns = [F.col(str(s)) for s in steps]
    return wide.dropna(subset=[str(s) for s in steps]).select(row, F.concat(*columns).alias(name))


def slot_features(slots: DataFrame, steps: Sequence[int]) -> DataFrame:
    """Mean and smallest log-probability and margin over slots, one column set per step."""
    wide = slots.where(F.col("step").isin(list(steps))).groupBy("row_id").pivot("step", list(steps))
    return wide.agg(F.avg("lp").alias("lp_mean"), F.min("lp").alias("lp_min"), F.avg("mg").alias("mg_mean"), F.min("mg").alias("mg_min"))


def logit_summary(df: DataFrame, logits: str) -> DataFrame:
    """Log-probability of the most likely token and its lead over the second."""
    values = F.col(logits).cast("array<double>")
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    second = F.get(F.sort_array(values, asc=False), F.lit(1))
    return df.withColumn("top_logprob", -F.log(total)).withColumn("margin", top - second)

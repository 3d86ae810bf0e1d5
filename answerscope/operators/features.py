"""Feature selection over sparse activations ``acts(row_id, latent, a)``.

A missing row means the feature is off.  Group sizes therefore always come from the
row table, and every statistic is a sum over the active entries divided by them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerscope.functions.hashing import hash32
from answerscope.operators import order
from answerscope.session import cut_lineage

KINDS = ("correct", "entity", "broken")


def _d(c: Column) -> Column:
    return c.cast("double")


def _when_sum(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))


def _per(total: Column, n: Column) -> Column:
    return total / F.nullif(n, F.lit(0.0))


# ---- two row groups ---------------------------------------------------------
def contrast(acts: DataFrame, rows: DataFrame, first: Column, second: Column) -> DataFrame:
    """Firing rates of two row groups per feature and their contrasts.

    One pass over the active entries; ``rows`` needs ``row_id`` and what the conditions use.
    """
    flags = rows.select("row_id", first.alias("__a"), second.alias("__b"))
    sizes = flags.agg(_d(F.count_if("__a")).alias("na"), _d(F.count_if("__b")).alias("nb"), _d(F.count(F.lit(1))).alias("n"))
    hits = acts.where(F.col("a") > 0).join(flags, "row_id")
    a = _d(F.col("a"))
    sums = hits.groupBy("latent").agg(
        _d(F.count(F.lit(1))).alias("__on"),
        _d(F.count_if("__a")).alias("__on_a"), _d(F.count_if("__b")).alias("__on_b"),
        _when_sum(F.col("__a"), a).alias("__s_a"), _when_sum(F.col("__b"), a).alias("__s_b"),
        _when_sum(F.col("__a"), a * a).alias("__q_a"), _when_sum(F.col("__b"), a * a).alias("__q_b"))
    sized = (
        sums.withColumn("__na", sizes.select("na").scalar()).withColumn("__nb", sizes.select("nb").scalar())
        .withColumn("__n", sizes.select("n").scalar())
    )
    mean_a, mean_b = _per(F.col("__s_a"), F.col("__na")), _per(F.col("__s_b"), F.col("__nb"))
    var_a = F.greatest(_per(F.col("__q_a"), F.col("__na")) - mean_a * mean_a, F.lit(0.0))
    var_b = F.greatest(_per(F.col("__q_b"), F.col("__nb")) - mean_b * mean_b, F.lit(0.0))
    return sized.select(
        "latent",
        _per(F.col("__on"), F.col("__n")).alias("rate"),
        _per(F.col("__on_a"), F.col("__na")).alias("rate_a"), _per(F.col("__on_b"), F.col("__nb")).alias("rate_b"),
        mean_a.alias("mean_a"), mean_b.alias("mean_b"),
        ((mean_a - mean_b) / F.sqrt(_per(var_a, F.col("__na")) + _per(var_b, F.col("__nb")) + F.lit(1e-8))).alias("welch_t"),
    ).withColumn("separation", F.col("rate_a") - F.col("rate_b")).withColumn(
        "log_ratio", F.log((F.col("rate_a") + F.lit(0.01)) / (F.col("rate_b") + F.lit(0.01))))


# ---- inside a fact ----------------------------------------------------------
def paired_gap(acts: DataFrame, rows: DataFrame, first: Column, second: Column, strength: bool = True,
               epsilon: float = 1e-9) -> DataFrame:
    """Per fact mean(first) - mean(second), then mean and t over all facts that hold both.

    ``strength`` compares activations, otherwise ON/OFF.  Facts where the feature never fires
    count as zeros.  The fact sizes ride along on the rows, so activations are joined once.
    """
    flags = rows.select("row_id", "fact", first.alias("__a"), second.alias("__b"))
    sizes = flags.groupBy("fact").agg(_d(F.count_if("__a")).alias("__na"), _d(F.count_if("__b")).alias("__nb"))
    both = sizes.where((F.col("__na") > 0) & (F.col("__nb") > 0))
    n_facts = both.agg(_d(F.count(F.lit(1))).alias("n")).scalar()
    weight = F.when(F.col("__a"), F.lit(1.0) / F.col("__na")).when(F.col("__b"), F.lit(-1.0) / F.col("__nb"))
    weighted = flags.join(both, "fact").select("row_id", "fact", weight.alias("__w")).where(F.col("__w").isNotNull())
    value = _d(F.col("a")) if strength else F.lit(1.0)
    gaps = (
        acts.where(F.col("a") > 0).join(weighted, "row_id")
        .groupBy("latent", "fact").agg(F.sum(value * F.col("__w")).alias("__g"))
    )
    sums = gaps.groupBy("latent").agg(F.sum("__g").alias("__s"), F.sum(F.col("__g") * F.col("__g")).alias("__q")).withColumn("n_facts", n_facts)
    mean = F.col("__s") / F.col("n_facts")
    spread = F.sqrt(F.greatest(F.col("__q") / F.col("n_facts") - mean * mean, F.lit(0.0)))
    return sums.select("latent", "n_facts", mean.alias("gap"), (mean / (spread / F.sqrt("n_facts") + F.lit(epsilon))).alias("t"))


def worst_case_gap(acts: DataFrame, rows: DataFrame, levels: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """MaxMin scores of the within-fact rate gaps.

    ``score_correct`` is the smallest of the correct-broken gaps by k and the correct-entity gap;
    ``score_broken`` the smallest of the same gaps reversed and the broken-entity gap.  Levels
    without a fact are skipped.  Also the overall and own-kind firing rates, for eligibility.
    """
    used = rows.where(F.col("kind").isin(*KINDS)).select("row_id", "fact", "k_correct", "kind")
    counts = [_d(F.count_if(F.col("kind") == t)).alias(f"__n_{t}") for t in KINDS]
    facts = used.groupBy("fact", "k_correct").agg(*counts)

    def gap(t: str, u: str, on: bool) -> Column:
        ok = (F.col(f"__n_{t}") > 0) & (F.col(f"__n_{u}") > 0)
        if not on:
            return _d(F.count_if(ok))
        return F.when(ok, F.col(f"__on_{t}") / F.col(f"__n_{t}") - F.col(f"__on_{u}") / F.col(f"__n_{u}"))

    by_level = [F.count_if((F.col("k_correct") == k) & (F.col("__n_correct") > 0) & (F.col("__n_broken") > 0)).cast("double").alias(f"f{k}") for k in levels]
    totals = facts.agg(*by_level, gap("correct", "entity", False).alias("fce"), gap("entity", "broken", False).alias("feb"),
                       *[F.sum(f"__n_{t}").alias(f"n_{t}") for t in KINDS])
    hits = (
        acts.where(F.col("a") > 0).join(used, "row_id").groupBy("latent", "fact", "k_correct")
        .agg(*[_d(F.count_if(F.col("kind") == t)).alias(f"__on_{t}") for t in KINDS])
        .join(facts, ["fact", "k_correct"])
    )
    cb = gap("correct", "broken", True)
    sums = hits.groupBy("latent").agg(
        *[_when_sum(F.col("k_correct") == k, cb).alias(f"s{k}") for k in levels],
        F.coalesce(F.sum(gap("correct", "entity", True)), F.lit(0.0)).alias("sce"),
        F.coalesce(F.sum(gap("entity", "broken", True)), F.lit(0.0)).alias("seb"),
        *[F.sum(f"__on_{t}").alias(f"on_{t}") for t in KINDS])
    for name in [f"f{k}" for k in levels] + ["fce", "feb"] + [f"n_{t}" for t in KINDS]:
        sums = sums.withColumn(name, totals.select(name).scalar())
    gaps = [_per(F.col(f"s{k}"), F.col(f"f{k}")) for k in levels]
    ce, eb = _per(F.col("sce"), F.col("fce")), _per(F.col("seb"), F.col("feb"))
    n_all = sum((F.col(f"n_{t}") for t in KINDS), F.lit(0.0))
    on_all = sum((F.col(f"on_{t}") for t in KINDS), F.lit(0.0))
    return sums.select(
        "latent",
        F.least(*gaps, ce).alias("score_correct"), F.least(*[-g for g in gaps], -eb).alias("score_broken"),
        _per(on_all, n_all).alias("rate"),
        *[_per(F.col(f"on_{t}"), F.col(f"n_{t}")).alias(f"rate_{t}") for t in KINDS])


def worst_case_over_types(acts: DataFrame, rows: DataFrame, positive: Column, negatives: dict[str, Column],
                          statistic: str = "separation") -> DataFrame:
    """The smallest contrast of one positive group against several named negative groups, both signs."""
    out = None
    for name, negative in negatives.items():
        one = contrast(acts, rows, positive, negative).select("latent", F.col(statistic).alias(f"vs_{name}"))
        out = one if out is None else out.join(one, "latent", "outer")
    sides = [F.coalesce(F.col(f"vs_{n}"), F.lit(0.0)) for n in negatives]
    smallest = F.least(*sides) if len(sides) > 1 else sides[0]
    smallest_negative = F.least(*[-s for s in sides]) if len(sides) > 1 else -sides[0]
    return out.select("latent", smallest.alias("positive_side"), smallest_negative.alias("negative_side"))


# ---- choosing features ------------------------------------------------------
def eligible(scored: DataFrame, cap: float, own_rate: str, floor: float = 0.05, rate: str = "rate") -> DataFrame:
    """Common features (rate over the cap) and features rare in their own kind are left out."""
    return scored.where((F.col(rate) <= cap) & (F.col(own_rate) >= floor))


def top_features(scored: DataFrame, score: str, k: int, descending: bool = True) -> DataFrame:
    """The best ``k`` features of one side, ties by feature number."""
    first = F.desc(score) if descending else F.asc(score)
    return order.top_per_group(scored, k, (), [first, F.asc("latent")])


def two_sided(scored: DataFrame, score: str, k: int) -> DataFrame:
    """``k`` features per side as (latent, side) with side +1 and -1."""
    up = top_features(scored, score, k).select("latent", F.lit(1).alias("side"))
    down = top_features(scored, score, k, descending=False).select("latent", F.lit(-1).alias("side"))
    return up.unionByName(down)


def on_off_score(acts: DataFrame, rows: DataFrame, picked: DataFrame, name: str = "score") -> DataFrame:
    """Features of the + side that are ON minus those of the - side, 0 for rows with none."""
    sums = (
        acts.where(F.col("a") > 0).join(cut_lineage(picked), "latent")
        .groupBy("row_id").agg(F.sum("side").cast("double").alias(name))
    )
    return rows.join(sums, "row_id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def gap_score(acts: DataFrame, rows: DataFrame, picked: DataFrame, name: str = "gap") -> DataFrame:
    """Share of the + side ON minus share of the - side ON."""
    per_side = Window.partitionBy("side")
    shares = picked.withColumn("side", F.col("side").cast("double") / F.count(F.lit(1)).over(per_side))
    return on_off_score(acts, rows, shares, name)


def feature_moments(acts: DataFrame, rows: DataFrame) -> DataFrame:
    """Mean and population deviation of every feature over the given rows, zeros included."""
    n = rows.agg(_d(F.count(F.lit(1))).alias("n")).scalar()
    a = _d(F.col("a"))
    sums = (
        acts.where(F.col("a") > 0).join(rows.select("row_id"), "row_id", "left_semi")
        .groupBy("latent").agg(F.sum(a).alias("__s"), F.sum(a * a).alias("__q")).withColumn("__n", n)
    )
    mean = F.col("__s") / F.col("__n")
    return sums.select("latent", mean.alias("mu"), F.sqrt(F.greatest(F.col("__q") / F.col("__n") - mean * mean, F.lit(0.0))).alias("sd"))


def strength_score(acts: DataFrame, rows: DataFrame, picked: DataFrame, moments: DataFrame, centred: bool = True,
                   name: str = "score") -> DataFrame:
    """Signed sum of a / (sd + 1e-6), or of z-scores when ``centred``.

    An absent feature adds the constant -mu / sd, so all constants are summed once.
    """
    scaled = cut_lineage(picked.join(moments, "latent", "left").select(
        "latent", (F.col("side").cast("double") / (F.coalesce("sd", F.lit(0.0)) + F.lit(1e-6))).alias("__w"), F.coalesce("mu", F.lit(0.0)).alias("__mu")))
    sums = acts.where(F.col("a") > 0).join(scaled, "latent").groupBy("row_id").agg(F.sum(_d(F.col("a")) * F.col("__w")).alias(name))
    out = rows.join(sums, "row_id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    if centred:
        shift = scaled.agg(F.coalesce(F.sum(F.col("__w") * F.col("__mu")), F.lit(0.0)).alias("c")).scalar()
        out = out.withColumn("__c", shift).withColumn(name, F.col(name) - F.col("__c")).drop("__c")
    return out


# ---- controls ---------------------------------------------------------------
def rate_deciles(rates: DataFrame, rate: str = "rate", floor: float = 0.01) -> DataFrame:
    """Firing-rate decile of every feature, cut points taken over features with rate > ``floor``."""
    edges = order.bin_edges(rates.where(F.col(rate) > floor), rate, [i / 10 for i in range(1, 10)]).select(F.col("edges").alias("__e"))
    carried = order.attach_one_row(rates, edges)
    passed = sum(((F.col(rate) >= F.get("__e", F.lit(i))).cast("int") for i in range(9)), F.lit(0))
    return carried.withColumn("decile", F.coalesce(passed, F.lit(0))).drop("__e")


def matched_random_features(rates: DataFrame, wanted: DataFrame, excluded: DataFrame, draws: int, rate: str = "rate",
                            floor: float = 0.01, seed: object = 5, strict: bool = True) -> DataFrame:
    """Per draw one unused random feature of the same firing-rate decile for every wanted feature.

    A decile with too few unused features fails the run, or leaves ``latent`` NULL if not ``strict``.

    The windows run over the feature dictionary, whose size does not depend on the data.
    """
    placed = rate_deciles(rates, rate, floor)
    draw = F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))
    need = placed.join(wanted.select("latent"), "latent", "left_semi").withColumn(
        "place", F.row_number().over(Window.partitionBy("decile").orderBy("latent"))).select("decile", "place", F.col("latent").alias("for_latent"), draw.alias("draw"))
    pool = (
        placed.where(F.col(rate) > floor).join(excluded.select("latent"), "latent", "left_anti").withColumn("draw", draw)
        .withColumn("place", F.row_number().over(Window.partitionBy("decile", "draw").orderBy(hash32(F.col("draw"), F.col("latent"), seed=seed), "latent")))
    )
    found = need.join(pool.select("decile", "draw", "place", "latent"), ["decile", "draw", "place"], "left")
    if not strict:
        return found.select("draw", "for_latent", "latent", "decile")
    enough = F.when(F.col("latent").isNull(), F.raise_error(F.lit("a firing-rate decile has too few unused features")).cast("int")).otherwise(F.col("latent"))
    return found.select("draw", "for_latent", enough.alias("latent"), "decile")


def size_matched_draws(drawn: DataFrame, energy: DataFrame, wanted_energy: Column, tolerance: float = 0.15, strict: bool = True) -> DataFrame:
    """The first draw whose removed energy lies within the tolerance; without one it fails, or is empty if not ``strict``."""
    passing = energy.where(F.abs(F.col("energy") - wanted_energy) <= F.lit(tolerance) * wanted_energy)
    found = F.min("draw")
    if not strict:
        return drawn.join(passing.agg(found.alias("draw")).where(F.col("draw").isNotNull()), "draw", "left_semi")
    first = passing.agg(F.when(found.isNull(), F.raise_error(F.lit("no draw removes about as much")).cast("bigint")).otherwise(found).alias("draw"))
    return drawn.join(first, "draw", "left_semi")


def specificity(acts: DataFrame, rows: DataFrame, picked: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """Share ON of a feature set in several row groups, one output row per group."""
    picked = cut_lineage(picked.select("latent"))
    size = picked.agg(_d(F.count(F.lit(1))).alias("n")).scalar()
    names = list(groups)
    flags = rows.select("row_id", *[groups[g].alias(f"__{i}") for i, g in enumerate(names)])
    n_rows = flags.agg(*[_d(F.count_if(f"__{i}")).alias(f"n{i}") for i in range(len(names))])
    on = (
        acts.where(F.col("a") > 0).join(picked, "latent").join(flags, "row_id")
        .agg(*[_d(F.count_if(f"__{i}")).alias(f"o{i}") for i in range(len(names))])
    )
    both = on.withColumn("__k", size)
    for i in range(len(names)):
        both = both.withColumn(f"n{i}", n_rows.select(f"n{i}").scalar())
    rows_out = F.explode(F.array(*[
        F.struct(F.lit(g).alias("grp"), F.col(f"n{i}").alias("n_rows"),
                 (F.col(f"o{i}") / F.nullif(F.col(f"n{i}") * F.col("__k"), F.lit(0.0))).alias("share_on")) for i, g in enumerate(names)]))
    return both.select(rows_out.alias("r")).select("r.*")


def cap_sweep(scored: DataFrame, caps: Sequence[float], own_a: str = "rate_a", own_b: str = "rate_b", floor: float = 0.05) -> DataFrame:
    """Features left and candidates per side for each cap, in one pass."""
    aggregates = []
    for i, cap in enumerate(caps):
        ok = F.col("rate") <= cap
        aggregates += [F.count_if(ok).alias(f"l{i}"), F.count_if(ok & (F.col(own_a) >= floor)).alias(f"a{i}"), F.count_if(ok & (F.col(own_b) >= floor)).alias(f"b{i}")]
    table = F.explode(F.array(*[F.struct(F.lit(float(c)).alias("cap"), F.col(f"l{i}").alias("left_over"), F.col(f"a{i}").alias("candidates_a"),
                                         F.col(f"b{i}").alias("candidates_b")) for i, c in enumerate(caps)]))
    return scored.agg(*aggregates).select(table.alias("r")).select("r.*")


def step_change(first: DataFrame, later: DataFrame) -> DataFrame:
    """Change of activation and of ON state between two steps, absent means 0."""
    a = first.select("row_id", "latent", F.col("a").alias("__a0"))
    b = later.select("row_id", "latent", F.col("a").alias("__a1"))
    zero = F.lit(0.0)
    x0, x1 = F.coalesce(_d(F.col("__a0")), zero), F.coalesce(_d(F.col("__a1")), zero)
    return a.join(b, ["row_id", "latent"], "full_outer").select(
        "row_id", "latent", (x1 - x0).alias("d_strength"), ((x1 > 0).cast("int") - (x0 > 0).cast("int")).alias("d_on"))


def pick_overlap(picks: DataFrame) -> DataFrame:
    """Size of the common part of every two named top-K lists (a handful of names times K rows)."""
    other = picks.select(F.col("name").alias("other"), "latent")
    return picks.join(other, "latent").where(F.col("name") < F.col("other")).groupBy("name", "other").agg(F.count(F.lit(1)).alias("overlap"))

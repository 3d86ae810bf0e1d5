"""Outcome analysis on a long condition table ``outcomes(cond, row_id, ..., ok, new_type, answer)``.

Threshold searches never repeat rows over the parameter grid: rows are counted once into
score bins and the grid is evaluated on running sums of those few cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerscope.functions.hashing import draw_sums
from answerscope.operators import order

TYPES = ("correct", "entity", "broken", "abstain")


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def condition_pivot(outcomes: DataFrame, conditions: Sequence[str], value: str = "ok", keys: Sequence[str] = ("row_id",)) -> DataFrame:
    """One row per row_id, one column per condition."""
    return outcomes.groupBy(*keys).pivot("cond", list(conditions)).agg(F.first(value))


def outcome_shares(outcomes: DataFrame, by: Sequence[str] = ("cond",)) -> DataFrame:
    """Rows and share of every new answer type per group and condition."""
    shares = [F.avg((F.col("new_type") == t).cast("double")).alias(f"share_{t}") for t in TYPES]
    return outcomes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *shares)


def same_as_base(outcomes: DataFrame, base: str = "base") -> DataFrame:
    """Share of rows whose answer text equals the base run's."""
    reference = outcomes.where(F.col("cond") == base).select("row_id", F.col("answer").alias("__base"))
    return outcomes.where(F.col("cond") != base).join(reference, "row_id").groupBy("cond").agg(
        F.avg((F.col("answer") == F.col("__base")).cast("double")).alias("same_share"), F.count(F.lit(1)).alias("n"))


def agreement(outcomes: DataFrame, stored: DataFrame) -> DataFrame:
    """Share of rows whose answer equals the stored one."""
    pairs = outcomes.join(stored.select("row_id", F.col("answer").alias("__stored")), "row_id")
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("answer").eqNullSafe(F.col("__stored")).cast("double")).alias("agreement"))


def guarded_agreement(outcomes: DataFrame, stored: DataFrame, floor: float = 0.97) -> DataFrame:
    """O04 stop rule: the job fails when the agreement is below the floor."""
    measured = agreement(outcomes, stored)
    message = F.concat(F.lit("agreement below the floor: "), F.col("agreement").cast("string"))
    return measured.withColumn("agreement", F.when(F.col("agreement") >= floor, F.col("agreement")).otherwise(F.raise_error(message).cast("double")))


def breakdown_by_k(outcomes: DataFrame, rows: Column | None = None) -> DataFrame:
    """Share correct per condition and k, over the chosen rows."""
    chosen = outcomes if rows is None else outcomes.where(rows)
    return chosen.groupBy("cond", "k_correct").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("double")).alias("share_correct"))


def _against_base(outcomes: DataFrame, base: str) -> DataFrame:
    reference = outcomes.where(F.col("cond") == base).select("row_id", F.col("ok").alias("__base"))
    return outcomes.where(F.col("cond") != base).join(reference, "row_id").withColumn(
        "__gain", F.col("ok").cast("int") - F.col("__base").cast("int"))


def net_gain(outcomes: DataFrame, share_wrong: float, share_right: float, base: str = "base") -> DataFrame:
    """Weighted change against the base run if every row is edited, and if only wrong rows are (oracle)."""
    gains = _against_base(outcomes, base)
    wrong = F.avg(F.when(~F.col("was_correct"), F.col("__gain")))
    right = F.avg(F.when(F.col("was_correct"), F.col("__gain")))
    return gains.groupBy("cond").agg(
        (F.lit(share_wrong) * wrong + F.lit(share_right) * right).alias("net_gain"), (F.lit(share_wrong) * wrong).alias("oracle_gain"))


def net_gain_draws(outcomes: DataFrame, share_wrong: float, share_right: float, draws: int = 2000, base: str = "base",
                   seed: object = 0) -> DataFrame:
    """Net gain per resample, wrong and right rows resampled apart."""
    gains = _against_base(outcomes, base).select("cond", "row_id", "was_correct", "__gain")
    wrong, right = ~F.col("was_correct"), F.col("was_correct")
    sums = draw_sums(gains, draws, {
        "__wrong_gain": F.when(wrong, F.col("__gain")), "__wrong": F.when(wrong, 1.0),
        "__right_gain": F.when(right, F.col("__gain")), "__right": F.when(right, 1.0)},
        F.col("was_correct").cast("int"), F.col("row_id"), by=["cond"], seed=seed)
    return sums.select("cond", "draw", (
        F.lit(share_wrong) * _ratio(F.col("__wrong_gain"), F.col("__wrong"))
        + F.lit(share_right) * _ratio(F.col("__right_gain"), F.col("__right"))).alias("mean"))


def with_size_weights(rows: DataFrame, true_sizes: DataFrame, group: str = "k_correct") -> DataFrame:
    """Row weights that bring sampled groups up to their real sizes; groups not listed weigh 1."""
    sampled = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    weights = sampled.join(true_sizes, group, "left").select(group, F.coalesce(F.col("size") / F.col("__n"), F.lit(1.0)).alias("w"))
    return rows.join(weights, group)


def policy_report(rows: DataFrame, policies: dict[str, tuple[Column, str]], base: str = "base", weight: str = "w",
                  mid: Column | None = None) -> DataFrame:
    """For named (mask, treated column) policies on a pivoted table, one output row each.

    All policies are evaluated in one pass over the rows.
    """
    inside = F.col("k_correct").between(1, 4) if mid is None else mid
    w = F.col(weight).cast("double")
    aggregates, structs = [], []
    for i, (name, (mask, treated)) in enumerate(policies.items()):
        y = F.when(mask, F.col(treated)).otherwise(F.col(base))
        aggregates += [
            _ratio(F.sum(y.cast("int") * w), F.sum(w)).alias(f"a{i}"), F.avg(F.when(inside, y.cast("double"))).alias(f"m{i}"),
            _ratio(F.sum(mask.cast("int") * w), F.sum(w)).alias(f"t{i}"), F.avg(F.when(inside, mask.cast("double"))).alias(f"u{i}"),
            F.count_if(inside & ~F.col(base) & y).alias(f"f{i}"), F.count_if(inside & F.col(base) & ~y).alias(f"b{i}")]
        structs.append(F.struct(F.lit(name).alias("policy"), F.col(f"a{i}").alias("accuracy"), F.col(f"m{i}").alias("accuracy_mid"),
                                F.col(f"t{i}").alias("treated"), F.col(f"u{i}").alias("treated_mid"), F.col(f"f{i}").alias("fixed"), F.col(f"b{i}").alias("broken")))
    return rows.agg(*aggregates).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def reference_policies(treated: Sequence[str], base: str = "base") -> dict[str, tuple[Column, str]]:
    """Treat none, all, known facts only, wrong rows only, wrong rows of known facts."""
    mid = F.col("k_correct").between(1, 4)
    out = {"none": (F.lit(False), treated[0])}
    for c in treated:
        out |= {f"all/{c}": (F.lit(True), c), f"known/{c}": (mid, c), f"wrong/{c}": (~F.col(base), c), f"wrong known/{c}": (~F.col(base) & mid, c)}
    return out


def _with_edges(rows: DataFrame, source: DataFrame, score: str, probabilities: Sequence[float], name: str) -> DataFrame:
    """Attach the quantiles of a score, taken over ``source``, as one array column."""
    return order.attach_one_row(rows, order.bin_edges(source, score, probabilities).select(F.col("edges").alias(name)))


def _passed(score: str, edges: str, n: int, strict: bool) -> Column:
    """How many thresholds lie at or below (strict: below) the score."""
    test = (lambda i: F.col(score) > F.get(edges, F.lit(i))) if strict else (lambda i: F.col(score) >= F.get(edges, F.lit(i)))
    return sum((test(i).cast("int") for i in range(n)), F.lit(0))


def nested_threshold(rows: DataFrame, score: str, probabilities: Sequence[float], treated: Sequence[str], base: str = "base",
                     weight: str = "w") -> DataFrame:
    """Per fold the (condition, threshold) that is best on the other folds.

    A row is treated when its score is below the threshold.  Thresholds are quantiles of all
    rows; only the choice is nested.  The earlier condition, then the lower threshold, wins a tie.
    """
    n = len(probabilities)
    w = F.col(weight).cast("double")
    binned = _with_edges(rows, rows, score, probabilities, "__e").withColumn("__bin", _passed(score, "__e", n, strict=False))
    cells = binned.groupBy("fold", "__bin").agg(
        F.sum(w).alias("__w"), F.sum(F.col(base).cast("int") * w).alias("__base"), *[F.sum(F.col(c).cast("int") * w).alias(f"__c{i}") for i, c in enumerate(treated)])
    # fold x bin x threshold: a few thousand rows, whatever the input size
    grid = cells.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    below = F.col("__bin") <= F.col("p")
    curves = grid.groupBy("fold", "p").agg(
        F.sum("__w").alias("__w"), *[F.sum(F.when(below, F.col(f"__c{i}")).otherwise(F.col("__base"))).alias(f"__c{i}") for i in range(len(treated))])
    long = curves.select("fold", "p", "__w", F.posexplode(F.array(*[F.col(f"__c{i}") for i in range(len(treated))])).alias("c", "__y"))
    over_folds = Window.partitionBy("p", "c")
    other = (F.sum("__y").over(over_folds) - F.col("__y")) / (F.sum("__w").over(over_folds) - F.col("__w"))
    names = F.array(*[F.lit(c) for c in treated])
    best = long.withColumn("__acc", F.round(other, 12)).groupBy("fold").agg(
        F.max_by(F.struct("c", "p"), F.struct(F.col("__acc"), -F.col("c"), -F.col("p"))).alias("__b"), F.max("__acc").alias("accuracy_elsewhere"))
    quantile = F.get(F.array(*[F.lit(float(x)) for x in probabilities]), F.col("__b.p"))
    return best.select("fold", F.get(names, F.col("__b.c")).alias("cond"), quantile.alias("quantile"), F.col("__b.p").alias("p"), "accuracy_elsewhere")


def apply_threshold(rows: DataFrame, chosen: DataFrame, score: str, probabilities: Sequence[float]) -> DataFrame:
    """Adds ``treat`` and ``cond`` of the row's fold; one choice per fold, so broadcast."""
    joined = _with_edges(rows, rows, score, probabilities, "__e").join(F.broadcast(chosen.select("fold", "cond", "p")), "fold")
    return joined.withColumn("treat", F.col(score) < F.get("__e", F.col("p"))).drop("__e", "p")


def nested_report(applied: DataFrame, treated: Sequence[str], base: str = "base", weight: str = "w") -> DataFrame:
    """Accuracy with the nested choice, treated share, fixed and broken rows."""
    outcome = F.col(base)
    for c in treated:
        outcome = F.when(F.col("treat") & (F.col("cond") == c), F.col(c)).otherwise(outcome)
    return policy_report(applied.withColumn("__y", outcome), {"nested": (F.col("treat"), "__y")}, base, weight)


def two_score_rule(rows: DataFrame, high: str, low: str, probabilities: Sequence[float], treated: Sequence[str], base: str = "base",
                   weight: str = "w") -> DataFrame:
    """Treat when ``high`` is above its threshold and ``low`` below its own; choice nested by fold.

    Rows are counted into at most (n+1)^2 cells per fold before the grid of n^2 threshold pairs is tried.
    """
    n = len(probabilities)
    w = F.col(weight).cast("double")
    binned = (
        _with_edges(_with_edges(rows, rows, high, probabilities, "__eh"), rows, low, probabilities, "__el")
        .withColumn("__h", _passed(high, "__eh", n, strict=True)).withColumn("__l", _passed(low, "__el", n, strict=False))
    )
    cells = binned.groupBy("fold", "__h", "__l").agg(
        F.sum(w).alias("__w"), F.sum(F.col(base).cast("int") * w).alias("__base"), *[F.sum(F.col(c).cast("int") * w).alias(f"__c{i}") for i, c in enumerate(treated)])
    grid = cells.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    hit = (F.col("a") < F.col("__h")) & (F.col("__l") <= F.col("b"))
    curves = grid.groupBy("fold", "a", "b").agg(
        F.sum("__w").alias("__w"), *[F.sum(F.when(hit, F.col(f"__c{i}")).otherwise(F.col("__base"))).alias(f"__c{i}") for i in range(len(treated))])
    long = curves.select("fold", "a", "b", "__w", F.posexplode(F.array(*[F.col(f"__c{i}") for i in range(len(treated))])).alias("c", "__y"))
    over_folds = Window.partitionBy("a", "b", "c")
    other = (F.sum("__y").over(over_folds) - F.col("__y")) / (F.sum("__w").over(over_folds) - F.col("__w"))
    best = long.withColumn("__acc", F.round(other, 12)).groupBy("fold").agg(
        F.max_by(F.struct("c", "a", "b"), F.struct(F.col("__acc"), -F.col("c"), -F.col("a"), -F.col("b"))).alias("__b"),
        F.max("__acc").alias("accuracy_elsewhere"))
    q = F.array(*[F.lit(float(x)) for x in probabilities])
    names = F.array(*[F.lit(c) for c in treated])
    return best.select("fold", F.get(names, F.col("__b.c")).alias("cond"), F.get(q, F.col("__b.a")).alias("q_high"),
                       F.get(q, F.col("__b.b")).alias("q_low"), "accuracy_elsewhere")


def treated_share_curves(rows: DataFrame, treated: str, scores: Sequence[str], shares: Sequence[float], base: str = "base", **kw) -> DataFrame:
    """Accuracy when the X% lowest-scored rows are treated, against a random choice and the oracle.

    Equal scores form one cell; a cell cut by the boundary contributes in proportion, which is the
    mean over every order of its ties.  The random choice is its exact expectation, which repeated
    draws only estimate.  All rankings share one pass over the rows.
    """
    gain = F.col(treated).cast("int") - F.col(base).cast("int")
    rankings = [F.struct(F.lit(s).alias("ranking"), F.col(s).cast("double").alias("__s")) for s in scores]
    rankings += [F.struct(F.lit("oracle").alias("ranking"), (-gain).cast("double").alias("__s")),
                 F.struct(F.lit("random").alias("ranking"), F.lit(0.0).alias("__s"))]  # one tie: every order is equally likely
    long = rows.select(F.explode(F.array(*rankings)).alias("__r"), gain.alias("__g"), F.col(base).cast("int").alias("__b")).select("__r.*", "__g", "__b")
    cells = long.where(F.col("__s").isNotNull()).groupBy("ranking", "__s").agg(
        F.count(F.lit(1)).alias("__n"), F.sum("__g").alias("__g"), F.sum("__b").alias("__b"))
    totals = cells.groupBy("ranking").agg(F.sum("__n").alias("__total"), F.sum("__b").alias("__base"))
    placed = order.running_totals(cells, ["ranking"], "__s", ["__n"], **kw).join(totals, "ranking")
    n = F.col("__total").cast("double")
    curves = []
    for x in shares:
        wanted = F.round(F.lit(float(x)) * n)
        part = F.greatest(F.least((wanted - F.col("below___n")) / F.col("__n"), F.lit(1.0)), F.lit(0.0))
        curves.append((F.sum(F.col("__g") * part) + F.max("__base")) / F.max(n))
    points = F.array(*[F.struct(F.lit(float(x)).alias("share"), c.alias("accuracy")) for x, c in zip(shares, curves)])
    return placed.groupBy("ranking").agg(points.alias("__c")).select("ranking", F.explode("__c").alias("__c")).select("ranking", "__c.share", "__c.accuracy")


def gate_rates(rows: DataFrame, score: str, right: Column, wrong: Column, level: float = 0.9) -> DataFrame:
    """Threshold at a quantile of the right rows, false alarms on them, detections on the wrong rows."""
    threshold = order.quantiles(rows.where(right), score, [level]).select("q").scalar()
    carried = rows.withColumn("__t", threshold)
    above = (F.col(score) > F.col("__t")).cast("double")
    return carried.agg(F.max("__t").alias("threshold"), F.avg(F.when(right, above)).alias("false_alarm"), F.avg(F.when(wrong, above)).alias("detection"))


def donor_echo(outcomes: DataFrame, donors: DataFrame, answers: DataFrame, base: str = "base") -> DataFrame:
    """Share of rows that repeat the donor's answer, and the base run's correct share on the same rows."""
    given = donors.where(F.col("donor").isNotNull()).select("row_id", "donor").join(
        answers.select(F.col("row_id").alias("donor"), F.col("answer").alias("__donor")), "donor")
    reference = outcomes.where(F.col("cond") == base).select("row_id", F.col("ok").alias("__base"))
    return outcomes.where(F.col("cond") != base).join(given, "row_id").join(reference, "row_id").groupBy("cond").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("answer") == F.col("__donor")).cast("double")).alias("echo_share"),
        F.avg(F.col("ok").cast("double")).alias("share_correct"), F.avg(F.col("__base").cast("double")).alias("base_correct"))


def compare_runs(first: DataFrame, second: DataFrame, by: Sequence[str] = ("cond",)) -> DataFrame:
    """Answer-type shares of two runs side by side."""
    shares = [f"share_{t}" for t in TYPES]
    a = outcome_shares(first, by).select(*by, *[F.col(s).alias(f"{s}_1") for s in shares])
    b = outcome_shares(second, by).select(*by, *[F.col(s).alias(f"{s}_2") for s in shares])
    return a.join(b, list(by), "full_outer")

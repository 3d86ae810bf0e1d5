"""The three end-to-end jobs, composed from the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerscope.operators import error_types, features, grading, metrics, outcomes, probes, selection, vectors
from answerscope.session import cut_lineage

FINAL_COLUMNS = ["sample_id", "version", "relation", "question", "model_answer", "gold_value", "gold_aliases", "correct", "k_correct", "fact_group",
                 "type3", "rule", "unverified"]
WRONG_COLUMNS = ["sample_id", "version", "relation", "question", "model_answer", "gold_value", "fact_group", "type3", "rule", "unverified"]


def grade_and_type(raw: DataFrame, names: DataFrame, wordings: int = 5) -> DataFrame:
    """Answers -> graded, typed and counted, all rows and all columns.

    Grading and the pattern rules are row-local.  The name lookup and the count per fact are the
    only joins.
    """
    keyed = raw.withColumn("row_id", F.concat_ws(":", F.col("sample_id").cast("string"), F.col("version").cast("string")))
    typed = error_types.classify(grading.grade(keyed), names)
    return selection.with_consistency(typed, fact="sample_id", wordings=wordings).select(*FINAL_COLUMNS)


def wrong_rows(final: DataFrame) -> DataFrame:
    return final.where(~F.col("correct")).select(*WRONG_COLUMNS)


@dataclass
class SignalReport:
    dev_scores: list[tuple[str, float]]
    picked: dict[str, str]
    test: DataFrame
    null: DataFrame


def signal_search(rows: DataFrame, configurations: dict[str, Callable[[DataFrame, DataFrame], DataFrame]], draws: int = 1000, shuffles: int = 20,
                  min_k: int = 1, folds: int = 5, family: Callable[[str], str] = lambda name: name.split("|")[0]) -> SignalReport:
    """Which signal tells right from wrong rows of a partly known fact?

    ``rows`` holds fact, subject, correct, k_correct and whatever the (train, evaluate) -> scored
    functions read.  Subjects are split once; configurations are compared on dev, scored once on
    test with an interval over facts, and the best of each ``family`` (the name up to ``|``) again
    with labels shuffled inside facts.
    """
    partly = selection.with_both_outcomes(selection.partly_known(rows, min_k))
    # every fit below reads these rows again, so they are computed once and kept reliably
    kept = cut_lineage(partly.withColumn("half", selection.half()).withColumn("inner_fold", selection.inner_fold(n=folds)))
    dev, test = kept.where("half = 'dev'"), kept.where("half = 'test'")
    dev_scores = probes.sweep(dev, configurations, folds)
    picked: dict[str, str] = {}
    best: dict[str, float] = {}
    for name, score in dev_scores:
        kind = family(name)
        if kind not in best or score > best[kind]:
            best[kind], picked[kind] = score, name
    tested = None
    for name, run in configurations.items():
        per = metrics.auroc(run(dev, test), "score", F.col("correct"), ["fact"])
        one = metrics.bootstrap_mean(per, ["fact"], "auc", draws).withColumn("config", F.lit(name)).withColumn("picked", F.lit(name in picked.values()))
        tested = one if tested is None else tested.unionByName(one)
    null = None
    shuffled = cut_lineage(metrics.shuffled_labels(kept, "row_id", ["fact"], F.col("correct"), shuffles).drop("correct").withColumnRenamed("shuffled", "correct"))
    for name in sorted(set(picked.values())):
        for draw in range(shuffles):
            one_draw = shuffled.where(F.col("draw") == draw).drop("draw")
            scored = configurations[name](one_draw.where("half = 'dev'"), one_draw.where("half = 'test'"))
            mean = metrics.mean_over_groups(metrics.auroc(scored, "score", F.col("correct"), ["fact"])).withColumn("config", F.lit(name)).withColumn("draw", F.lit(draw))
            null = mean if null is None else null.unionByName(mean)
    summary = null.groupBy("config").agg(F.avg("mean_auc").alias("null_mean"), F.stddev_pop("mean_auc").alias("null_std"), F.count(F.lit(1)).alias("draws"))
    return SignalReport(dev_scores, picked, tested, summary)


def maxmin_signal(acts: DataFrame, rows: DataFrame, k: int = 20, cap: float = 0.5) -> DataFrame:
    """The cross-fitted within-fact signal: top features per side by worst-case gap, as (latent, side).

    Side +1 fires more in broken rows, -1 more in right rows, so a high score means 'broken'.
    """
    scored = features.worst_case_gap(acts, selection.partly_known(rows))
    up = features.top_features(features.eligible(scored, cap, "rate_broken"), "score_broken", k).select("latent", F.lit(1).alias("side"))
    down = features.top_features(features.eligible(scored, cap, "rate_correct"), "score_correct", k).select("latent", F.lit(-1).alias("side"))
    return up.unionByName(down)


def detector_scores(states: DataFrame, folds: int = 5, c: float = 0.001, cap: int = 20_000) -> DataFrame:
    """Cross-fitted P_all, P_mid, P_know and axis per row (states with k_correct, fold and a vector)."""
    ready = probes.with_vector(states, "h")
    mid = F.col("k_correct").between(1, 4)

    def probe(label):
        return lambda train: probes.fit_logistic(train, label, c)

    p_all = probes.cross_fit(ready, probe(F.col("correct")), folds, cap=cap, name="p_all").select("row_id", "p_all")
    p_mid = probes.cross_fit(ready, probe(F.col("correct")), folds, train_rows=mid, cap=cap, name="p_mid").select("row_id", "p_mid")
    p_know = probes.cross_fit(ready, probe(F.col("k_correct") >= 1), folds, cap=cap, name="p_know").select("row_id", "p_know")
    others = F.explode(F.filter(F.array(*[F.lit(g) for g in range(folds)]), lambda g: g != F.col("fold")))
    training = selection.partly_known(states).withColumn("fold", others)
    directions = vectors.within_fact_direction(training, F.col("correct"), F.col("kind") == "broken", ["fold"], draw=["fold"])
    axis = vectors.projection(states, directions).select("row_id", "axis")
    return p_all.join(p_mid, "row_id").join(p_know, "row_id").join(axis, "row_id")


def gated_policies(outcome_rows: DataFrame, scores: DataFrame, true_sizes: DataFrame, conditions: Sequence[str], base: str = "base",
                   probabilities: Sequence[float] = tuple(round(0.02 * i, 2) for i in range(1, 50))) -> DataFrame:
    """Reference policies and nested detector gates over a condition table, one row per policy."""
    treated = [c for c in conditions if c != base]
    wide = outcomes.condition_pivot(outcome_rows, list(conditions), keys=("row_id", "k_correct", "fold"))
    rows = cut_lineage(outcomes.with_size_weights(wide, true_sizes).join(scores, "row_id"))
    report = outcomes.policy_report(rows, outcomes.reference_policies(treated, base), base)
    for score in [c for c in scores.columns if c != "row_id"]:
        chosen = outcomes.nested_threshold(rows, score, probabilities, treated, base)
        gated = outcomes.nested_report(outcomes.apply_threshold(rows, chosen, score, probabilities), treated, base)
        report = report.unionByName(gated.withColumn("policy", F.lit(f"gate/{score}")))
    return report

"""Queries on signal metrics."""

from pyspark.sql import functions as F

from answerscope.functions.hashing import draw_uniform_sql, poisson_sql
from answerscope.operators import features, metrics, selection
from answerscope.plans import views as V
from answerscope.plans.catalogue.registry import query, rounded
from answerscope.plans.views import cte, sql_hash
from answerscope.session import cut_lineage


def auc_sql(rows: str, group: str, score: str = "score", positive: str = "correct") -> str:
    """Rank form of the AUROC per group, average ranks for ties."""
    over = f"PARTITION BY {group} ORDER BY {score}"
    ties = f"PARTITION BY {group}, {score}"
    return f"""SELECT {group}, p AS positives, n AS negatives, (s - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * n::DOUBLE) AS auc FROM (
      SELECT {group}, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n, sum(r) FILTER (WHERE y) AS s FROM (
        SELECT {group}, {positive} AS y, rank() OVER ({over}) + (count(*) OVER ({ties}) - 1) / 2.0::DOUBLE AS r FROM {rows})
      GROUP BY {group}) WHERE p > 0 AND n > 0"""


def mid_rows(spark, folder):
    """Cut from their lineage: all branches of a rank would else do the joins again, side by side in the same tasks."""
    rows = selection.with_both_outcomes(selection.partly_known(V.attempts_k(spark, folder)))
    return cut_lineage(rows.select("row_id", "fact", "score", "correct"))


_MID = "mid AS (SELECT * FROM attempts_k WHERE k_correct BETWEEN 1 AND 4)"
_PER_FACT = f"{_MID}, per_fact AS ({auc_sql('mid', 'fact')})"
_FACTS = cte("attempts_k") + ", " + _PER_FACT


@query("M01_pooled_auroc", "WITH r AS (SELECT 0 AS g, event_type IN ('purchase', 'signup') AS y, value AS v FROM events) "
       f"SELECT positives, negatives, round(auc, 6) AS auc FROM ({auc_sql('r', 'g', 'v', 'y')})")
def pooled_auroc(spark, folder):
    rows = V.attempts(spark, folder)
    return rounded(metrics.auroc(rows, "score", F.col("correct")), "auc")


@query("M02_within_fact_auroc", _FACTS + "SELECT fact, positives, negatives, round(auc, 6) AS auc FROM per_fact")
def within_fact_auroc(spark, folder):
    return rounded(metrics.auroc(mid_rows(spark, folder), "score", F.col("correct"), ["fact"]), "auc")


@query("M03_mean_within_fact_auroc", _FACTS + "SELECT round(avg(auc), 6) AS mean_auc, count(*) AS n_groups FROM per_fact")
def mean_within_fact_auroc(spark, folder):
    per = metrics.auroc(mid_rows(spark, folder), "score", F.col("correct"), ["fact"])
    return rounded(metrics.mean_over_groups(per), "mean_auc")


_PER_RELATION = cte("attempts") + f", per_relation AS ({auc_sql('attempts', 'relation')})"


def _per_relation(spark, folder):
    return metrics.auroc(V.attempts(spark, folder), "score", F.col("correct"), ["relation"])


@query("M04_within_relation_auroc", _PER_RELATION + """
  SELECT round(sum(auc * (positives + negatives)) / sum(positives + negatives), 6) AS mean_auc, count(*) AS n_groups FROM per_relation WHERE positives >= 20 AND negatives >= 20""")
def within_relation_auroc(spark, folder):
    return rounded(metrics.floored_mean(_per_relation(spark, folder), 20), "mean_auc")


@query("M05_state_pair_auroc", cte("attempts_k") + f"""
  , st AS (SELECT relation, score, kind = 'broken' AND k_correct BETWEEN 1 AND 4 AS y FROM attempts_k WHERE (kind = 'broken' AND k_correct BETWEEN 0 AND 4))
  , per AS ({auc_sql('st', 'relation', 'score', 'y')})
  SELECT round(sum(auc * (positives + negatives)) / sum(positives + negatives), 6) AS mean_auc, count(*) AS n_groups FROM per WHERE positives >= 8 AND negatives >= 8""")
def state_pair_auroc(spark, folder):
    rows = V.attempts_k(spark, folder).withColumn("state", selection.known_state("broken")).where(F.col("state").isin("kbw", "dont"))
    return rounded(metrics.floored_mean(metrics.auroc(rows, "score", F.col("state") == "kbw", ["relation"]), 8), "mean_auc")


@query("M06_unweighted_relation_auroc", _PER_RELATION + "SELECT round(avg(auc), 6) AS mean_auc, count(*) AS n_groups FROM per_relation WHERE positives >= 20 AND negatives >= 20")
def unweighted_relation_auroc(spark, folder):
    return rounded(metrics.floored_mean(_per_relation(spark, folder), 20, weighted=False), "mean_auc")


@query("M07_pair_restricted_auroc", cte("attempts_k") + f"""
  , cb AS (SELECT fact, score, kind = 'broken' AS y FROM attempts_k WHERE kind IN ('correct', 'broken')), eb AS (SELECT fact, score, kind = 'broken' AS y FROM attempts_k WHERE kind IN ('entity', 'broken'))
  , ce AS (SELECT fact, score, kind = 'entity' AS y FROM attempts_k WHERE kind IN ('correct', 'entity'))
  SELECT 'correct-broken' AS pair, round(avg(auc), 6) AS mean_auc, count(*) AS n_groups FROM ({auc_sql('cb', 'fact', 'score', 'y')})
  UNION ALL SELECT 'entity-broken', round(avg(auc), 6), count(*) FROM ({auc_sql('eb', 'fact', 'score', 'y')})
  UNION ALL SELECT 'correct-entity', round(avg(auc), 6), count(*) FROM ({auc_sql('ce', 'fact', 'score', 'y')})""")
def pair_restricted_auroc(spark, folder):
    rows = cut_lineage(V.attempts_k(spark, folder).select("fact", "kind", "score"))  # read by all branches of three ranks
    out = None
    for a, b in (("correct", "broken"), ("entity", "broken"), ("correct", "entity")):
        one = metrics.mean_over_groups(metrics.pair_auroc(rows, "score", "kind", a, b, ["fact"])).withColumn("pair", F.lit(f"{a}-{b}"))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "mean_auc")


_U8 = draw_uniform_sql(1, "draw", "fact")


@query("M08_bootstrap_interval", _FACTS + f"""
  , drawn AS (SELECT draw, auc, ({poisson_sql('u')})::DOUBLE AS w FROM (SELECT draw, auc, {_U8} AS u FROM (SELECT *, unnest(range(1000)) AS draw FROM per_fact)))
  , means AS (SELECT draw, sum(w * auc) / sum(w) AS m FROM drawn GROUP BY draw)
  SELECT round((SELECT avg(auc) FROM per_fact), 6) AS mean, (SELECT count(*) FROM per_fact) AS n_groups,
         round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM means""")
def bootstrap_interval(spark, folder):
    per = metrics.auroc(mid_rows(spark, folder), "score", F.col("correct"), ["fact"])
    return rounded(metrics.bootstrap_mean(per, ["fact"], "auc", draws=1000), "mean", "lo", "hi")


def spearman_sql(rows: str, group: str, x: str, y: str) -> str:
    def rank(v):
        return f"rank() OVER (PARTITION BY {group} ORDER BY {v}) + (count(*) OVER (PARTITION BY {group}, {v}) - 1) / 2.0::DOUBLE"

    return f"SELECT {group}, count(*) AS n, count(DISTINCT yy) AS n_y, corr(rx, ry) AS rho FROM (SELECT {group}, {y} AS yy, {rank(x)} AS rx, {rank(y)} AS ry FROM {rows}) GROUP BY {group}"


@query("M10_spearman", cte("attempts_k") + f", r AS (SELECT 0 AS g, score, k_correct FROM attempts_k) SELECT n, n_y, round(rho, 6) AS rho FROM ({spearman_sql('r', 'g', 'score', 'k_correct')})")
def spearman(spark, folder):
    return rounded(metrics.spearman(V.attempts_k(spark, folder), "score", "k_correct"), "rho")


@query("M11_within_relation_spearman", cte("attempts_k") + f"""
  SELECT round(sum(rho * n) / sum(n), 6) AS mean_rho, count(*) AS n_groups FROM ({spearman_sql('attempts_k', 'relation', 'score', 'k_correct')}) WHERE n >= 200 AND n_y > 2""")
def within_relation_spearman(spark, folder):
    return rounded(metrics.grouped_spearman(V.attempts_k(spark, folder), "score", "k_correct", ["relation"]), "mean_rho")


@query("M12_pearson", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def pearson(spark, folder):
    return rounded(metrics.pearson(V.read(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]), "r")


_CLASSES = ["click", "error", "purchase", "signup", "view"]
_PRED = "CASE WHEN value < 5 THEN 'click' WHEN value < 10 THEN 'error' WHEN value < 20 THEN 'purchase' WHEN value < 40 THEN 'signup' ELSE 'view' END"


@query("M13_confusion", f"""
  WITH p AS (SELECT event_type AS truth, {_PRED} AS pred FROM events)
  , r AS (SELECT truth, count(*) AS n, {", ".join(f"avg((pred = '{c}')::INT) AS pred_{c}" for c in _CLASSES)}, avg((pred = truth)::INT) AS recall FROM p GROUP BY truth)
  SELECT truth, n, {", ".join(f"round(pred_{c}, 6) AS pred_{c}" for c in _CLASSES)}, round(recall, 6) AS recall, round(avg(recall) OVER (), 6) AS balanced_accuracy FROM r""")
def confusion(spark, folder):
    rows = V.read(spark, folder, "events").select(F.col("event_type").alias("truth"), F.expr(_PRED).alias("pred"))
    out = metrics.confusion(rows, "truth", "pred", _CLASSES)
    return rounded(out, *[f"pred_{c}" for c in _CLASSES], "recall", "balanced_accuracy")


@query("M14_cell_summary", cte("attempts_k") + """
  SELECT k_correct, correct, count(*) AS n, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median FROM attempts_k GROUP BY ALL HAVING count(*) >= 20""")
def cell_summary(spark, folder):
    return rounded(metrics.cell_summary(V.attempts_k(spark, folder), "score", ["k_correct", "correct"]), "mean", "median")


@query("M15_reference_scaled", cte("attempts_k") + """
  , m AS (SELECT quantile_cont(score, 0.5) FILTER (WHERE k_correct = 0) AS lo, quantile_cont(score, 0.5) FILTER (WHERE k_correct = 5) AS hi FROM attempts_k)
  SELECT row_id, round((score - lo) / (hi - lo), 6) AS position FROM attempts_k, m""", signed=("position",))
def reference_scaled(spark, folder):
    out = metrics.reference_scaled(V.attempts_k(spark, folder), "score", F.col("k_correct") == 0, F.col("k_correct") == 5)
    return rounded(out.select("row_id", "position"), "position")


@query("M16_decile_table", cte("attempts_k") + """
  , e AS (SELECT quantile_cont(score, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) AS q FROM attempts_k WHERE half = 'test')
  , b AS (SELECT *, greatest(least(len(list_filter(q, lambda x: x <= score)) - 1, 9), 0)::INT AS bin FROM attempts_k, e)
  SELECT bin, count(*) AS n, round(avg(k_correct), 6) AS mean_k, round(avg((kind = 'correct')::INT), 6) AS correct, round(avg((kind = 'entity')::INT), 6) AS entity,
         round(avg((kind = 'broken')::INT), 6) AS broken, round(avg((kind = 'abstain')::INT), 6) AS abstain, round(avg((kind = 'broken')::INT) FILTER (WHERE kind <> 'correct'), 6) AS broken_of_wrong
  FROM b GROUP BY bin""")
def decile_table(spark, folder):
    rows = V.attempts_k(spark, folder)
    out = metrics.decile_table(rows, "score", "k_correct", "kind", fit_on=rows.where("half = 'test'"))
    return rounded(out, "mean_k", "correct", "entity", "broken", "abstain", "broken_of_wrong")


@query("M17_quintile_share", cte("attempts_k") + """
  , w AS (SELECT * FROM attempts_k WHERE NOT correct), e AS (SELECT quantile_cont(score, [.2, .4, .6, .8]) AS q FROM w)
  SELECT len(list_filter(q, lambda x: x <= score))::INT AS bin, count(*) AS n, round(avg((k_correct >= 1)::INT), 6) AS share FROM w, e GROUP BY bin""")
def quintile_share(spark, folder):
    rows = V.attempts_k(spark, folder).where(~F.col("correct"))
    return rounded(metrics.quintile_share(rows, "score", F.col("k_correct") >= 1), "share")


@query("M18_cumulative_share", cte("attempts") + """
  SELECT correct, t AS threshold, round(avg((score <= t)::INT), 6) AS share FROM attempts, (SELECT unnest([0, 1, 2, 4, 8, 16, 24, 31])::DOUBLE AS t) GROUP BY ALL""")
def cumulative_share(spark, folder):
    return rounded(metrics.cumulative_share(V.attempts(spark, folder), "score", [0, 1, 2, 4, 8, 16, 24, 31], ["correct"]), "share")


@query("M19_summary_row", cte("attempts") + """
  SELECT kind, count(*) AS n, round(quantile_cont(score, 0.5), 6) AS median, round(avg(score), 6) AS mean, round(avg((score < 8)::INT), 6) AS share_early FROM attempts GROUP BY kind""")
def summary_row(spark, folder):
    return rounded(metrics.summary_row(V.attempts(spark, folder), "score", ["kind"]), "median", "mean", "share_early")


@query("M20_relation_mix", cte("attempts_k") + """
  SELECT relation, round(count(*) FILTER (WHERE k_correct = 5) / (SELECT count(*) FROM attempts_k WHERE k_correct = 5)::DOUBLE, 6) AS share_first,
         round(count(*) FILTER (WHERE k_correct = 0) / (SELECT count(*) FROM attempts_k WHERE k_correct = 0)::DOUBLE, 6) AS share_second
  FROM attempts_k GROUP BY relation HAVING count(*) FILTER (WHERE k_correct IN (0, 5)) > 0""")
def relation_mix(spark, folder):
    out = metrics.category_mix(V.attempts_k(spark, folder), "relation", F.col("k_correct") == 5, F.col("k_correct") == 0)
    return rounded(out, "share_first", "share_second")


@query("M21_best_per_family", """
  SELECT family, arg_max(name, (score, -position)) AS picked, max(score) AS best FROM (
    SELECT substr(p_name, 1, 3) AS family, p_name || ' ' || p_partkey AS name, p_size::DOUBLE AS score, p_partkey AS position FROM part) GROUP BY family""")
def best_per_family(spark, folder):
    p = V.read(spark, folder, "part").select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").cast("double").alias("score"),
                                             F.col("p_partkey").alias("position"))
    return metrics.best_per_family(p, F.substring("name", 1, 3), "name", "score", "position")


_SHUFFLE = sql_hash("'100:' || draw || ':' || row_id")


@query("M22_permutation_null", cte("attempts_k") + f"""
  , {_MID}, drawn AS (SELECT m.*, draw, count(*) FILTER (WHERE correct) OVER (PARTITION BY draw, fact) AS p FROM (SELECT *, unnest(range(20)) AS draw FROM mid) m)
  , shuffled AS (SELECT draw || ':' || fact AS unit, draw, score, row_number() OVER (PARTITION BY draw, fact ORDER BY {_SHUFFLE}, draw || ':' || row_id) <= p AS y FROM drawn)
  , per AS (SELECT split_part(unit, ':', 1) AS draw, avg(auc) AS mean_auc FROM ({auc_sql('shuffled', 'unit', 'score', 'y')}) GROUP BY 1)
  SELECT round(avg(mean_auc), 6) AS null_mean, round(stddev_pop(mean_auc), 6) AS null_std, count(*) AS draws FROM per""")
def permutation_null(spark, folder):
    shuffled = metrics.shuffled_labels(mid_rows(spark, folder), "row_id", ["fact"], F.col("correct"), draws=20)
    per = metrics.auroc(shuffled, "score", F.col("shuffled"), ["fact", "draw"])
    return rounded(metrics.null_summary(metrics.mean_over_groups(per, ["draw"])), "null_mean", "null_std")


@query("M23_control_draws", """
  SELECT prefix, count(*) AS n_draws, round(avg(share), 6) AS mean, round(min(share), 6) AS min, round(max(share), 6) AS max FROM (
    SELECT event_type AS prefix, event_id % 8 AS draw, avg((value > 10)::INT) AS share FROM events GROUP BY ALL) GROUP BY prefix""")
def control_draws(spark, folder):
    ev = V.read(spark, folder, "events")
    cond = F.concat(F.col("event_type"), F.lit(" #"), (F.col("event_id") % 8).cast("string"))
    shares = ev.groupBy(cond.alias("cond")).agg(F.avg((F.col("value") > 10).cast("double")).alias("share"))
    return rounded(metrics.prefix_summary(shares, "cond", "share"), "mean", "min", "max")


@query("M24_groups_and_pooled", cte("attempts_k") + """
  SELECT coalesce(k_correct::VARCHAR, '1-4') AS k_correct, count(*) AS n, round(avg(score), 6) AS mean_score FROM attempts_k WHERE k_correct BETWEEN 1 AND 4 GROUP BY ROLLUP (k_correct)""")
def groups_and_pooled(spark, folder):
    rows = selection.partly_known(V.attempts_k(spark, folder))
    out = metrics.with_pooled(rows, "k_correct", [F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score")], pooled="1-4")
    return rounded(out, "mean_score")


@query("M25_distinct_counts", cte("attempts", "acts") + """
  SELECT 'fact' AS name, count(DISTINCT fact) AS n_distinct FROM attempts UNION ALL SELECT 'subject', count(DISTINCT subject) FROM attempts
  UNION ALL SELECT 'latent', count(DISTINCT latent) FROM acts""")
def distinct_counts(spark, folder):
    return metrics.distinct_counts(V.attempts(spark, folder), ["fact", "subject"]).unionByName(metrics.distinct_counts(V.acts(spark, folder), ["latent"]))


@query("M26_active_per_row", cte("acts") + """
  SELECT count(*) AS active, (SELECT count(*)::DOUBLE FROM embeddings) AS rows, round(count(*) / (SELECT count(*)::DOUBLE FROM embeddings), 6) AS active_per_row FROM acts""")
def active_per_row(spark, folder):
    return rounded(metrics.active_per_row(V.acts(spark, folder), V.states(spark, folder)), "active_per_row")


_SEP = """
  , rates AS (SELECT latent, count(*) FILTER (WHERE correct)::DOUBLE / (SELECT count(*) FROM states_k WHERE correct) - count(*) FILTER (WHERE kind = 'broken')::DOUBLE / (SELECT count(*) FROM states_k WHERE kind = 'broken') AS s1,
       count(*) FILTER (WHERE correct)::DOUBLE / (SELECT count(*) FROM states_k WHERE correct) - count(*) FILTER (WHERE kind = 'entity')::DOUBLE / (SELECT count(*) FROM states_k WHERE kind = 'entity') AS s2
     FROM acts JOIN states_k USING (row_id) GROUP BY latent)"""


@query("M27_pick_overlap", cte("states_k", "acts") + _SEP + """
  , picks AS (SELECT 'broken' AS name, latent FROM (SELECT latent FROM rates ORDER BY round(s1, 9) DESC, latent LIMIT 10) UNION ALL SELECT 'entity', latent FROM (SELECT latent FROM rates ORDER BY round(s2, 9) DESC, latent LIMIT 10))
  SELECT a.name, b.name AS other, count(*) AS overlap FROM picks a JOIN picks b ON a.latent = b.latent AND a.name < b.name GROUP BY ALL""")
def pick_overlap(spark, folder):
    acts, rows = V.acts(spark, folder), V.states_k(spark, folder)
    out = None
    for name in ("broken", "entity"):
        scored = features.contrast(acts, rows, F.col("correct"), F.col("kind") == name).withColumn("separation", F.round("separation", 9))
        one = features.top_features(scored, "separation", 10).select(F.lit(name).alias("name"), "latent")
        out = one if out is None else out.unionByName(one)
    return features.pick_overlap(out)


@query("M27_score_rank_correlation", cte("states_k", "acts") + _SEP + f", r AS (SELECT 0 AS g, round(s1, 9) AS s1, round(s2, 9) AS s2 FROM rates) SELECT n, round(rho, 6) AS rho FROM ({spearman_sql('r', 'g', 's1', 's2')})")
def score_rank_correlation(spark, folder):
    acts, rows = V.acts(spark, folder), V.states_k(spark, folder)
    one, two = (features.contrast(acts, rows, F.col("correct"), F.col("kind") == k).select("latent", F.round("separation", 9).alias(k)) for k in ("broken", "entity"))
    return rounded(metrics.spearman(one.join(two, "latent"), "broken", "entity").select("n", "rho"), "rho")

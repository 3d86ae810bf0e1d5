"""Queries on outcomes under conditions and on gated policies."""

from pyspark.sql import functions as F

from answerscope.functions.hashing import draw_uniform_sql, poisson_sql
from answerscope.operators import metrics, selection
from answerscope.operators import outcomes as O
from answerscope.plans import views as V
from answerscope.plans.catalogue.metrics import spearman_sql
from answerscope.plans.catalogue.registry import query, rounded
from answerscope.plans.views import cte

_O = cte("outcomes")
_P = cte("policy_rows")
SHARES = ["share_correct", "share_entity", "share_broken", "share_abstain"]
_SHARES_SQL = ", ".join(f"round(avg((new_type = '{t}')::INT), 6) AS share_{t}" for t in O.TYPES)


@query("O01_condition_pivot", _O + """
  SELECT row_id, bool_or(ok) FILTER (WHERE cond = 'base') AS base, bool_or(ok) FILTER (WHERE cond = 'c05') AS c05, bool_or(ok) FILTER (WHERE cond = 'c1') AS c1 FROM outcomes GROUP BY row_id""")
def condition_pivot(spark, folder):
    return O.condition_pivot(V.outcomes(spark, folder), V.CONDITIONS)


@query("O02_outcome_shares", _O + f"SELECT old_type, cond, count(*) AS n, {_SHARES_SQL} FROM outcomes GROUP BY ALL")
def outcome_shares(spark, folder):
    return rounded(O.outcome_shares(V.outcomes(spark, folder), ["old_type", "cond"]), *SHARES)


@query("O03_same_as_base", _O + """
  SELECT o.cond, round(avg((o.answer = b.answer)::INT), 6) AS same_share, count(*) AS n FROM outcomes o JOIN (SELECT row_id, answer FROM outcomes WHERE cond = 'base') b USING (row_id)
  WHERE o.cond <> 'base' GROUP BY o.cond""")
def same_as_base(spark, folder):
    return rounded(O.same_as_base(V.outcomes(spark, folder)), "same_share")


@query("O04_agreement", _O + """
  SELECT count(*) AS n, round(avg((a.answer IS NOT DISTINCT FROM b.answer)::INT), 6) AS agreement FROM (SELECT * FROM outcomes WHERE cond = 'c05') a JOIN (SELECT * FROM outcomes WHERE cond = 'base') b USING (row_id)""")
def agreement(spark, folder):
    o = V.outcomes(spark, folder)
    return rounded(O.guarded_agreement(o.where("cond = 'c05'"), o.where("cond = 'base'"), floor=0.2), "agreement")


@query("O05_breakdown_by_k", _O + "SELECT cond, k_correct, count(*) AS n, round(avg(ok::INT), 6) AS share_correct FROM outcomes WHERE NOT was_correct GROUP BY ALL")
def breakdown_by_k(spark, folder):
    return rounded(O.breakdown_by_k(V.outcomes(spark, folder), ~F.col("was_correct")), "share_correct")


_GAIN = ", gains AS (SELECT o.*, o.ok::INT - b.ok::INT AS gain FROM outcomes o JOIN (SELECT row_id, ok FROM outcomes WHERE cond = 'base') b USING (row_id) WHERE cond <> 'base')"


@query("O06_net_gain", _O + _GAIN + """
  SELECT cond, round(0.524::DOUBLE * avg(gain) FILTER (WHERE NOT was_correct) + 0.476::DOUBLE * avg(gain) FILTER (WHERE was_correct), 6) AS net_gain,
         round(0.524::DOUBLE * avg(gain) FILTER (WHERE NOT was_correct), 6) AS oracle_gain FROM gains GROUP BY cond""", signed=("net_gain", "oracle_gain"))
def net_gain(spark, folder):
    return rounded(O.net_gain(V.outcomes(spark, folder), 0.524, 0.476), "net_gain", "oracle_gain")


_U9 = draw_uniform_sql(0, "draw", "was_correct::INT || ':' || row_id")


@query("M09_stratified_bootstrap", _O + _GAIN + f"""
  , drawn AS (SELECT cond, draw, was_correct, gain, ({poisson_sql('u')})::DOUBLE AS w FROM (SELECT *, {_U9} AS u FROM (SELECT *, unnest(range(2000)) AS draw FROM gains)))
  , m AS (SELECT cond, draw, 0.524::DOUBLE * sum(w * gain) FILTER (WHERE NOT was_correct) / sum(w) FILTER (WHERE NOT was_correct) + 0.476::DOUBLE * sum(w * gain) FILTER (WHERE was_correct) / sum(w) FILTER (WHERE was_correct) AS m FROM drawn GROUP BY ALL)
  SELECT cond, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m GROUP BY cond""", signed=("lo", "hi"))
def stratified_bootstrap(spark, folder):
    draws = O.net_gain_draws(V.outcomes(spark, folder), 0.524, 0.476, draws=2000)
    return rounded(metrics.interval(draws, ["cond"]), "lo", "hi")


_POLICIES = {
    "none": ("false", "c05"), "all/c05": ("true", "c05"), "known/c05": ("k_correct BETWEEN 1 AND 4", "c05"), "wrong/c05": ("NOT base", "c05"),
    "wrong known/c05": ("NOT base AND k_correct BETWEEN 1 AND 4", "c05"), "all/c1": ("true", "c1"), "known/c1": ("k_correct BETWEEN 1 AND 4", "c1"),
    "wrong/c1": ("NOT base", "c1"), "wrong known/c1": ("NOT base AND k_correct BETWEEN 1 AND 4", "c1"),
}


def _policy_sql(name: str, mask: str, treated: str, rows: str = "policy_rows") -> str:
    y, mid = f"(CASE WHEN {mask} THEN {treated} ELSE base END)", "k_correct BETWEEN 1 AND 4"
    return f"""SELECT '{name}' AS policy, round(sum({y}::INT * w) / sum(w), 6) AS accuracy, round(avg({y}::INT) FILTER (WHERE {mid}), 6) AS accuracy_mid, round(sum(({mask})::INT * w) / sum(w), 6) AS treated,
      round(avg(({mask})::INT) FILTER (WHERE {mid}), 6) AS treated_mid, count(*) FILTER (WHERE {mid} AND NOT base AND {y}) AS fixed, count(*) FILTER (WHERE {mid} AND base AND NOT {y}) AS broken FROM {rows}"""


_REPORT = ["accuracy", "accuracy_mid", "treated", "treated_mid"]


@query("O07_policy_accuracy", _P + _policy_sql("low p_mid", "p_mid < 0.5", "c1") + " UNION ALL " + _policy_sql("low p_all", "p_all < 10", "c05"))
def policy_accuracy(spark, folder):
    policies = {"low p_mid": (F.col("p_mid") < 0.5, "c1"), "low p_all": (F.col("p_all") < 10, "c05")}
    return rounded(O.policy_report(V.policy_rows(spark, folder), policies), *_REPORT)


@query("O08_reference_policies", _P + " UNION ALL ".join(_policy_sql(n, m, c) for n, (m, c) in _POLICIES.items()))
def reference_policies(spark, folder):
    return rounded(O.policy_report(V.policy_rows(spark, folder), O.reference_policies(["c05", "c1"])), *_REPORT)


@query("O08_size_weights", cte("attempts_k") + """
  , sizes AS (SELECT k_correct, count(*) AS n FROM attempts_k WHERE half = 'dev' GROUP BY 1), real AS (SELECT k_correct, count(*) AS size FROM attempts_k WHERE k_correct IN (0, 5) GROUP BY 1)
  SELECT k_correct, round(sum(coalesce(size::DOUBLE / n, 1.0)), 6) AS weight FROM attempts_k JOIN sizes USING (k_correct) LEFT JOIN real USING (k_correct) WHERE half = 'dev' GROUP BY k_correct""")
def size_weights(spark, folder):
    rows = V.attempts_k(spark, folder)
    true_sizes = rows.where(F.col("k_correct").isin(0, 5)).groupBy("k_correct").agg(F.count(F.lit(1)).alias("size"))
    weighted = O.with_size_weights(rows.where("half = 'dev'"), true_sizes)
    return rounded(weighted.groupBy("k_correct").agg(F.sum("w").alias("weight")), "weight")


_QS = [round(0.02 + 0.02 * i, 2) for i in range(49)]


def _nested_sql(score: str) -> str:
    return f"""
  , thr AS (SELECT unnest(generate_series(0, {len(_QS) - 1})) AS p, unnest(quantile_cont({score}, {_QS})) AS q, unnest({_QS})::DOUBLE AS quantile FROM policy_rows)
  , acc AS (SELECT fold, p, quantile, c, sum((CASE WHEN {score} < q THEN (CASE WHEN c = 0 THEN c05 ELSE c1 END) ELSE base END)::INT * w) AS y, sum(w) AS w
            FROM policy_rows, thr, (SELECT unnest([0, 1]) AS c) GROUP BY ALL)
  , other AS (SELECT a.fold, a.p, a.quantile, a.c, round((t.y - a.y) / (t.w - a.w), 12) AS acc FROM acc a JOIN (SELECT p, c, sum(y) AS y, sum(w) AS w FROM acc GROUP BY ALL) t USING (p, c))
  , best AS (SELECT * FROM other QUALIFY row_number() OVER (PARTITION BY fold ORDER BY acc DESC, c, p) = 1)"""


@query("O09_nested_threshold", _P + _nested_sql("p_mid") + " SELECT fold, CASE c WHEN 0 THEN 'c05' ELSE 'c1' END AS cond, quantile, p::INT AS p, round(acc, 6) AS accuracy_elsewhere FROM best")
def nested_threshold(spark, folder):
    return rounded(O.nested_threshold(V.policy_rows(spark, folder), "p_mid", _QS, ["c05", "c1"]), "accuracy_elsewhere")


@query("O09_nested_report", _P + _nested_sql("p_all") + ", chosen AS (SELECT r.*, r.p_all < t.q AS treat, b.c FROM policy_rows r JOIN best b USING (fold) JOIN thr t ON t.p = b.p) "
       + _policy_sql("nested", "treat", "(CASE WHEN c = 0 THEN c05 ELSE c1 END)", "chosen"))
def nested_report(spark, folder):
    rows = V.policy_rows(spark, folder)
    chosen = O.nested_threshold(rows, "p_all", _QS, ["c05", "c1"])
    return rounded(O.nested_report(O.apply_threshold(rows, chosen, "p_all", _QS), ["c05", "c1"]), *_REPORT)


_Q13 = _QS[::4]


@query("O10_two_score_rule", _P + f"""
  , th AS (SELECT unnest(generate_series(0, 12)) AS a, unnest(quantile_cont(p_know, {_Q13})) AS qh, unnest({_Q13})::DOUBLE AS q_high FROM policy_rows)
  , tl AS (SELECT unnest(generate_series(0, 12)) AS b, unnest(quantile_cont(p_mid, {_Q13})) AS ql, unnest({_Q13})::DOUBLE AS q_low FROM policy_rows)
  , acc AS (SELECT fold, a, b, q_high, q_low, c, sum((CASE WHEN p_know > qh AND p_mid < ql THEN (CASE WHEN c = 0 THEN c05 ELSE c1 END) ELSE base END)::INT * w) AS y, sum(w) AS w
            FROM policy_rows, th, tl, (SELECT unnest([0, 1]) AS c) GROUP BY ALL)
  , other AS (SELECT x.*, round((t.y - x.y) / (t.w - x.w), 12) AS acc FROM acc x JOIN (SELECT a, b, c, sum(y) AS y, sum(w) AS w FROM acc GROUP BY ALL) t USING (a, b, c))
  SELECT fold, CASE c WHEN 0 THEN 'c05' ELSE 'c1' END AS cond, q_high, q_low, round(acc, 6) AS accuracy_elsewhere FROM other QUALIFY row_number() OVER (PARTITION BY fold ORDER BY acc DESC, c, a, b) = 1""")
def two_score_rule(spark, folder):
    return rounded(O.two_score_rule(V.policy_rows(spark, folder), "p_know", "p_mid", _Q13, ["c05", "c1"]), "accuracy_elsewhere")


def _curve_sql(name: str, score: str) -> str:
    return f"""SELECT '{name}' AS ranking, x AS share, round((SELECT avg(base::INT) FROM mid) + sum(g * greatest(least((round(x * total) - below) / n, 1), 0)) / any_value(total), 6) AS accuracy
      FROM (SELECT s, count(*)::DOUBLE AS n, sum(gain) AS g, coalesce(sum(count(*)) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below, (SELECT count(*)::DOUBLE FROM mid) AS total
            FROM (SELECT {score} AS s, gain FROM mid) GROUP BY s), xs GROUP BY x"""


@query("O11_treated_share_curves", _P + ", mid AS (SELECT *, c1::INT - base::INT AS gain FROM policy_rows WHERE k_correct BETWEEN 1 AND 4), xs AS (SELECT unnest([.2, .4, .6, .8, 1.0])::DOUBLE AS x) "
       + " UNION ALL ".join(_curve_sql(n, s) for n, s in (("p_mid", "p_mid"), ("axis", "axis"), ("p_all", "p_all"), ("oracle", "-gain")))
       + " UNION ALL SELECT 'random', x, round((SELECT avg(base::INT) FROM mid) + round(x * (SELECT count(*) FROM mid)) / (SELECT count(*) FROM mid) * (SELECT avg(gain) FROM mid), 6) FROM xs")
def treated_share_curves(spark, folder):
    rows = selection.partly_known(V.policy_rows(spark, folder))
    return rounded(O.treated_share_curves(rows, "c1", ["p_mid", "axis", "p_all"], [.2, .4, .6, .8, 1.0]), "accuracy")


@query("O12_gate_rates", _P + """
  , t AS (SELECT quantile_cont(p_mid, 0.9) AS t FROM policy_rows WHERE base)
  SELECT round(any_value(t), 6) AS threshold, round(avg((p_mid > t)::INT) FILTER (WHERE base), 6) AS false_alarm, round(avg((p_mid > t)::INT) FILTER (WHERE NOT base), 6) AS detection FROM policy_rows, t""")
def gate_rates(spark, folder):
    return rounded(O.gate_rates(V.policy_rows(spark, folder), "p_mid", F.col("base"), ~F.col("base")), "threshold", "false_alarm", "detection")


@query("O13_donor_echo", _O + """
  , donors AS (SELECT fact, min(row_id) AS donor FROM outcomes WHERE cond = 'base' AND old_type = 'correct' GROUP BY fact)
  , targets AS (SELECT row_id, donor FROM outcomes JOIN donors USING (fact) WHERE cond = 'base' AND old_type = 'broken')
  SELECT o.cond, count(*) AS n, round(avg((o.answer = d.answer)::INT), 6) AS echo_share, round(avg(o.ok::INT), 6) AS share_correct, round(avg(b.ok::INT), 6) AS base_correct
  FROM outcomes o JOIN targets t USING (row_id) JOIN outcomes d ON d.row_id = t.donor AND d.cond = 'base' JOIN outcomes b ON b.row_id = o.row_id AND b.cond = 'base' WHERE o.cond <> 'base' GROUP BY o.cond""")
def donor_echo(spark, folder):
    rows, o = V.attempts_k(spark, folder), V.outcomes(spark, folder)
    donors = selection.same_fact_donor(rows.where("kind = 'broken'"), rows.where("kind = 'correct'"))
    return rounded(O.donor_echo(o, donors, o.where("cond = 'base'")), "echo_share", "share_correct", "base_correct")


_EDIT = ", r AS (SELECT 0 AS g, avg(p_mid) AS energy, avg((NOT c1)::INT) AS broken FROM policy_rows GROUP BY fold, k_correct)"


@query("O14_edit_size_effect", _P + _EDIT + f" SELECT n, round(rho, 6) AS spearman, (SELECT round(corr(energy, broken), 6) FROM r) AS pearson FROM ({spearman_sql('r', 'g', 'energy', 'broken')})")
def edit_size_effect(spark, folder):
    """Groups of rows stand for edit conditions: a size and an effect per group."""
    r = V.policy_rows(spark, folder).groupBy("fold", "k_correct").agg(F.avg("p_mid").alias("energy"), F.avg((~F.col("c1")).cast("double")).alias("broken"))
    p = metrics.pearson(r, "energy", "broken").select("r").scalar()
    out = metrics.spearman(r, "energy", "broken").withColumn("pearson", p).withColumnRenamed("rho", "spearman")
    return rounded(out.select("n", "spearman", "pearson"), "spearman", "pearson")


_SIDE = {i: ", ".join(f"round(avg((new_type = '{t}')::INT), 6) AS share_{t}_{i}" for t in O.TYPES) for i in (1, 2)}


@query("O15_compare_runs", _O + f"""
  SELECT * FROM (SELECT cond, {_SIDE[1]} FROM outcomes WHERE fold <= 1 GROUP BY cond) FULL JOIN (SELECT cond, {_SIDE[2]} FROM outcomes WHERE fold > 1 GROUP BY cond) USING (cond)""")
def compare_runs(spark, folder):
    o = V.outcomes(spark, folder)
    return rounded(O.compare_runs(o.where("fold <= 1"), o.where("fold > 1")), *[f"{s}_{i}" for s in SHARES for i in (1, 2)])

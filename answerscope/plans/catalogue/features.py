"""Queries on feature selection over sparse activations."""

from pyspark.sql import functions as F

from answerscope.operators import features as K
from answerscope.operators import metrics, selection
from answerscope.plans import views as V
from answerscope.plans.catalogue.metrics import auc_sql
from answerscope.plans.catalogue.registry import query, rounded
from answerscope.plans.views import cte, sql_hash
from answerscope.session import cut_lineage

_VIEW = cte("states_k", "acts")


def contrast_sql(a: str, b: str, name: str = "con") -> str:
    """One row per latent with the firing rates, moments and contrasts of two row groups."""
    def n(c):
        return f"(SELECT count(*)::DOUBLE FROM states_k WHERE {c})"

    return f"""{name} AS (SELECT *, rate_a - rate_b AS separation, ln((rate_a + 0.01::DOUBLE) / (rate_b + 0.01::DOUBLE)) AS log_ratio,
      (mean_a - mean_b) / sqrt(greatest(q_a - mean_a * mean_a, 0) / {n(a)} + greatest(q_b - mean_b * mean_b, 0) / {n(b)} + 1e-8::DOUBLE) AS welch_t FROM (
      SELECT latent, count(*) / (SELECT count(*)::DOUBLE FROM states_k) AS rate, count(*) FILTER (WHERE {a}) / {n(a)} AS rate_a, count(*) FILTER (WHERE {b}) / {n(b)} AS rate_b,
             coalesce(sum(a) FILTER (WHERE {a}), 0) / {n(a)} AS mean_a, coalesce(sum(a) FILTER (WHERE {b}), 0) / {n(b)} AS mean_b,
             coalesce(sum(a * a) FILTER (WHERE {a}), 0) / {n(a)} AS q_a, coalesce(sum(a * a) FILTER (WHERE {b}), 0) / {n(b)} AS q_b
      FROM acts JOIN states_k USING (row_id) GROUP BY latent))"""


_CB = _VIEW + ", " + contrast_sql("correct", "kind = 'broken'")


def _cb(spark, folder):
    return K.contrast(V.acts(spark, folder), V.states(spark, folder), F.col("correct"), F.col("kind") == "broken")


def _stable(df, *columns):
    """Rounded before ranking, so that engines agree on ties."""
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query("K01_firing_rate", _CB + "SELECT latent, round(rate, 6) AS rate, round(rate_a, 6) AS rate_a, round(rate_b, 6) AS rate_b FROM con")
def firing_rate(spark, folder):
    return rounded(_cb(spark, folder).select("latent", "rate", "rate_a", "rate_b"), "rate", "rate_a", "rate_b")


@query("K02_separation", _CB + "SELECT latent, round(separation, 6) AS separation FROM con", signed=('separation',))
def separation(spark, folder):
    return rounded(_cb(spark, folder).select("latent", "separation"), "separation")


@query("K03_welch_t", _CB + "SELECT latent, round(welch_t, 6) AS welch_t FROM con", signed=('welch_t',))
def welch_t(spark, folder):
    return rounded(_cb(spark, folder).select("latent", "welch_t"), "welch_t")


def _paired_sql(value: str, a: str, b: str, epsilon: str) -> str:
    return f"""
  , sizes AS (SELECT fact, count(*) FILTER (WHERE {a})::DOUBLE AS na, count(*) FILTER (WHERE {b})::DOUBLE AS nb FROM states_k GROUP BY fact HAVING na > 0 AND nb > 0)
  , gaps AS (SELECT latent, fact, coalesce(sum({value}) FILTER (WHERE {a}), 0) / any_value(na) - coalesce(sum({value}) FILTER (WHERE {b}), 0) / any_value(nb) AS g
             FROM acts JOIN states_k USING (row_id) JOIN sizes USING (fact) WHERE {a} OR {b} GROUP BY ALL)
  , filled AS (SELECT l.latent, f.fact, coalesce(g, 0) AS g FROM (SELECT DISTINCT latent FROM gaps) l CROSS JOIN sizes f LEFT JOIN gaps USING (latent, fact))
  SELECT latent, count(*)::DOUBLE AS n_facts, round(avg(g), 6) AS gap, round(avg(g) / (stddev_pop(g) / sqrt(count(*)) + {epsilon}::DOUBLE), 5) AS t FROM filled GROUP BY latent"""


def _paired(spark, folder, **kw):
    return K.paired_gap(V.acts(spark, folder), V.states(spark, folder), F.col("correct"), ~F.col("correct"), **kw)


@query("K04_paired_t", _VIEW + _paired_sql("a", "correct", "NOT correct", "1e-9"), signed=('gap', 't'))
def paired_t(spark, folder):
    return rounded(rounded(_paired(spark, folder), "gap"), "t", digits=5)


@query("K05_within_fact_gap", _VIEW + _paired_sql("1", "correct", "NOT correct", "1e-6").replace(", round(avg(g) / (stddev_pop(g) / sqrt(count(*)) + 1e-6::DOUBLE), 5) AS t", ""), signed=('gap',))
def within_fact_gap(spark, folder):
    return rounded(_paired(spark, folder, strength=False).drop("t"), "gap")


@query("K06_gap_z", _VIEW + _paired_sql("1", "kind = 'broken'", "kind = 'entity'", "1e-6"), signed=('gap', 't'))
def gap_z(spark, folder):
    out = K.paired_gap(V.acts(spark, folder), V.states(spark, folder), F.col("kind") == "broken", F.col("kind") == "entity", strength=False, epsilon=1e-6)
    return rounded(rounded(out, "gap"), "t", digits=5)


@query("K07_log_ratio", _VIEW + ", " + contrast_sql("kind = 'broken'", "kind = 'entity'") + " SELECT latent, round(log_ratio, 6) AS log_ratio FROM con", signed=('log_ratio',))
def log_ratio(spark, folder):
    out = K.contrast(V.acts(spark, folder), V.states(spark, folder), F.col("kind") == "broken", F.col("kind") == "entity")
    return rounded(out.select("latent", "log_ratio"), "log_ratio")


@query("K08_maxmin_types", _VIEW + ", " + contrast_sql("correct", "kind = 'broken'", "cb") + ", " + contrast_sql("correct", "kind = 'entity'", "ce") + """
  SELECT latent, round(least(cb.separation, ce.separation), 6) AS positive_side, round(least(-cb.separation, -ce.separation), 6) AS negative_side FROM cb JOIN ce USING (latent)""", signed=('positive_side', 'negative_side'))
def maxmin_types(spark, folder):
    out = K.worst_case_over_types(V.acts(spark, folder), V.states(spark, folder), F.col("correct"), {t: F.col("kind") == t for t in ("broken", "entity")})
    return rounded(out, "positive_side", "negative_side")


_MAXMIN = _VIEW + """
  , sizes AS (SELECT fact, k_correct, count(*) FILTER (WHERE kind = 'correct')::DOUBLE AS nc, count(*) FILTER (WHERE kind = 'entity')::DOUBLE AS ne, count(*) FILTER (WHERE kind = 'broken')::DOUBLE AS nb FROM states_k GROUP BY ALL)
  , firing AS (SELECT latent, fact, count(*) FILTER (WHERE kind = 'correct') AS oc, count(*) FILTER (WHERE kind = 'entity') AS oe, count(*) FILTER (WHERE kind = 'broken') AS ob
               FROM acts JOIN states_k USING (row_id) GROUP BY ALL)
  , filled AS (SELECT l.latent, s.*, coalesce(oc, 0) AS oc, coalesce(oe, 0) AS oe, coalesce(ob, 0) AS ob FROM (SELECT DISTINCT latent FROM acts) l CROSS JOIN sizes s LEFT JOIN firing USING (latent, fact))
  , by_k AS (SELECT latent, k_correct, avg(oc / nc - ob / nb) AS g FROM filled WHERE nc > 0 AND nb > 0 AND k_correct BETWEEN 1 AND 4 GROUP BY ALL)
  , ce AS (SELECT latent, avg(oc / nc - oe / ne) AS g FROM filled WHERE nc > 0 AND ne > 0 GROUP BY ALL), eb AS (SELECT latent, avg(oe / ne - ob / nb) AS g FROM filled WHERE ne > 0 AND nb > 0 GROUP BY ALL)
  , scored AS (SELECT latent, round(least(k.lo, ce.g), 9) AS score_correct, round(least(-k.hi, -eb.g), 9) AS score_broken, rate, rate_correct, rate_broken FROM
      (SELECT latent, min(g) AS lo, max(g) AS hi FROM by_k GROUP BY latent) k JOIN ce USING (latent) JOIN eb USING (latent)
      JOIN (SELECT latent, sum(oc + oe + ob) / sum(nc + ne + nb) AS rate, sum(oc) / sum(nc) AS rate_correct, sum(ob) / sum(nb) AS rate_broken FROM filled GROUP BY latent) r USING (latent))"""


def _maxmin(spark, folder):
    return _stable(K.worst_case_gap(V.acts(spark, folder), V.states_k(spark, folder)), "score_correct", "score_broken")


@query("K09_maxmin_by_k", _MAXMIN + "SELECT latent, round(score_correct, 6) AS score_correct, round(score_broken, 6) AS score_broken FROM scored", signed=('score_correct', 'score_broken'))
def maxmin_by_k(spark, folder):
    return rounded(_maxmin(spark, folder).select("latent", "score_correct", "score_broken"), "score_correct", "score_broken")


@query("K10_eligible", _MAXMIN + "SELECT latent, round(rate, 6) AS rate, round(rate_broken, 6) AS rate_broken FROM scored WHERE rate <= 0.2 AND rate_broken >= 0.05")
def eligible(spark, folder):
    out = K.eligible(_maxmin(spark, folder), 0.2, "rate_broken")
    return rounded(out.select("latent", "rate", "rate_broken"), "rate", "rate_broken")



@query("K11_top_features", _CB + """
  SELECT k, side, latent FROM (
    SELECT 1 AS side, latent, row_number() OVER (ORDER BY round(separation, 9) DESC, latent) AS place FROM con
    UNION ALL SELECT -1, latent, row_number() OVER (ORDER BY round(separation, 9) ASC, latent) FROM con), (SELECT unnest([1, 5, 20]) AS k) WHERE place <= k""")
def top_features(spark, folder):
    scored = _stable(_cb(spark, folder), "separation")
    out = None
    for k in (1, 5, 20):
        one = K.two_sided(scored, "separation", k).select(F.lit(k).alias("k"), "side", "latent")
        out = one if out is None else out.unionByName(one)
    return out


_PICK5 = """
  , picked AS (SELECT latent, 1 AS side FROM (SELECT latent FROM con ORDER BY round(separation, 9) DESC, latent LIMIT 5) UNION ALL SELECT latent, -1 FROM (SELECT latent FROM con ORDER BY round(separation, 9), latent LIMIT 5))"""


def _picked(spark, folder, k=5):
    return K.two_sided(_stable(_cb(spark, folder), "separation"), "separation", k)


@query("K12_on_off_score", _CB + _PICK5 + """
  SELECT row_id, coalesce(sum(side), 0)::DOUBLE AS score FROM states_k LEFT JOIN (SELECT row_id, side FROM acts JOIN picked USING (latent)) USING (row_id) GROUP BY row_id""")
def on_off_score(spark, folder):
    return K.on_off_score(V.acts(spark, folder), V.states_k(spark, folder), _picked(spark, folder)).select("row_id", "score")


_MOMENTS = """
  , moments AS (SELECT latent, s / n AS mu, sqrt(greatest(q / n - (s / n) * (s / n), 0)) AS sd FROM (
      SELECT latent, sum(a) AS s, sum(a * a) AS q, (SELECT count(*)::DOUBLE FROM states_k WHERE half = 'dev') AS n FROM acts JOIN states_k USING (row_id) WHERE half = 'dev' GROUP BY latent))"""


@query("K13_strength_score", _CB + _PICK5 + _MOMENTS + """
  , grid AS (SELECT row_id, latent, side, coalesce(a, 0) AS a FROM states_k CROSS JOIN picked LEFT JOIN acts USING (row_id, latent))
  SELECT row_id, round(sum(side * (a - coalesce(mu, 0)) / (coalesce(sd, 0) + 1e-6::DOUBLE)), 6) AS score FROM grid LEFT JOIN moments USING (latent) GROUP BY row_id""", signed=('score',))
def strength_score(spark, folder):
    acts, rows = V.acts(spark, folder), V.states_k(spark, folder)
    moments = K.feature_moments(acts, rows.where("half = 'dev'"))
    return rounded(K.strength_score(acts, rows, _picked(spark, folder), moments).select("row_id", "score"), "score")


@query("K14_scaled_sum", _CB + """
  , picked AS (SELECT latent, sign(welch_t) AS side FROM con ORDER BY round(abs(welch_t), 9) DESC, latent LIMIT 20)""" + _MOMENTS + """
  SELECT row_id, round(coalesce(sum(side * a / (coalesce(sd, 0) + 1e-6::DOUBLE)), 0), 6) AS score FROM states_k LEFT JOIN (SELECT * FROM acts JOIN picked USING (latent) LEFT JOIN moments USING (latent)) USING (row_id) GROUP BY row_id""", signed=('score',))
def scaled_sum(spark, folder):
    acts, rows = V.acts(spark, folder), V.states_k(spark, folder)
    scored = _cb(spark, folder).select("latent", F.signum("welch_t").alias("side"), F.round(F.abs("welch_t"), 9).alias("size"))
    picked = K.top_features(scored, "size", 20).select("latent", "side")
    moments = K.feature_moments(acts, rows.where("half = 'dev'"))
    return rounded(K.strength_score(acts, rows, picked, moments, centred=False).select("row_id", "score"), "score")


@query("K15_gap_score", _CB + _PICK5 + """
  SELECT row_id, round(coalesce(sum(side / 5.0::DOUBLE), 0), 6) AS gap FROM states_k LEFT JOIN (SELECT row_id, side FROM acts JOIN picked USING (latent)) USING (row_id) GROUP BY row_id""", signed=('gap',))
def gap_score(spark, folder):
    return rounded(K.gap_score(V.acts(spark, folder), V.states_k(spark, folder), _picked(spark, folder)).select("row_id", "gap"), "gap")


_EXTREME = {
    "5/5 correct vs low broken": ("correct AND k_correct >= 4", "kind = 'broken' AND k_correct <= 1"),
    "5/5 correct vs low entity": ("correct AND k_correct >= 4", "kind = 'entity' AND k_correct <= 1"),
    "low entity vs low broken": ("kind = 'entity' AND k_correct <= 1", "kind = 'broken' AND k_correct <= 1"),
    "correct vs broken": ("correct", "kind = 'broken'"),
}


def _extreme_sql() -> str:
    parts, out = [], []
    for i, (name, (a, b)) in enumerate(_EXTREME.items()):
        parts.append(f""", {contrast_sql(a, b, f"c{i}")}
  , p{i} AS (SELECT latent, -1 AS side FROM (SELECT latent FROM c{i} WHERE rate <= 0.5 AND rate_a >= 0.05 ORDER BY round(separation, 9) DESC, latent LIMIT 20)
             UNION ALL SELECT latent, 1 FROM (SELECT latent FROM c{i} WHERE rate <= 0.5 AND rate_b >= 0.05 ORDER BY round(separation, 9), latent LIMIT 20))
  , s{i} AS (SELECT row_id, coalesce(sum(side), 0)::DOUBLE AS score FROM states_k LEFT JOIN (SELECT row_id, side FROM acts JOIN p{i} USING (latent)) USING (row_id) GROUP BY row_id)
  , r{i} AS (SELECT fact, score, kind = 'broken' AS y FROM states_k JOIN s{i} USING (row_id) WHERE k_correct BETWEEN 2 AND 3 AND kind IN ('correct', 'broken'))""")
        out.append(f"SELECT '{name}' AS signal, round(avg(auc), 6) AS mean_auc, count(*) AS n_groups FROM ({auc_sql(f'r{i}', 'fact', 'score', 'y')})")
    return _VIEW + "\n".join(parts) + "\n" + " UNION ALL ".join(out)


@query("K16_extreme_signals", _extreme_sql())
def extreme_signals(spark, folder):
    acts, rows = V.acts(spark, folder), V.states_k(spark, folder)
    out = None
    for name, (a, b) in _EXTREME.items():
        scored = _stable(K.contrast(acts, rows, F.expr(a), F.expr(b)), "separation")
        first = K.top_features(K.eligible(scored, 0.5, "rate_a"), "separation", 20).select("latent", F.lit(-1).alias("side"))
        second = K.top_features(K.eligible(scored, 0.5, "rate_b"), "separation", 20, descending=False).select("latent", F.lit(1).alias("side"))
        held_out = rows.where(F.col("k_correct").between(2, 3))
        score = K.on_off_score(acts, held_out, first.unionByName(second))
        one = metrics.mean_over_groups(metrics.pair_auroc(score, "score", "kind", "correct", "broken", ["fact"])).withColumn("signal", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "mean_auc")


_DECILES = _CB + """
  , edges AS (SELECT quantile_cont(rate, [.1, .2, .3, .4, .5, .6, .7, .8, .9]) AS q FROM con WHERE rate > 0.01)
  , placed AS (SELECT latent, rate, len(list_filter(q, lambda x: x <= rate))::INT AS decile FROM con, edges)
  , wanted AS (SELECT latent FROM con ORDER BY round(separation, 9), latent LIMIT 5)
  , taken AS (SELECT latent FROM wanted UNION (SELECT latent FROM con ORDER BY round(separation, 9) DESC, latent LIMIT 5))"""
_POOL = sql_hash("'5:' || draw || ':' || latent")


@query("K17_matched_random", _DECILES + f"""
  , need AS (SELECT decile, latent AS for_latent, row_number() OVER (PARTITION BY decile ORDER BY latent) AS place FROM placed SEMI JOIN wanted USING (latent))
  , pool AS (SELECT draw, decile, latent, row_number() OVER (PARTITION BY decile, draw ORDER BY {_POOL}, latent) AS place
             FROM (SELECT *, unnest(range(20))::INT AS draw FROM placed WHERE rate > 0.01 AND latent NOT IN (SELECT latent FROM taken)))
  SELECT d.draw, for_latent, pool.latent, need.decile FROM (SELECT unnest(range(20))::INT AS draw) d CROSS JOIN need LEFT JOIN pool ON pool.draw = d.draw AND pool.decile = need.decile AND pool.place = need.place""")
def matched_random(spark, folder):
    scored = cut_lineage(_stable(_cb(spark, folder), "separation"))  # one row for each feature
    wanted = K.top_features(scored, "separation", 5, descending=False).select("latent")
    other_side = K.top_features(scored, "separation", 5).select("latent")
    return K.matched_random_features(scored.select("latent", "rate"), wanted, wanted.union(other_side).distinct(), 20)


@query("K19_specificity", _CB + _PICK5 + """
  , g AS (SELECT row_id, unnest(['low broken', 'low entity', 'mid correct', 'mid entity', 'mid broken']) AS grp, unnest([kind = 'broken' AND k_correct <= 1, kind = 'entity' AND k_correct <= 1,
          correct AND k_correct BETWEEN 2 AND 4, kind = 'entity' AND k_correct BETWEEN 2 AND 4, kind = 'broken' AND k_correct BETWEEN 2 AND 4]) AS inside FROM states_k)
  , broken_side AS (SELECT latent FROM picked WHERE side = -1)
  SELECT grp, count(DISTINCT row_id)::DOUBLE AS n_rows, round(count(latent) / (count(DISTINCT row_id) * 5.0::DOUBLE), 6) AS share_on
  FROM (SELECT * FROM g WHERE inside) LEFT JOIN (SELECT row_id, latent FROM acts JOIN broken_side USING (latent)) USING (row_id) GROUP BY grp""")
def specificity(spark, folder):
    k, kind = F.col("k_correct"), F.col("kind")
    groups = {"low broken": (kind == "broken") & (k <= 1), "low entity": (kind == "entity") & (k <= 1), "mid correct": (kind == "correct") & k.between(2, 4),
              "mid entity": (kind == "entity") & k.between(2, 4), "mid broken": (kind == "broken") & k.between(2, 4)}
    picked = _picked(spark, folder).where("side = -1")
    return rounded(K.specificity(V.acts(spark, folder), V.states_k(spark, folder), picked, groups), "share_on")


@query("K20_cap_sweep", _CB + """
  SELECT cap, count(*) FILTER (WHERE rate <= cap) AS left_over, count(*) FILTER (WHERE rate <= cap AND rate_a >= 0.05) AS candidates_a, count(*) FILTER (WHERE rate <= cap AND rate_b >= 0.05) AS candidates_b
  FROM con, (SELECT unnest([0.02, 0.05, 0.1, 0.2, 0.5])::DOUBLE AS cap) GROUP BY cap""")
def cap_sweep(spark, folder):
    return K.cap_sweep(_cb(spark, folder), [0.02, 0.05, 0.1, 0.2, 0.5])


@query("K21_step_change", _VIEW + """
  , s AS (SELECT fact AS row_id, version, latent, a FROM acts JOIN states_k USING (row_id))
  SELECT row_id, latent, round(coalesce(b.a, 0) - coalesce(x.a, 0), 6) AS d_strength, (coalesce(b.a, 0) > 0)::INT - (coalesce(x.a, 0) > 0)::INT AS d_on
  FROM (SELECT * FROM s WHERE version = 0) x FULL JOIN (SELECT * FROM s WHERE version = 1) b USING (row_id, latent)""", signed=('d_strength',))
def step_change(spark, folder):
    """The versions of a fact stand for its decoding steps."""
    steps = V.acts(spark, folder).join(V.states(spark, folder).select("row_id", "fact", "version"), "row_id").select(F.col("fact").alias("row_id"), "version", "latent", "a")
    return rounded(K.step_change(steps.where("version = 0").drop("version"), steps.where("version = 1").drop("version")), "d_strength")

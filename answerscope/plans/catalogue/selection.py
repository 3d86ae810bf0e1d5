"""Queries on row selection, states, splits and samples."""

from pyspark.sql import functions as F

from answerscope.operators import selection as S
from answerscope.plans import views as V
from answerscope.plans.catalogue.registry import long_of, query, rounded
from answerscope.plans.views import cte, sql_hash


@query("F01_partly_known", cte("attempts_k") + "SELECT row_id, fact, k_correct FROM attempts_k WHERE k_correct BETWEEN 1 AND 4")
def partly_known(spark, folder):
    return S.partly_known(V.attempts_k(spark, folder)).select("row_id", "fact", "k_correct")


@query("F02_both_outcomes", cte("attempts") + "SELECT row_id, fact, correct FROM attempts WHERE fact IN (SELECT fact FROM attempts GROUP BY fact HAVING bool_or(correct) AND NOT bool_and(correct))")
def both_outcomes(spark, folder):
    return S.with_both_outcomes(V.attempts(spark, folder)).select("row_id", "fact", "correct")


@query("F03_typed_or_mixed", cte("attempts_k") + """
  SELECT row_id FROM attempts_k WHERE (NOT correct AND kind IN ('entity', 'broken'))
  OR (k_correct BETWEEN 1 AND 4 AND fact IN (SELECT fact FROM attempts_k GROUP BY fact HAVING bool_or(correct) AND NOT bool_and(correct)))""")
def typed_or_mixed(spark, folder):
    return S.typed_or_mixed(V.attempts_k(spark, folder)).select("row_id")


_MIXED = "fact IN (SELECT fact FROM attempts_k GROUP BY fact HAVING bool_or(correct) AND NOT bool_and(correct))"


@query("F04_known_state", cte("attempts_k") + """
  SELECT row_id, CASE WHEN correct AND k_correct BETWEEN 1 AND 4 THEN 'know' WHEN correct AND k_correct = 5 THEN 'known5'
    WHEN NOT correct AND kind = 'broken' AND k_correct BETWEEN 1 AND 4 THEN 'kbw' WHEN NOT correct AND kind = 'broken' AND k_correct = 0 THEN 'dont' END AS state FROM attempts_k""")
def known_state(spark, folder):
    return V.attempts_k(spark, folder).select("row_id", S.known_state("broken").alias("state"))


@query("F05_three_way_state", cte("attempts_k") + """
  SELECT row_id, CASE WHEN correct AND k_correct = 5 THEN 'KNOW' WHEN NOT correct AND k_correct = 0 THEN 'UNK' WHEN NOT correct AND k_correct BETWEEN 1 AND 4 THEN 'KBW' END AS state FROM attempts_k""")
def three_way_state(spark, folder):
    return V.attempts_k(spark, folder).select("row_id", S.three_way_state().alias("state"))


@query("F06_effective_type", "SELECT event_id AS row_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'correct' ELSE event_type END AS kind FROM events")
def effective_type(spark, folder):
    ev = V.read(spark, folder, "events").select(F.col("event_id").alias("row_id"), F.col("event_type").alias("type3"), F.col("event_type").isin("purchase", "signup").alias("correct"))
    return ev.select("row_id", S.effective_type().alias("kind"))


@query("F07_subject_join", "SELECT o_orderkey AS row_id, c_custkey AS fact, c_nationkey AS subject FROM orders JOIN customer ON o_custkey = c_custkey")
def subject_join(spark, folder):
    orders = V.read(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("fact"))
    facts = V.read(spark, folder, "customer").select(F.col("c_custkey").alias("fact"), F.col("c_nationkey").alias("subject"))
    return S.with_subject(orders, facts).select("row_id", "fact", "subject")


@query("F08_dev_test_split", cte("attempts_k") + "SELECT half, count(*) AS n, count(DISTINCT subject) AS subjects FROM attempts_k GROUP BY half")
def dev_test_split(spark, folder):
    rows = V.attempts(spark, folder).withColumn("half", S.half())
    return rows.groupBy("half").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("subject").alias("subjects"))


@query("F09_folds", cte("attempts") + f"SELECT subject, ({sql_hash('subject::VARCHAR')} % 5)::INT AS fold, count(*) AS n FROM attempts GROUP BY ALL")
def folds(spark, folder):
    return V.attempts(spark, folder).withColumn("fold", S.fold()).groupBy("subject", "fold").agg(F.count(F.lit(1)).alias("n"))


_INNER = sql_hash("'inner:' || subject")


@query("F10_inner_folds", cte("attempts_k") + f"SELECT half, ({_INNER} % 5)::INT AS inner_fold, count(*) AS n, count(DISTINCT subject) AS subjects FROM attempts_k WHERE half = 'dev' GROUP BY ALL")
def inner_folds(spark, folder):
    rows = V.attempts(spark, folder).withColumn("half", S.half()).where("half = 'dev'").withColumn("inner_fold", S.inner_fold())
    return rows.groupBy("half", "inner_fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("subject").alias("subjects"))


def _sample_sql(seed, n, by, view="attempts_k"):
    h = sql_hash(f"'{seed}:' || row_id")
    part = f"PARTITION BY {by} " if by else ""
    return f"SELECT * FROM {view} QUALIFY row_number() OVER ({part}ORDER BY {h}, row_id) <= {n}"


@query("F11_sample_per_class", cte("attempts_k") + f"SELECT row_id, kind FROM ({_sample_sql(0, 150, 'kind')})")
def sample_per_class(spark, folder):
    return S.sample_per_class(V.attempts_k(spark, folder), 150, ["kind"]).select("row_id", "kind")


@query("F12_training_cap", cte("attempts_k") + f"SELECT row_id, fold FROM ({_sample_sql(7, 2000, '')})")
def training_cap(spark, folder):
    return S.cap_rows(V.attempts_k(spark, folder), 2000, seed=7).select("row_id", "fold")


@query("F13_share_found", "SELECT round(avg((props LIKE '%7%')::INT), 6) AS found_share FROM events")
def share_found(spark, folder):
    return rounded(S.share_found(V.read(spark, folder, "events").withColumn("found", F.col("props").contains("7")), "found"), "found_share")


@query("F13_non_zero_vectors", "SELECT vec_id AS row_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0")
def non_zero_vectors(spark, folder):
    return S.non_zero_vectors(V.states(spark, folder)).select("row_id")


@query("F13_identical_only", cte("outcomes") + """
  SELECT a.row_id FROM (SELECT * FROM outcomes WHERE cond = 'base') a JOIN (SELECT * FROM outcomes WHERE cond = 'c05') b USING (row_id) WHERE a.answer IS NOT DISTINCT FROM b.answer""")
def identical_only(spark, folder):
    o = V.outcomes(spark, folder)
    return S.identical_only(o.where("cond = 'base'"), o.where("cond = 'c05'"), ["row_id"], "answer").select("row_id")


@query("F14_same_fact_donor", cte("attempts_k") + """
  SELECT t.row_id, d.donor FROM (SELECT * FROM attempts_k WHERE kind = 'broken') t
  LEFT JOIN (SELECT fact, min(row_id) AS donor FROM attempts_k WHERE kind = 'correct' GROUP BY fact) d USING (fact)""")
def same_fact_donor(spark, folder):
    rows = V.attempts_k(spark, folder)
    return S.same_fact_donor(rows.where("kind = 'broken'"), rows.where("kind = 'correct'")).select("row_id", "donor")


_SLOT = sql_hash("'0:slot:' || row_id")
_TARGET = sql_hash("'0:target:' || row_id")
_RANK = sql_hash("'0:' || row_id")


@query("F14_same_category_donor", cte("attempts_k") + f"""
  , sizes AS (SELECT relation, count(*) AS slots FROM attempts_k WHERE kind = 'correct' GROUP BY relation)
  , donors AS (SELECT relation, fact, row_id, {_RANK} AS h, {_SLOT} % slots AS slot FROM attempts_k JOIN sizes USING (relation) WHERE kind = 'correct')
  , slotted AS (SELECT relation, slot, fact, min((h, row_id)) AS d FROM donors GROUP BY ALL)
  , s AS (SELECT *, row_number() OVER (PARTITION BY relation, slot ORDER BY d) AS r FROM slotted)
  , c AS (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY d) AS r FROM (SELECT relation, fact, min((h, row_id)) AS d FROM donors GROUP BY ALL))
  SELECT t.row_id, coalesce(CASE WHEN s1.fact <> t.fact THEN s1.d[2] END, CASE WHEN s2.fact <> t.fact THEN s2.d[2] END,
                            CASE WHEN c1.fact <> t.fact THEN c1.d[2] END, CASE WHEN c2.fact <> t.fact THEN c2.d[2] END) AS donor
  FROM (SELECT *, {_TARGET} % slots AS slot FROM attempts_k LEFT JOIN sizes USING (relation) WHERE kind = 'broken') t
  LEFT JOIN (SELECT * FROM s WHERE r = 1) s1 ON s1.relation = t.relation AND s1.slot = t.slot LEFT JOIN (SELECT * FROM s WHERE r = 2) s2 ON s2.relation = t.relation AND s2.slot = t.slot
  LEFT JOIN (SELECT * FROM c WHERE r = 1) c1 ON c1.relation = t.relation LEFT JOIN (SELECT * FROM c WHERE r = 2) c2 ON c2.relation = t.relation""")
def same_category_donor(spark, folder):
    rows = V.attempts_k(spark, folder)
    return S.same_category_donor(rows.where("kind = 'broken'"), rows.where("kind = 'correct'")).select("row_id", "donor")


@query("F15_row_guard", cte("outcomes") + """
  SELECT cond, n_rows, (SELECT count(DISTINCT row_id) FROM outcomes) AS n_all FROM (
    SELECT cond, count(DISTINCT row_id) AS n_rows FROM outcomes WHERE NOT (cond = 'c1' AND relation = 'r1') GROUP BY cond) WHERE n_rows <> (SELECT count(DISTINCT row_id) FROM outcomes)""")
def row_guard(spark, folder):
    o = V.outcomes(spark, folder).where("not (cond = 'c1' and relation = 'r1')")
    return S.uneven_conditions(o).select("cond", *long_of("n_rows", "n_all"))

"""Queries on the join types."""

from pyspark.sql import functions as F

from answerscope.operators import metrics, outcomes, selection, vectors
from answerscope.plans import views as V
from answerscope.plans.catalogue.registry import query, rounded
from answerscope.plans.views import cte
from answerscope.sources import tables as S


@query("J01_dimension_join", """
  SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def dimension_join(spark, folder):
    orders, customer, nation = (V.read(spark, folder, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), "total", digits=2)


@query("J02_left_default", "SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def left_default(spark, folder):
    joined = V.read(spark, folder, "documents").select("doc_id").join(V.read(spark, folder, "labels"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("J03_semi_join", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join(spark, folder):
    kept = V.read(spark, folder, "labels").where("quality = 1").select("doc_id")
    return V.read(spark, folder, "documents").select("doc_id", "lang").join(kept, "doc_id", "left_semi")


@query("J04_anti_join", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(spark, folder):
    return S.new_rows(V.read(spark, folder, "documents").select("doc_id", "lang"), V.read(spark, folder, "labels"), ["doc_id"])


@query("J05_aligned", cte("attempts", "scores") + "SELECT row_id, correct, round(p_mid, 6) AS p_mid FROM attempts JOIN scores USING (row_id)")
def aligned(spark, folder):
    return rounded(S.aligned(V.attempts(spark, folder), V.scores(spark, folder)).select("row_id", "correct", "p_mid"), "p_mid")


@query("J06_full_compare", cte("outcomes") + """
  SELECT row_id, a.answer AS old, b.answer AS new FROM (SELECT * FROM outcomes WHERE cond = 'base' AND relation <> 'r2') a
  FULL JOIN (SELECT * FROM outcomes WHERE cond = 'c05' AND relation <> 'r3') b USING (row_id) WHERE a.answer IS DISTINCT FROM b.answer""")
def full_compare(spark, folder):
    o = V.outcomes(spark, folder)
    a = o.where("cond = 'base' and relation <> 'r2'").select("row_id", F.col("answer").alias("old"))
    b = o.where("cond = 'c05' and relation <> 'r3'").select("row_id", F.col("answer").alias("new"))
    return a.join(b, "row_id", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("row_id", "old", "new")


@query("J07_within_fact_pairs", cte("attempts") + """
  SELECT p.fact, count(*) AS pairs, round(avg(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6) AS auc
  FROM attempts p JOIN attempts n ON p.fact = n.fact AND p.correct AND NOT n.correct GROUP BY p.fact""")
def within_fact_pairs(spark, folder):
    per = metrics.auroc(V.attempts(spark, folder), "score", F.col("correct"), ["fact"])
    return rounded(per.select("fact", (F.col("positives") * F.col("negatives")).alias("pairs"), "auc"), "auc")


@query("J08_other_fact_same_relation", cte("attempts_k") + """
  SELECT row_id, EXISTS (SELECT 1 FROM attempts_k d WHERE d.kind = 'correct' AND d.relation = t.relation AND d.fact <> t.fact) AS has_donor
  FROM attempts_k t WHERE kind = 'broken'""")
def other_fact_same_relation(spark, folder):
    rows = V.attempts_k(spark, folder)
    donors = selection.same_category_donor(rows.where("kind = 'broken'"), rows.where("kind = 'correct'"))
    return donors.select("row_id", F.col("donor").isNotNull().alias("has_donor"))


@query("J09_all_pairs_mean", cte("dims") + """
  , d AS (SELECT fact, k_correct, dim, avg(x) FILTER (WHERE correct) - avg(x) FILTER (WHERE NOT correct) AS v FROM dims WHERE k_correct BETWEEN 1 AND 4 GROUP BY ALL)
  , u AS (SELECT fact, dim, v / sqrt(sum(v * v) OVER (PARTITION BY fact)) AS v FROM d)
  SELECT (SELECT count(DISTINCT fact) FROM u) AS n_facts, round(avg(c), 6) AS mean_cosine FROM (
    SELECT a.fact, b.fact AS other, sum(a.v * b.v) AS c FROM u a JOIN u b ON a.dim = b.dim AND a.fact <> b.fact GROUP BY ALL)""", signed=('mean_cosine',))
def all_pairs_mean(spark, folder):
    rows = selection.partly_known(V.states_k(spark, folder))
    d = vectors.fact_differences(rows, F.col("correct"), ~F.col("correct")).withColumn("every", F.lit(0))
    means = vectors.pairwise_cosine_means(d, [0], "every")
    return rounded(means.select(F.col("n_first").cast("bigint").alias("n_facts"), "mean_cosine"), "mean_cosine")


@query("J10_outcome_score_join", cte("policy_rows") + "SELECT row_id, base, c05, c1, round(p_mid, 6) AS p_mid FROM policy_rows")
def outcome_score_join(spark, folder):
    return rounded(V.policy_rows(spark, folder).select("row_id", "base", "c05", "c1", "p_mid"), "p_mid")


@query("J11_parameter_grid", cte("policy_rows") + """
  SELECT t AS threshold, round(avg((p_mid < t)::INT), 6) AS treated, round(avg((CASE WHEN p_mid < t THEN c05 ELSE base END)::INT), 6) AS accuracy
  FROM policy_rows, (SELECT unnest([0.2, 0.4, 0.6, 0.8])::DOUBLE AS t) GROUP BY t""")
def parameter_grid(spark, folder):
    rows = V.policy_rows(spark, folder)
    grid = [0.2, 0.4, 0.6, 0.8]
    report = outcomes.policy_report(rows.withColumn("w", F.lit(1.0)), {str(t): (F.col("p_mid") < t, "c05") for t in grid})
    return rounded(report.select(F.col("policy").cast("double").alias("threshold"), "treated", "accuracy"), "treated", "accuracy")


@query("J12_fold_direction_join", cte("dims") + """
  , b AS (SELECT f.fold, dim, avg(x) FILTER (WHERE correct) - avg(x) FILTER (WHERE NOT correct) AS v FROM dims d JOIN (SELECT DISTINCT fold FROM dims) f ON d.fold <> f.fold GROUP BY ALL)
  , u AS (SELECT fold, dim, v / sqrt(sum(v * v) OVER (PARTITION BY fold)) AS v FROM b)
  SELECT row_id, round(sum(x * v), 6) AS axis FROM dims JOIN u USING (fold, dim) GROUP BY row_id""", signed=('axis',))
def fold_direction_join(spark, folder):
    rows = V.states_k(spark, folder)
    held_out = F.explode(F.array_remove(F.array(*[F.lit(g) for g in range(5)]), F.col("fold")))
    training = rows.withColumn("fold", held_out)
    directions = vectors.pooled_direction(training, F.col("correct"), ~F.col("correct"), ["fold"])
    return rounded(vectors.projection(rows, directions).select("row_id", "axis"), "axis")

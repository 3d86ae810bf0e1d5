"""Queries on fitted probes; scores are checked against the optimality conditions in the tests."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from answerscope.operators import features as K
from answerscope.operators import grouped as N
from answerscope.operators import metrics, selection
from answerscope.operators import probes as P
from answerscope.plans import views as V
from answerscope.plans.catalogue.registry import query, rounded
from answerscope.plans.views import cte


def _rows(spark, folder):
    return P.with_vector(V.states_k(spark, folder), "h")


def _scored(df, *extra):
    return rounded(df.select("row_id", *extra, "score"), "score", digits=4)


@query("P01_logistic_probe")
def logistic_probe(spark, folder):
    rows = _rows(spark, folder)
    probe = P.fit_logistic(rows.where("half = 'dev'"), F.col("correct"), 0.01)
    return _scored(probe.score(rows.where("half = 'test'")))


@query("P02_balanced_logistic")
def balanced_logistic(spark, folder):
    rows = _rows(spark, folder).withColumn("state", selection.known_state("broken")).where(F.col("state").isNotNull())
    probe = P.fit_logistic(rows.where("half = 'dev'"), F.col("state") == "kbw", 0.0003, balanced=True)
    return _scored(probe.score(rows.where("half = 'test'")), "state")


@query("P03_multinomial")
def multinomial(spark, folder):
    rows = _rows(spark, folder).withColumn("state", selection.three_way_state()).where(F.col("state").isNotNull())
    probe = P.fit_multinomial(selection.sample_per_class(rows.where("half = 'dev'"), 6000, ["state"]), "state")
    out = metrics.confusion(probe.score(rows.where("half = 'test'"), "predicted"), "state", "predicted", ["KNOW", "UNK", "KBW"])
    return rounded(out, "pred_KNOW", "pred_UNK", "pred_KBW", "recall", "balanced_accuracy")


@query("P04_ridge")
def ridge(spark, folder):
    rows = _rows(spark, folder)
    dev = rows.where("half = 'dev'")
    alpha, _ = P.choose_ridge(dev, F.col("k_correct"), selection.inner_fold(n=4) == 0, [30.0, 300.0, 3000.0])
    return _scored(P.fit_ridge(dev, F.col("k_correct"), alpha).score(rows.where("half = 'test'")), F.lit(alpha).alias("alpha"))


_TERMS = cte("qa") + """
  , t AS (SELECT sample_id || ':' || version AS d, regexp_extract_all(lower(question), '[\\p{L}\\p{N}_]{2,}') AS w FROM qa)
  , terms AS (SELECT d, unnest(w) AS term FROM t UNION ALL SELECT d, unnest(list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM t)
  SELECT term, round(ln((1.0 + (SELECT count(*) FROM qa)) / (1.0 + count(DISTINCT d))) + 1.0, 6) AS idf, count(*)::DOUBLE AS total FROM terms GROUP BY term HAVING count(DISTINCT d) >= 2"""


@query("P05_tfidf_terms", _TERMS)
def tfidf_terms(spark, folder):
    """Vocabulary, idf and total count; the vocabulary is far below its limit on this table."""
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer

    texts = V.qa(spark, folder).select("question")
    tokens = RegexTokenizer(inputCol="question", outputCol="a", pattern=r"(?U)\b\w\w+\b", gaps=False).transform(texts)
    terms = NGram(n=2, inputCol="a", outputCol="b").transform(tokens).select(F.concat("a", "b").alias("terms"))
    counted = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=100_000, minDF=2).fit(terms)
    frequency = IDF(inputCol="tf", outputCol="w").fit(counted.transform(terms))
    words = F.array(*[F.lit(w) for w in counted.vocabulary])
    totals = counted.transform(terms).select(F.posexplode(vector_to_array("tf")).alias("i", "n")).groupBy("i").agg(F.sum("n").alias("total"))
    n = float(frequency.numDocs)
    df = F.array(*[F.lit(float(x)) for x in frequency.docFreq])
    idf = F.log(F.lit(1.0 + n) / (F.lit(1.0) + F.get(df, F.col("i")))) + F.lit(1.0)
    return rounded(totals.select(F.get(words, F.col("i")).alias("term"), idf.alias("idf"), "total"), "idf")


@query("P05_text_probe")
def text_probe(spark, folder):
    docs = V.read(spark, folder, "documents").join(V.read(spark, folder, "labels"), "doc_id").select(F.col("doc_id").alias("row_id"), "text", (F.col("quality") == 1).alias("correct"))
    rows = docs.withColumn("half", selection.half("row_id"))
    transform = P.fit_text_features(rows.where("half = 'dev'"), "text", max_terms=5000)
    ready = transform(rows)
    probe = P.fit_logistic(ready.where("half = 'dev'"), F.col("correct"), 1.0, standardise=False, max_iter=300)
    return _scored(probe.score(ready.where("half = 'test'")))


PASSES = 12  # Newton steps written out in SQL; the last ones change nothing


def _category_sql() -> str:
    """Rows collapse to categories, so the Hessian is a diagonal with one border: the step has a closed form."""
    steps = ["""
  , n AS (SELECT count(*)::DOUBLE / (2 * count(*) FILTER (WHERE correct)) AS up, count(*)::DOUBLE / (2 * count(*) FILTER (WHERE NOT correct)) AS down FROM attempts_k WHERE half = 'dev')
  , cells AS (SELECT relation, up * count(*) FILTER (WHERE correct) AS hits, down * count(*) FILTER (WHERE NOT correct) AS misses FROM attempts_k, n WHERE half = 'dev' GROUP BY relation, up, down)
  , w0 AS (SELECT relation, hits, misses, 0::DOUBLE AS w, 0::DOUBLE AS b FROM cells)"""]
    for k in range(PASSES):
        steps.append(f"""
  , g{k} AS (SELECT *, (hits + misses) * p - hits AS g, (hits + misses) * p * (1 - p) AS s FROM (SELECT *, 1 / (1 + exp(-(w + b))) AS p FROM w{k}))
  , d{k} AS (SELECT -(sum(g) - sum(s * (w + g) / (1 + s))) / (sum(s) - sum(s * s / (1 + s))) AS d FROM g{k})
  , w{k + 1} AS MATERIALIZED (SELECT relation, hits, misses, w - (w + g + s * d) / (1 + s) AS w, b + d AS b FROM g{k}, d{k})""")
    return cte("attempts_k") + "".join(steps) + f"""
  SELECT row_id, round(coalesce(w, 0) + (SELECT any_value(b) FROM w{PASSES}), 6) AS score FROM attempts_k LEFT JOIN w{PASSES} USING (relation) WHERE half = 'test'"""


def _test_scores(rows, **fitting):
    """Scores of the test half by one model with C = 1, trained on the dev half."""
    ready = N.rows_of(rows, F.col("correct"), part=F.col("half"), keep=["row_id"])
    scored = N.score_models(ready, N.fit_models(ready, [N.Model("all", 1.0, held="test")], **fitting))
    return rounded(scored.select("row_id", "score"), "score")


@query("P06_category_probe", _category_sql(), signed=("score",))
def category_probe(spark, folder):
    rows = V.attempts_k(spark, folder)
    ready = P.fit_category_features(rows.where("half = 'dev'"), "relation")(rows)
    return _test_scores(ready.withColumn("h", vector_to_array(P.FEATURES)), balanced=True, standardise=False, centre=False)


def _confidence_sql() -> str:
    """Three unknowns: each Newton step is solved by determinants."""
    steps = ["""
  , rows_ AS (SELECT a.row_id, a.half, a.correct::INT::DOUBLE AS y, s.p_all AS x1, s.p_mid AS x2 FROM attempts_k a JOIN scores s USING (row_id))
  , m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2 FROM rows_ WHERE half = 'dev')
  , z AS MATERIALIZED (SELECT row_id, half, y, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2 FROM rows_, m)
  , w0 AS (SELECT 0::DOUBLE AS w1, 0::DOUBLE AS w2, 0::DOUBLE AS b)"""]
    for k in range(PASSES):
        steps.append(f"""
  , p{k} AS (SELECT z1, z2, 1 / (1 + exp(-(w1 * z1 + w2 * z2 + b))) AS p, y, w1, w2 FROM z, w{k} WHERE half = 'dev')
  , g{k} AS (SELECT any_value(w1) + sum((p - y) * z1) AS g1, any_value(w2) + sum((p - y) * z2) AS g2, sum(p - y) AS g3, 1 + sum(p * (1 - p) * z1 * z1) AS a,
      sum(p * (1 - p) * z1 * z2) AS b_, sum(p * (1 - p) * z1) AS c, 1 + sum(p * (1 - p) * z2 * z2) AS d, sum(p * (1 - p) * z2) AS e, sum(p * (1 - p)) AS f FROM p{k})
  , w{k + 1} AS MATERIALIZED (SELECT
      w1 - ((d * f - e * e) * g1 + (c * e - b_ * f) * g2 + (b_ * e - c * d) * g3) / (a * (d * f - e * e) - b_ * (b_ * f - c * e) + c * (b_ * e - c * d)) AS w1,
      w2 - ((c * e - b_ * f) * g1 + (a * f - c * c) * g2 + (b_ * c - a * e) * g3) / (a * (d * f - e * e) - b_ * (b_ * f - c * e) + c * (b_ * e - c * d)) AS w2,
      b - ((b_ * e - c * d) * g1 + (b_ * c - a * e) * g2 + (a * d - b_ * b_) * g3) / (a * (d * f - e * e) - b_ * (b_ * f - c * e) + c * (b_ * e - c * d)) AS b
      FROM g{k}, w{k})""")
    return cte("attempts_k", "scores") + "".join(steps) + f"""
  SELECT row_id, round(w1 * z1 + w2 * z2 + b, 6) AS score FROM z, w{PASSES} WHERE half = 'test'"""


@query("P07_confidence_probe", _confidence_sql(), signed=("score",))
def confidence_probe(spark, folder):
    rows = V.attempts_k(spark, folder).join(V.scores(spark, folder), "row_id")
    return _test_scores(rows.withColumn("h", F.array("p_all", "p_mid")))


def _sparse(spark, folder, k, picked_on="true"):
    acts, rows = V.acts(spark, folder), V.states_k(spark, folder)
    t = K.paired_gap(acts, rows.where(picked_on), F.col("correct"), ~F.col("correct")).withColumn("size", F.round(F.abs("t"), 6))
    top = K.top_features(t, "size", k).select("latent", (F.col("place") - 1).alias("place"))
    return P.sparse_features(acts, rows, top, log=True, centre_by="fact"), top


@query("P08_sparse_features", cte("states_k", "acts") + """
  , sizes AS (SELECT fact, count(*) FILTER (WHERE correct)::DOUBLE AS na, count(*) FILTER (WHERE NOT correct)::DOUBLE AS nb FROM states_k GROUP BY fact HAVING na > 0 AND nb > 0)
  , gaps AS (SELECT latent, fact, coalesce(sum(a) FILTER (WHERE correct), 0) / any_value(na) - coalesce(sum(a) FILTER (WHERE NOT correct), 0) / any_value(nb) AS g FROM acts JOIN states_k USING (row_id) JOIN sizes USING (fact) GROUP BY ALL)
  , filled AS (SELECT l.latent, coalesce(g, 0) AS g FROM (SELECT DISTINCT latent FROM gaps) l CROSS JOIN sizes f LEFT JOIN gaps USING (latent, fact))
  , top AS (SELECT latent, row_number() OVER (ORDER BY round(abs(avg(g) / (stddev_pop(g) / sqrt(count(*)) + 1e-9::DOUBLE)), 6) DESC, latent) - 1 AS place FROM filled GROUP BY latent QUALIFY place < 8)
  , dense AS (SELECT row_id, fact, place, ln(1 + coalesce(a, 0)) AS v FROM states_k CROSS JOIN top LEFT JOIN acts USING (row_id, latent))
  SELECT row_id, place, round(v - avg(v) OVER (PARTITION BY fact, place), 6) AS v FROM dense""", signed=("v",))
def sparse_features(spark, folder):
    ready, _ = _sparse(spark, folder, 8)
    return rounded(ready.select("row_id", F.posexplode(vector_to_array(P.FEATURES)).alias("place", "v")).withColumn("place", F.col("place").cast("bigint")), "v")


@query("P08_sparse_probe")
def sparse_probe(spark, folder):
    ready, _ = _sparse(spark, folder, 32, "half = 'dev'")
    probe = P.fit_logistic(ready.where("half = 'dev'"), F.col("correct"), 0.03, centre=False, max_iter=300)
    return _scored(probe.score(ready.where("half = 'test'")))


@query("P09_axis_probe")
def axis_probe(spark, folder):
    rows = _rows(spark, folder)
    ends = rows.where("(correct and k_correct >= 4) or (not correct and k_correct <= 1)")
    train = selection.sample_per_class(ends.where("half = 'dev'"), 3000, ["correct"])
    scored = P.fit_logistic(train, F.col("correct"), 0.01).score(rows)
    out = metrics.reference_scaled(scored, "score", F.col("k_correct") <= 1, F.col("k_correct") >= 4)
    return rounded(out.select("row_id", "position"), "position", digits=4)


@query("P10_cross_fit")
def cross_fit(spark, folder):
    rows = _rows(spark, folder)
    out = P.cross_fit(rows, lambda train: P.fit_logistic(train, F.col("correct"), 0.001), train_rows=F.col("k_correct").between(1, 4), name="p_mid")
    return rounded(out.select("row_id", "fold", "p_mid"), "p_mid", digits=4)


@query("P11_configuration_sweep")
def configuration_sweep(spark, folder):
    """All configurations and folds are fitted together."""
    dev = selection.partly_known(V.states_k(spark, folder).where("half = 'dev'"))
    rows = N.rows_of(dev, F.col("correct"), part=selection.inner_fold(n=5), keep=["row_id", "fact", "correct"])
    table = N.sweep(rows, {f"raw-lr|C{c}": c for c in (0.0003, 0.003, 0.03)}, 5)
    return rounded(metrics.best_per_family(table, F.substring("name", 1, 6), "name", "score", "position"), "best", digits=4)


@query("P12_layer_step_sweep")
def layer_step_sweep(spark, folder):
    """Quarters of the vector stand for layers, wordings for steps; all slices are fitted together."""
    layers, steps = range(4), [0, 1]
    quarters = F.posexplode(F.array(*[F.slice("h", layer * 16 + 1, 16) for layer in layers])).alias("layer", "h")
    sliced = V.states_k(spark, folder).select("row_id", "half", "correct", (F.col("version") % 2).alias("step"), quarters)
    rows = N.rows_of(sliced, F.col("correct"), slice_by=F.concat_ws("/", "layer", "step"), part=F.col("half"), keep=["row_id", "correct"])
    per_slice = N.slice_sweep(rows, [f"{layer}/{step}" for layer in layers for step in steps], 0.01)
    name = F.split("slice", "/")
    per_slice = per_slice.select(F.get(name, F.lit(0)).cast("int").alias("layer"), F.get(name, F.lit(1)).cast("int").alias("step"), "auc")
    return rounded(per_slice.groupBy("layer").pivot("step", steps).agg(F.first("auc")), "0", "1", digits=4)

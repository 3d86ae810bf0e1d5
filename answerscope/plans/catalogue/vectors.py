"""Queries on dense states."""

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from answerscope.functions import vectors as VF
from answerscope.operators import features as K
from answerscope.operators import metrics, selection
from answerscope.operators import vectors as O
from answerscope.operators.order import attach_one_row
from answerscope.plans import views as V
from answerscope.plans.catalogue.features import contrast_sql
from answerscope.plans.catalogue.registry import query, rounded
from answerscope.plans.views import cte, sql_hash
from answerscope.session import cut_lineage

_DIMS = cte("dims")
_MIDK = "k_correct BETWEEN 1 AND 4"


def _unit_sql(rows: str, by: str) -> str:
    return f"SELECT {by}, dim, v / sqrt(sum(v * v) OVER (PARTITION BY {by})) AS v FROM {rows}"


def _fact_diff(a: str, b: str, where: str = "true") -> str:
    return f"""SELECT fact, k_correct, dim, avg(x) FILTER (WHERE {a}) - avg(x) FILTER (WHERE {b}) AS v FROM dims WHERE {where} GROUP BY ALL
      HAVING count(*) FILTER (WHERE {a}) > 0 AND count(*) FILTER (WHERE {b}) > 0"""


def _exploded(df, *keys, vector="direction", name="v"):
    return rounded(df.select(*keys, F.posexplode(vector).alias("dim", name)).withColumn("dim", F.col("dim") + 1).withColumn("dim", F.col("dim").cast("bigint")), name)


def _mid(spark, folder):
    return selection.partly_known(V.states_k(spark, folder))


# ---- the dictionary: one feature per label, from the label means ----------------
_DICT = """
  , w AS (SELECT label AS latent, dim, avg(x) AS w FROM dims GROUP BY ALL), bdec AS (SELECT dim, avg(x) AS b FROM dims GROUP BY dim)
  , pre AS (SELECT row_id, latent, sum((x - b) * w) AS p FROM dims JOIN bdec USING (dim) JOIN w USING (dim) GROUP BY ALL)
  , enc AS (SELECT row_id, latent, p AS a FROM pre WHERE p > 0.002::DOUBLE)"""
_RECON = _DICT + """
  , r AS (SELECT d.row_id, d.dim, d.x, bdec.b + coalesce(s.s, 0) AS r FROM dims d JOIN bdec USING (dim)
          LEFT JOIN (SELECT row_id, dim, sum(a * w) AS s FROM enc JOIN w USING (latent) GROUP BY ALL) s USING (row_id, dim))"""


def dictionary(spark, folder, latent="label"):
    rows = V.states(spark, folder)
    means = O.mean_vectors(rows.withColumn("latent", F.expr(latent)), ["latent"])
    table = means.select("latent", F.col("mean").alias("w_enc"), F.lit(0.0).alias("b_enc"), F.lit(0.002).alias("threshold"), F.col("mean").alias("w_dec"))
    return O.Dictionary(table, O.mean_vectors(rows).first()["mean"])


@query("V01_sparse_encode", _DIMS + _DICT + " SELECT row_id, latent::INT AS latent, round(a, 6) AS a FROM enc", signed=("a",))
def sparse_encode(spark, folder):
    return rounded(O.encode(V.states(spark, folder), dictionary(spark, folder)), "a")


@query("V02_reconstruct", _DIMS + _RECON + """
  SELECT row_id, (SELECT count(*) FROM enc e WHERE e.row_id = r.row_id) AS active, round(sqrt(sum((x - r) * (x - r))), 6) AS residual FROM r GROUP BY row_id""")
def reconstruct(spark, folder):
    out = O.reconstruct(V.states(spark, folder).select("row_id", "h"), dictionary(spark, folder))
    return rounded(out.select("row_id", "active", VF.norm(F.col("e")).alias("residual")), "residual")


@query("V03_unexplained_share", _DIMS + _RECON + """
  , per AS (SELECT row_id, sum(x * r) / sqrt(sum(x * x) * sum(r * r)) AS c FROM r GROUP BY row_id)
  SELECT (SELECT count(*) FROM per) AS n, round(sum((x - r) * (x - r)) / sum((x - b) * (x - b)), 6) AS fvu, round((SELECT avg(c) FROM per), 6) AS mean_cosine FROM r JOIN bdec USING (dim)""")
def unexplained_share(spark, folder):
    out = O.unexplained_share(O.reconstruct(V.states(spark, folder).select("row_id", "h"), dictionary(spark, folder)))
    return rounded(out, "fvu", "mean_cosine")


@query("V04_group_centring", _DIMS + """
  SELECT row_id, round(sqrt(sum(c * c)), 6) AS size FROM (SELECT row_id, x - avg(x) OVER (PARTITION BY fact, dim) AS c FROM dims) GROUP BY row_id""")
def group_centring(spark, folder):
    return rounded(O.centred(V.states(spark, folder)).select("row_id", VF.norm(F.col("centred")).alias("size")), "size")


@query("V05_within_fact_direction", _DIMS + f"""
  , d AS ({_fact_diff('correct', 'NOT correct', _MIDK)}), m AS (SELECT 0 AS g, dim, avg(v) AS v FROM d GROUP BY dim)
  SELECT dim, round(v, 6) AS v FROM ({_unit_sql('m', 'g')})""", signed=("v",))
def within_fact_direction(spark, folder):
    return _exploded(O.within_fact_direction(_mid(spark, folder), F.col("correct"), ~F.col("correct")))


@query("V06_pooled_direction", _DIMS + f"""
  , m AS (SELECT 0 AS g, dim, avg(x) FILTER (WHERE correct) - avg(x) FILTER (WHERE kind = 'broken') AS v FROM dims GROUP BY dim)
  SELECT dim, round(v, 6) AS v FROM ({_unit_sql('m', 'g')})""", signed=("v",))
def pooled_direction(spark, folder):
    return _exploded(O.pooled_direction(V.states_k(spark, folder), F.col("correct"), F.col("kind") == "broken"))


@query("V07_within_category_direction", _DIMS + f"""
  , per AS (SELECT relation, dim, avg(x) FILTER (WHERE k_correct >= 4) - avg(x) FILTER (WHERE k_correct <= 1) AS v, least(count(*) FILTER (WHERE k_correct >= 4), count(*) FILTER (WHERE k_correct <= 1)) AS w
            FROM dims GROUP BY ALL HAVING w >= 20), m AS (SELECT 0 AS g, dim, sum(v * w) / sum(w) AS v FROM per GROUP BY dim)
  SELECT dim, round(v, 6) AS v FROM ({_unit_sql('m', 'g')})""", signed=("v",))
def within_category_direction(spark, folder):
    return _exploded(O.within_category_direction(V.states_k(spark, folder), F.col("k_correct") >= 4, F.col("k_correct") <= 1))


@query("V08_orthogonal_control", _DIMS + f"""
  , b AS (SELECT 0 AS g, dim, avg(x) FILTER (WHERE correct) - avg(x) FILTER (WHERE kind = 'broken') AS v FROM dims GROUP BY dim), bu AS ({_unit_sql('b', 'g')})
  , e AS (SELECT 0 AS g, dim, avg(x) FILTER (WHERE correct) - avg(x) FILTER (WHERE kind = 'entity') AS v FROM dims GROUP BY dim), eu AS ({_unit_sql('e', 'g')})
  , c AS (SELECT sum(bu.v * eu.v) AS c FROM bu JOIN eu USING (dim))
  SELECT dim, round(eu.v - c * bu.v, 6) AS control, round((bu.v + eu.v) / sqrt(sum((bu.v + eu.v) * (bu.v + eu.v)) OVER ()), 6) AS composed FROM bu JOIN eu USING (dim), c""", signed=("control", "composed"))
def orthogonal_control(spark, folder):
    rows = V.states_k(spark, folder)
    b = O.pooled_direction(rows, F.col("correct"), F.col("kind") == "broken").select(F.lit(0).alias("g"), F.col("direction").alias("b"))
    e = O.pooled_direction(rows, F.col("correct"), F.col("kind") == "entity").select(F.lit(0).alias("g"), F.col("direction").alias("e"))
    both = O.orthogonal_to(b.join(e, "g"), "e", "b").withColumn("composed", VF.unit(VF.add_scaled(F.col("b"), F.col("e"), F.lit(1.0))))
    zipped = both.select(F.posexplode(F.arrays_zip("control", "composed")).alias("dim", "z"))
    return rounded(zipped.select((F.col("dim") + 1).cast("bigint").alias("dim"), "z.control", "z.composed"), "control", "composed")


@query("V09_direction_cosines", _DIMS + f"""
  , d AS ({_fact_diff('correct', 'NOT correct', _MIDK)}), m AS (SELECT k_correct, dim, avg(v) AS v FROM d GROUP BY ALL), u AS ({_unit_sql('m', 'k_correct')})
  SELECT a.k_correct::INT AS first, b.k_correct::INT AS second, round(sum(a.v * b.v), 6) AS cosine FROM u a JOIN u b ON a.dim = b.dim AND a.k_correct < b.k_correct GROUP BY ALL""", signed=("cosine",))
def direction_cosines(spark, folder):
    directions = O.within_fact_direction(_mid(spark, folder), F.col("correct"), ~F.col("correct"), ["k_correct"]).withColumn("k_correct", F.col("k_correct").cast("int"))
    return rounded(O.direction_cosines(directions, "k_correct", [1, 2, 3, 4]), "cosine")


_HALF = sql_hash("'0:' || draw || ':' || fact")


@query("V09_split_half", _DIMS + f"""
  , d AS ({_fact_diff('correct', 'NOT correct', _MIDK)}), f AS (SELECT DISTINCT fact, k_correct FROM d)
  , h AS (SELECT k_correct, draw, fact, (row_number() OVER (PARTITION BY k_correct, draw ORDER BY {_HALF}, draw || ':' || fact) <= count(*) OVER (PARTITION BY k_correct, draw) // 2) AS side
          FROM (SELECT *, unnest(range(20))::INT AS draw FROM f))
  , m AS (SELECT k_correct, draw, side, dim, sum(v) AS v FROM d JOIN h USING (k_correct, fact) GROUP BY ALL), u AS ({_unit_sql('m', 'k_correct, draw, side')})
  SELECT k_correct, draw, round(sum(a.v * b.v), 6) AS cosine FROM (SELECT * FROM u WHERE side) a JOIN (SELECT * FROM u WHERE NOT side) b USING (k_correct, draw, dim) GROUP BY ALL""", signed=("cosine",))
def split_half(spark, folder):
    return rounded(O.split_half_cosine(_mid(spark, folder), F.col("correct"), ~F.col("correct"), "k_correct"), "cosine")


_NULL = sql_hash("'100:' || draw || ':' || row_id")


@query("V09_shuffled_null", _DIMS + f"""
  , p AS (SELECT row_id, fact, k_correct, draw, row_number() OVER (PARTITION BY draw, fact ORDER BY {_NULL}, draw || ':' || row_id) <= k_correct AS y
          FROM (SELECT DISTINCT row_id, fact, k_correct, unnest(range(3))::INT AS draw FROM states_k WHERE {_MIDK}))
  , d AS (SELECT draw, p.fact, p.k_correct, dim, avg(x) FILTER (WHERE y) - avg(x) FILTER (WHERE NOT y) AS v FROM p JOIN dims USING (row_id) GROUP BY draw, p.fact, p.k_correct, dim)
  , m AS (SELECT draw, k_correct, dim, avg(v) AS v FROM d GROUP BY ALL), u AS ({_unit_sql('m', 'draw, k_correct')})
  SELECT a.draw, a.k_correct::INT AS first, b.k_correct::INT AS second, round(sum(a.v * b.v), 6) AS cosine FROM u a JOIN u b ON a.draw = b.draw AND a.dim = b.dim AND a.k_correct < b.k_correct GROUP BY ALL""", signed=("cosine",))
def shuffled_null(spark, folder):
    shuffled = metrics.shuffled_labels(_mid(spark, folder), "row_id", ["fact"], F.col("correct"), draws=3)
    directions = O.within_fact_direction(shuffled, F.col("shuffled"), ~F.col("shuffled"), ["draw", "k_correct"], draw=["draw"])
    directions = cut_lineage(directions.select("draw", F.col("k_correct").cast("int").alias("k"), "direction"))  # four rows a draw
    a, b = (directions.select("draw", F.col("k").alias(name), F.col("direction").alias(f"__{name}")) for name in ("first", "second"))
    pairs = a.join(b, "draw").where("first < second")
    return rounded(pairs.select("draw", "first", "second", VF.cosine(F.col("__first"), F.col("__second")).alias("cosine")), "cosine")


@query("V10_pairwise_cosine", _DIMS + f"""
  , d AS ({_fact_diff('correct', 'NOT correct', _MIDK)}), u AS ({_unit_sql('d', 'fact, k_correct')}), n AS (SELECT k_correct, count(DISTINCT fact)::DOUBLE AS n FROM u GROUP BY 1)
  , c AS (SELECT a.k_correct AS ka, b.k_correct AS kb, a.fact AS fa, b.fact AS fb, sum(a.v * b.v) AS c FROM u a JOIN u b ON a.dim = b.dim AND a.fact <> b.fact AND a.k_correct <= b.k_correct GROUP BY ALL)
  SELECT ka::INT AS first, kb::INT AS second, any_value(x.n) AS n_first, any_value(y.n) AS n_second, round(avg(c), 6) AS mean_cosine FROM c JOIN n x ON x.k_correct = ka JOIN n y ON y.k_correct = kb GROUP BY ka, kb""", signed=("mean_cosine",))
def pairwise_cosine(spark, folder):
    d = O.fact_differences(_mid(spark, folder), F.col("correct"), ~F.col("correct")).withColumn("k_correct", F.col("k_correct").cast("int"))
    return rounded(O.pairwise_cosine_means(d, [1, 2, 3, 4]), "mean_cosine")


@query("V11_leave_one_out", _DIMS + f"""
  , d AS ({_fact_diff('correct', 'NOT correct', _MIDK)}), o AS (SELECT fact, k_correct, dim, v AS d, sum(v) OVER (PARTITION BY dim) - v AS v FROM d)
  , u AS (SELECT fact, k_correct, dim, d, v / sqrt(sum(v * v) OVER (PARTITION BY fact)) AS v FROM o)
  , f AS (SELECT fact, k_correct, sqrt(sum(d * d)) AS size, sum(d * v) AS projection FROM u GROUP BY ALL)
  SELECT k_correct, count(*) AS n, round(avg(size), 6) AS mean_size, round(avg(projection / size), 6) AS mean_cosine, round(avg((projection > 0)::INT), 6) AS share_positive,
         round(avg(projection * projection / (size * size)), 6) AS energy_share, round(avg(projection), 6) AS mean_projection FROM f GROUP BY k_correct""", signed=("mean_cosine", "mean_projection"))
def leave_one_out(spark, folder):
    per = O.leave_one_out(O.fact_differences(_mid(spark, folder), F.col("correct"), ~F.col("correct")))
    out = per.groupBy("k_correct").agg(
        F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean_size"), F.avg("cosine").alias("mean_cosine"), F.avg((F.col("cosine") > 0).cast("double")).alias("share_positive"),
        F.avg("energy_share").alias("energy_share"), F.avg("projection").alias("mean_projection"))
    return rounded(out, "mean_size", "mean_cosine", "share_positive", "energy_share", "mean_projection")


@query("V12_projection", _DIMS + f"""
  , t AS (SELECT g, d.* FROM (SELECT unnest(range(5))::INT AS g) f JOIN dims d ON d.fold <> g WHERE {_MIDK})
  , d AS (SELECT g, fact, dim, avg(x) FILTER (WHERE correct) - avg(x) FILTER (WHERE NOT correct) AS v FROM t GROUP BY ALL), m AS (SELECT g, dim, avg(v) AS v FROM d GROUP BY ALL), u AS ({_unit_sql('m', 'g')})
  SELECT row_id, round(sum(x * v), 6) AS axis FROM dims JOIN u ON u.g = dims.fold AND u.dim = dims.dim GROUP BY row_id""", signed=("axis",))
def projection(spark, folder):
    rows = V.states_k(spark, folder)
    held_out = F.explode(F.array_remove(F.array(*[F.lit(g) for g in range(5)]), F.col("fold")))
    training = selection.partly_known(rows).withColumn("fold", held_out)
    directions = O.within_fact_direction(training, F.col("correct"), ~F.col("correct"), ["fold"], draw=["fold"])
    return rounded(O.projection(rows, directions).select("row_id", "axis"), "axis")


_B = f", b AS (SELECT 0 AS g, dim, avg(x) FILTER (WHERE correct) - avg(x) FILTER (WHERE kind = 'broken') AS v FROM dims GROUP BY dim), bu AS ({_unit_sql('b', 'g')})"


def _with_direction(spark, folder):
    rows = V.states_k(spark, folder)
    direction = O.pooled_direction(rows, F.col("correct"), F.col("kind") == "broken").select(F.col("direction").alias("b"))
    return attach_one_row(rows, direction)


@query("V13_vector_edits", _DIMS + _B + """
  , s AS (SELECT row_id, x, bu.v, sum(x * bu.v) OVER (PARTITION BY row_id) AS along, sqrt(sum(x * x) OVER (PARTITION BY row_id)) AS size FROM dims JOIN bu USING (dim))
  SELECT row_id, round(sqrt(sum((x + 0.5 * size * v) * (x + 0.5 * size * v))), 6) AS added, round(sqrt(sum((x - along * v) * (x - along * v))), 6) AS removed,
         round(sqrt(sum((x - (along - 0.1) * v) * (x - (along - 0.1) * v))), 6) AS shifted FROM s GROUP BY row_id""")
def vector_edits(spark, folder):
    rows = _with_direction(spark, folder).withColumn("size", VF.norm(F.col("h")))
    edited = O.add_direction(rows, F.col("b"), F.lit(0.5) * F.col("size"), name="up")
    edited = O.remove_along(O.remove_along(edited, F.col("b"), name="off"), F.col("b"), offset=0.1, name="moved")
    return rounded(edited.select("row_id", VF.norm(F.col("up")).alias("added"), VF.norm(F.col("off")).alias("removed"), VF.norm(F.col("moved")).alias("shifted")), "added", "removed", "shifted")


@query("V13_donor_replacement", _DIMS + """
  , first AS (SELECT fact, min(row_id) AS donor FROM states_k WHERE correct GROUP BY fact)
  , t AS (SELECT row_id, coalesce(donor, row_id) AS donor FROM states_k LEFT JOIN first USING (fact) WHERE kind = 'broken')
  SELECT t.row_id, round(sum(x), 6) AS total FROM t JOIN dims ON dims.row_id = t.donor GROUP BY t.row_id""", signed=("total",))
def donor_replacement(spark, folder):
    rows = V.states_k(spark, folder)
    targets = selection.same_fact_donor(rows.where("kind = 'broken'"), rows.where(F.col("correct")))
    out = O.replace_by_donor(targets, rows)
    total = F.aggregate(F.col("edited").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x)
    return rounded(out.select("row_id", total.alias("total")), "total")


@query("V13_remove_features", _DIMS + _DICT + """
  , own AS (SELECT row_id, dim, sum(a * w) AS s FROM enc JOIN w USING (latent) WHERE latent IN (0, 1, 2) GROUP BY ALL)
  SELECT row_id, round(sqrt(sum((x - coalesce(s, 0)) * (x - coalesce(s, 0)))), 6) AS size FROM dims LEFT JOIN own USING (row_id, dim) GROUP BY row_id""")
def remove_features(spark, folder):
    out = O.remove_features(V.states(spark, folder).select("row_id", "h"), dictionary(spark, folder), [0, 1, 2])
    return rounded(out.select("row_id", VF.norm(F.col("h")).alias("size")), "size")


@query("V14_removed_energy", _DIMS + """
  , w AS (SELECT label AS draw, dim, avg(x) AS w FROM dims GROUP BY ALL), wu AS (SELECT draw, dim, w / sqrt(sum(w * w) OVER (PARTITION BY draw)) AS w FROM w)
  , s AS (SELECT row_id, draw, sum(x * w) AS p, sum(x * x) AS n FROM dims JOIN wu USING (dim) GROUP BY ALL)
  SELECT draw, round(avg(p * p / n), 6) AS energy FROM s GROUP BY draw""")
def removed_energy(spark, folder):
    d = dictionary(spark, folder)
    return rounded(O.removed_share(V.states(spark, folder), d.bases({i: [i] for i in d.latents})), "energy")


@query("V15_edit_effect", _DIMS + _DICT + """
  , wu AS (SELECT dim, w / sqrt(sum(w * w) OVER ()) AS u FROM w WHERE latent = 3)
  , e AS (SELECT row_id, dim, x - u * sum(x * u) OVER (PARTITION BY row_id) AS x FROM dims JOIN wu USING (dim))
  , pre2 AS (SELECT row_id, latent, sum((x - b) * w) AS p FROM e JOIN bdec USING (dim) JOIN w USING (dim) GROUP BY ALL)
  SELECT 'before' AS state, round(count(*) / ((SELECT count(*) FROM states_k) * 1.0::DOUBLE), 6) AS share_on, round(coalesce(sum(a), 0) / ((SELECT count(*) FROM states_k) * 1.0::DOUBLE), 6) AS mean_activation FROM enc WHERE latent = 3
  UNION ALL SELECT 'after', round(count(*) / ((SELECT count(*) FROM states_k) * 1.0::DOUBLE), 6), round(coalesce(sum(p), 0) / ((SELECT count(*) FROM states_k) * 1.0::DOUBLE), 6) FROM pre2 WHERE latent = 3 AND p > 0.002::DOUBLE""")
def edit_effect(spark, folder):
    rows, d = V.states(spark, folder).select("row_id", "h"), dictionary(spark, folder)
    after = O.encode(O.remove_basis(rows, d.basis([3])), d)
    return rounded(O.edit_effect(O.encode(rows, d), after, [3], rows), "share_on", "mean_activation")


@query("V16_mean_norm", cte("states") + f"""
  , s AS (SELECT * FROM states QUALIFY row_number() OVER (ORDER BY {sql_hash("'1:' || row_id")}, row_id) <= 500)
  SELECT count(*) AS n, round(avg(sqrt(list_sum(list_transform(h, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS mean_norm FROM s""")
def mean_norm(spark, folder):
    sample = selection.cap_rows(V.states(spark, folder), 500, seed=1)
    return rounded(sample.select(VF.norm(F.col("h")).alias("n")).agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("mean_norm")), "mean_norm")


@query("V17_donor_distance", _DIMS + """
  , first AS (SELECT fact, min(row_id) AS donor FROM states_k WHERE correct GROUP BY fact), t AS (SELECT row_id, donor FROM states_k JOIN first USING (fact) WHERE kind = 'broken')
  , d AS (SELECT t.row_id, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d FROM t JOIN dims a ON a.row_id = t.row_id JOIN dims b ON b.row_id = t.donor AND b.dim = a.dim GROUP BY t.row_id)
  SELECT count(*) AS n, round(avg(d), 6) AS mean_distance FROM d""")
def donor_distance(spark, folder):
    rows = V.states_k(spark, folder)
    targets = selection.same_fact_donor(rows.where("kind = 'broken'"), rows.where(F.col("correct")))
    return rounded(O.donor_distance(targets, rows), "mean_distance")


@query("V18_step_concatenation", cte("states") + """
  SELECT fact AS row_id, sum(len(h))::BIGINT AS width, round(sum(list_sum(list_transform(h, lambda x: x::DOUBLE)) * (version + 1)), 6) AS weighted FROM states GROUP BY fact HAVING count(*) = 5""", signed=("weighted",))
def step_concatenation(spark, folder):
    """The versions of a fact stand for its decoding steps."""
    wide = O.concat_steps(V.states(spark, folder).select(F.col("fact").alias("row_id"), F.col("version").alias("step"), "h"), "row_id", "step", [0, 1, 2, 3, 4])
    h = F.col("h_all").cast("array<double>")
    fifth = (F.size(h) / 5).cast("int")

    def part(i):
        return F.aggregate(F.slice(h, fifth * i + 1, fifth), F.lit(0.0), lambda acc, x: acc + x) * (i + 1)

    return rounded(wide.select("row_id", F.size(h).cast("bigint").alias("width"), (part(0) + part(1) + part(2) + part(3) + part(4)).alias("weighted")), "weighted")


@query("V19_slot_features", cte("slots") + """
  SELECT row_id, """ + ", ".join(
    f'round(avg({c}) FILTER (WHERE step = {s}), 6) AS "{s}_{c}_mean", min({c}) FILTER (WHERE step = {s}) AS "{s}_{c}_min"' for s in range(V.STEPS) for c in ("lp", "mg")) + """
  FROM slots GROUP BY row_id""", signed=tuple(f'"{s}_lp_min"' for s in range(V.STEPS)))
def slot_features(spark, folder):
    out = O.slot_features(V.slots(spark, folder), list(range(V.STEPS)))
    return rounded(out, *[f"{s}_{c}" for s in range(V.STEPS) for c in ("lp_mean", "lp_min", "mg_mean", "mg_min")])


@query("V20_logit_summary", """
  SELECT vec_id AS row_id, round(-ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)))), 6) AS top_logprob,
         round(list_sort(embedding, 'DESC')[1]::DOUBLE - list_sort(embedding, 'DESC')[2]::DOUBLE, 6) AS margin FROM embeddings""")
def logit_summary(spark, folder):
    e = V.read(spark, folder, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("logits"))
    return rounded(O.logit_summary(e, "logits").select("row_id", "top_logprob", "margin"), "top_logprob", "margin")


SIZE_DRAWS = 2000
_FINE = "label * 5 + version"  # a dictionary of fifty features, so that deciles hold unused ones


def _size_matched_sql() -> str:
    """The wanted features and their draws are two at most, so the inverse of a set's Gram matrix is written out."""
    pool = sql_hash("'5:' || draw || ':' || latent")
    return _DIMS + _DICT.replace("label AS latent", f"{_FINE} AS latent") + ", acts AS (SELECT row_id, latent, a FROM enc), " + contrast_sql("correct", "kind = 'broken'") + f"""
  , edges AS (SELECT quantile_cont(rate, [.1, .2, .3, .4, .5, .6, .7, .8, .9]) AS q FROM con WHERE rate > 0.01)
  , placed AS (SELECT latent, rate, len(list_filter(q, lambda x: x <= rate))::INT AS decile FROM con, edges)
  , wanted AS (SELECT latent FROM con ORDER BY round(separation, 9), latent LIMIT 2)
  , need AS (SELECT decile, latent AS for_latent, row_number() OVER (PARTITION BY decile ORDER BY latent) AS place FROM placed SEMI JOIN wanted USING (latent))
  , pool AS (SELECT draw, decile, latent, row_number() OVER (PARTITION BY decile, draw ORDER BY {pool}, latent) AS place
             FROM (SELECT *, unnest(range({SIZE_DRAWS}))::INT AS draw FROM placed WHERE rate > 0.01 AND latent NOT IN (SELECT latent FROM wanted)))
  , drawn AS (SELECT d.draw, for_latent, pool.latent, need.decile FROM (SELECT unnest(range({SIZE_DRAWS}))::INT AS draw) d CROSS JOIN need
              LEFT JOIN pool ON pool.draw = d.draw AND pool.decile = need.decile AND pool.place = need.place)
  , u AS (SELECT latent, dim, w / sqrt(sum(w * w) OVER (PARTITION BY latent)) AS u FROM w)
  , p AS (SELECT row_id, latent, sum(x * u) AS p, sum(x * x) AS n FROM dims JOIN u USING (dim) GROUP BY ALL)
  , m AS (SELECT a.latent AS i, b.latent AS j, avg(a.p * b.p / a.n) AS m FROM p a JOIN p b USING (row_id) WHERE a.n > 0 GROUP BY ALL)
  , g AS (SELECT a.latent AS i, b.latent AS j, sum(a.u * b.u) AS g FROM u a JOIN u b USING (dim) GROUP BY ALL)
  , sets AS (SELECT draw, min(latent) AS i, max(latent) AS j FROM drawn WHERE latent IS NOT NULL GROUP BY draw UNION ALL SELECT -1, min(latent), max(latent) FROM wanted)
  , energy AS (SELECT draw, CASE WHEN s.i = s.j THEN mi.m ELSE (mi.m + mj.m - 2 * g.g * mij.m) / (1 - g.g * g.g) END AS energy
               FROM sets s JOIN m mi ON mi.i = s.i AND mi.j = s.i JOIN m mj ON mj.i = s.j AND mj.j = s.j JOIN m mij ON mij.i = s.i AND mij.j = s.j JOIN g ON g.i = s.i AND g.j = s.j)
  , target AS (SELECT energy AS t FROM energy WHERE draw = -1)
  SELECT * FROM drawn WHERE draw = (SELECT min(draw) FROM energy, target WHERE draw >= 0 AND abs(energy - t) <= 0.15::DOUBLE * t)"""


@query("K18_size_matched", _size_matched_sql())
def size_matched(spark, folder):
    """Random features of the same firing decile whose removal takes about as much of |h|^2 as the wanted ones.

    Nothing is returned where no draw passes."""
    rows, d = V.states_k(spark, folder), dictionary(spark, folder, _FINE)
    acts = O.encode(rows, d)
    rates = cut_lineage(K.contrast(acts, rows, F.col("correct"), F.col("kind") == "broken").select("latent", "rate", F.round("separation", 9).alias("separation")))
    wanted = K.top_features(rates, "separation", 2, descending=False).select("latent")
    draws = cut_lineage(K.matched_random_features(rates, wanted, wanted, SIZE_DRAWS, strict=False))
    every = draws.select("draw", "latent").unionByName(wanted.select(F.lit(-1).alias("draw"), "latent"))
    energy = cut_lineage(O.set_energy(rows, d, every))
    target = energy.where("draw = -1").select("energy").scalar()
    return K.size_matched_draws(draws, energy.where("draw >= 0"), target, strict=False)


@query("V05_summed_vectors", _DIMS + "SELECT kind, dim, round(sum(x), 6) AS v FROM dims GROUP BY ALL", signed=("v",))
def summed_vectors(spark, folder):
    rows = V.states_k(spark, folder)
    sums = rows.groupBy("kind").agg(vector_to_array(Summarizer.sum(O._vec("h"))).alias("direction"))
    return _exploded(sums, "kind")

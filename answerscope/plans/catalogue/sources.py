"""Queries on scans, sinks and resumable appends; round trips go through a scratch folder."""

from pyspark.sql import functions as F

from answerscope.operators import reshape
from answerscope.plans import views as V
from answerscope.plans.catalogue.registry import query, rounded
from answerscope.plans.views import cte
from answerscope.sources import npy as N
from answerscope.sources import tables as S

_DOC_SCHEMA = "doc_id long, text string, lang string, source string"


@query("S01_jsonl_scan", "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang")
def jsonl_scan(spark, folder):
    path = V.scratch(spark, "jsonl")
    S.write_jsonl(V.read(spark, folder, "documents").select("doc_id", "text", "lang", "source"), path)
    return S.read_jsonl(spark, path, _DOC_SCHEMA).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("S02_jsonl_sink", "SELECT doc_id, text, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def jsonl_sink(spark, folder):
    rows = V.read(spark, folder, "documents").select("doc_id", "text").join(V.read(spark, folder, "labels"), "doc_id", "left")
    path = V.scratch(spark, "jsonl")
    S.write_jsonl(rows, path)
    return S.read_jsonl(spark, path, "doc_id long, text string, quality int, toxic int")


@query("S03_atomic_overwrite", "SELECT doc_id, 1 - quality AS quality, toxic FROM labels")
def atomic_overwrite(spark, folder):
    path = V.scratch(spark, "table")
    S.replace_table(V.read(spark, folder, "labels"), path)
    S.update_table(spark, path, lambda table: table.withColumn("quality", 1 - F.col("quality")))
    return S.read_current(spark, path)


@query("S04_embedded_json", "SELECT event_id AS row_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 1::BIGINT AS n_aliases FROM events")
def embedded_json(spark, folder):
    ev = V.read(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k"))
    text = F.concat(F.lit("["), F.col("k"), F.lit("]"))
    aliases = reshape.parse_aliases(text)
    return ev.select(F.col("event_id").alias("row_id"), F.get(aliases, F.lit(0)).cast("bigint").alias("k"), F.size(aliases).cast("bigint").alias("n_aliases"))


@query("S05_map_documents", """
  SELECT 'names' AS part, count(*) AS n, count(DISTINCT p_name || ' ' || p_partkey) AS n_keys FROM part
  UNION ALL SELECT 'entities', count(*), count(DISTINCT p_partkey) FROM part UNION ALL SELECT 'labels', count(*), count(DISTINCT p_brand || p_partkey) FROM part""")
def map_documents(spark, folder):
    part = V.read(spark, folder, "part")
    key = F.col("p_partkey").cast("string")
    claims = F.create_map(F.lit("P31"), F.array("p_type"))
    document = F.struct(
        F.create_map(F.concat_ws(" ", F.col("p_name"), key), F.array(key)).alias("names"),
        F.create_map(key, F.struct(F.col("p_name").alias("label"), F.col("p_type").alias("desc"), F.col("p_size").alias("sitelinks"), claims.alias("claims"))).alias("ent"),
        F.create_map(F.concat("p_brand", key), F.array("p_name", "p_type")).alias("lab"))
    path = V.scratch(spark, "cache")
    part.select(document.alias("d")).select("d.*").write.json(path)
    names, entities, labels = S.read_name_cache(spark, path, multi_line=False)

    def counted(df, label, k):
        return df.agg(F.lit(label).alias("part"), F.count(F.lit(1)).alias("n"), F.count_distinct(k).alias("n_keys"))

    return counted(names, "names", "name").unionByName(counted(entities, "entities", "item")).unionByName(counted(labels, "labels", "qid"))


@query("S06_tensor_ingest", cte("states") + """
  SELECT relation, count(*) AS n, round(sum(list_sum(list_transform(h, lambda x: x::DOUBLE))), 6) AS total FROM states WHERE version = 0 GROUP BY relation""")
def tensor_ingest(spark, folder):
    path = V.scratch(spark, "states")
    rows = V.states(spark, folder).withColumnRenamed("version", "step").withColumn("position", F.lit("prompt_last"))
    S.write_states(rows, path)
    one = spark.read.parquet(path).where("position = 'prompt_last' and step = 0")
    total = F.sum(F.aggregate(F.col("h").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x))
    return rounded(one.groupBy("relation").agg(F.count(F.lit(1)).alias("n"), total.alias("total")), "total")


@query("S06_npy_blocks", cte("states") + """
  SELECT count(*) AS n, count(*) AS n_places, round(sum(list_sum(list_transform(h, lambda x: x::DOUBLE))), 4) AS total FROM states WHERE version = 0""")
def npy_blocks(spark, folder):
    path = V.scratch(spark, "npy")
    N.write_npy(V.states(spark, folder).where("version = 0"), path)
    rows = N.read_npy(spark, path, ["place"])
    total = F.sum(F.aggregate(F.col("h").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x))
    return rounded(rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("place").alias("n_places"), total.alias("total")), "total", digits=4)


@query("S07_tensor_sink", cte("states") + "SELECT version AS step, count(*) AS n, count(DISTINCT row_id) AS n_rows FROM states GROUP BY version")
def tensor_sink(spark, folder):
    path = V.scratch(spark, "states")
    S.write_states(V.states(spark, folder).withColumnRenamed("version", "step").withColumn("position", F.lit("q_last")), path)
    return spark.read.parquet(path).groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("n_rows"))


@query("S08_incremental_append", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_keys FROM events GROUP BY event_type")
def incremental_append(spark, folder):
    ev = V.read(spark, folder, "events")
    path = V.scratch(spark, "append")
    S.append_new(ev.where(F.col("event_type").isin("click", "view")), path, ["event_id"])
    S.append_new(ev, path, ["event_id"])
    S.append_new(ev, path, ["event_id"])
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_keys"))


@query("S09_metrics_sink", "SELECT event_type AS config, 'mean_value' AS metric, round(avg(value), 6) AS value FROM events GROUP BY event_type")
def metrics_sink(spark, folder):
    means = V.read(spark, folder, "events").groupBy("event_type").agg(F.avg("value").alias("m"))
    results = {r["event_type"]: {"mean_value": r["m"]} for r in means.collect()}  # five event types
    path = V.scratch(spark, "metrics")
    S.write_metrics(spark, results, path)
    return rounded(spark.read.schema("config string, metric string, value double").json(path), "value")


@query("S10_first_rows", "SELECT event_id AS row_id FROM events ORDER BY event_id LIMIT 100")
def first_rows(spark, folder):
    return S.first_rows(V.read(spark, folder, "events").select(F.col("event_id").alias("row_id")), 100)


@query("S10_first_facts", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id ORDER BY min(event_id) LIMIT 20)")
def first_facts(spark, folder):
    ev = V.read(spark, folder, "events").select("event_id", "user_id")
    return S.first_facts(ev, 20, "user_id", "event_id")


@query("S11_run_config", """SELECT 'n_rows' AS name, count(*)::VARCHAR AS value FROM events UNION ALL SELECT 'seed', '0' UNION ALL SELECT 'steps', '[0, 8, 16, 24, 31]'""")
def run_config(spark, folder):
    n = V.read(spark, folder, "events").count()
    return S.config_record(spark, {"seed": 0, "steps": [0, 8, 16, 24, 31], "n_rows": n})

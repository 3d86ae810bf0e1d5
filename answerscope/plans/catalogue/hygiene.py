"""Queries on record hygiene."""

from pyspark.sql import functions as F

from answerscope.functions import text as T
from answerscope.operators import hygiene as H
from answerscope.plans import views as V
from answerscope.plans.catalogue.registry import query
from answerscope.plans.views import cte

_R = cte("records", "claims", "current_values", "value_labels")
_VALUES = """
  , listed AS (SELECT r.*, list(v.id ORDER BY v.pos) AS ids FROM records r JOIN current_values v ON v.qid = r.subject_qid GROUP BY ALL)
  , multi AS (SELECT * FROM listed WHERE len(ids) > 1)"""


@query("H01_id_from_uri", "SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS last_part FROM pages")
def id_from_uri(spark, folder):
    return V.read(spark, folder, "pages").select("page_id", H.id_from_uri(F.col("url")).alias("last_part"))


@query("H02_property_lookup", cte("records") + "SELECT sample_id, property_id FROM records")
def property_lookup(spark, folder):
    return V.records(spark, folder).select("sample_id", H.checked_property(F.col("relation")).alias("property_id"))


@query("H02_unknown_relations", "SELECT DISTINCT p_type AS relation FROM part")
def unknown_relations(spark, folder):
    """None of the part types is a known relation, so the guard reports them all."""
    return H.unknown_relations(V.read(spark, folder, "part").select(F.col("p_type").alias("relation")))


@query("H03_ordered_keys", "SELECT DISTINCT 'Q' || l_suppkey AS key FROM lineitem ORDER BY key")
def ordered_keys(spark, folder):
    return H.ordered_keys(V.bindings(spark, folder), F.col("item"))


@query("H04_claim_values", _R + _VALUES + "SELECT subject_qid AS qid, array_to_string(ids, ',') AS ids FROM listed")
def claim_values(spark, folder):
    records = V.records(spark, folder).select(H.id_from_uri(F.col("s_uri")).alias("qid"), H.property_of(F.col("relation")).alias("p"))
    joined = records.join(V.entities(spark, folder), "qid").withColumn("v", H.claim_values(F.col("claims"), F.col("p")))
    return joined.where(F.size("v") > 0).select("qid", F.array_join("v", ",").alias("ids"))


@query("H05_multi_answer_candidates", _R + _VALUES + """
  SELECT sample_id, subject_qid, relation, property_id, gold_qid, list_contains(ids, gold_qid) AS gold_in_current_values, array_to_string(ids, ',') AS ids, len(ids)::INT AS num_values FROM multi""")
def multi_answer(spark, folder):
    out = H.multi_answer_candidates(V.records(spark, folder), V.entities(spark, folder))
    return out.select("sample_id", "subject_qid", "relation", "property_id", "gold_qid", "gold_in_current_values", F.array_join("all_value_qids", ",").alias("ids"), "num_values")


@query("H06_label_resolution", _R + _VALUES + """
  , e AS (SELECT sample_id, gold_qid, unnest(ids) AS qid, unnest(generate_series(1, len(ids))) AS pos FROM multi)
  , n AS (SELECT sample_id, gold_qid, pos, e.qid, coalesce(label, e.qid) AS label FROM e LEFT JOIN value_labels l ON l.qid = e.qid)
  SELECT sample_id, string_agg(label, ', ' ORDER BY pos) AS labels, coalesce(string_agg(label, ', ' ORDER BY pos) FILTER (WHERE qid <> gold_qid), '') AS others FROM n GROUP BY sample_id""")
def label_resolution(spark, folder):
    found = H.multi_answer_candidates(V.records(spark, folder), V.entities(spark, folder))
    out = H.with_reason(H.resolve_labels(found, V.value_labels(spark, folder)))
    return out.select("sample_id", F.array_join("all_value_labels", ", ").alias("labels"), "others")


_CHANGED = ", changed AS (SELECT qid, bool_or(rank = 'deprecated' OR ended) AS hit FROM claims GROUP BY qid)"


@query("H07_changed_in_time", cte("claims") + _CHANGED + "SELECT qid, hit AS changed FROM changed")
def changed_in_time(spark, folder):
    records = V.records(spark, folder).select(H.id_from_uri(F.col("s_uri")).alias("qid"), H.property_of(F.col("relation")).alias("p"))
    return records.join(V.entities(spark, folder), "qid").select("qid", H.has_confirmed_change(F.col("claims"), F.col("p")).alias("changed"))


@query("H08_exclude_and_merge", _R + _CHANGED + f"""
  , f AS (SELECT sample_id, relation IN ({", ".join(f"'{r}'" for r in H.CHANGING_RELATIONS)}) AND hit AS out FROM records JOIN changed ON qid = subject_qid)
  SELECT 'remaining' AS part, count(*) AS n, count(DISTINCT sample_id) AS ids FROM f WHERE NOT out UNION ALL SELECT 'newly_excluded', count(*), count(DISTINCT sample_id) FROM f WHERE out
  UNION ALL SELECT 'excluded_twice', count(*), count(DISTINCT sample_id) FROM f JOIN multi USING (sample_id) WHERE out""".replace(", f AS", _VALUES + ", f AS"))
def exclude_and_merge(spark, folder):
    records, entities = V.records(spark, folder), V.entities(spark, folder)
    already = H.multi_answer_candidates(records, entities).select("sample_id")
    remaining, newly, twice = H.split_changed(records, entities, already)

    def counted(df, part):
        return df.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"), F.count_distinct("sample_id").alias("ids"))

    return counted(remaining, "remaining").unionByName(counted(newly, "newly_excluded")).unionByName(counted(twice, "excluded_twice"))


@query("H09_entity_records", cte("bindings") + """
  , v AS (SELECT item, prop, value, min(seq) AS seq FROM bindings GROUP BY ALL), p AS (SELECT item, prop, string_agg(value, ',' ORDER BY seq, value) AS ids FROM v GROUP BY ALL)
  SELECT item, coalesce(arg_max(label, (seq, label)) FILTER (WHERE label IS NOT NULL), '') AS label, coalesce(arg_max(description, (seq, description)) FILTER (WHERE description IS NOT NULL), '') AS description,
         coalesce(arg_max(sitelinks, (seq, sitelinks)) FILTER (WHERE sitelinks IS NOT NULL), 0) AS sitelinks,
         (SELECT ids FROM p WHERE p.item = b.item AND prop = 'P31') AS p31, (SELECT ids FROM p WHERE p.item = b.item AND prop = 'P17') AS p17, (SELECT ids FROM p WHERE p.item = b.item AND prop = 'P27') AS p27 FROM bindings b GROUP BY item""")
def entity_records(spark, folder):
    out = H.entity_records(V.bindings(spark, folder))

    def ids(p):
        return F.array_join(F.try_element_at("claims", F.lit(p)), ",")

    return out.select("item", "label", "description", "sitelinks", ids("P31").alias("p31"), ids("P17").alias("p17"), ids("P27").alias("p27"))


_CANDIDATES = cte("name_hits") + """
  , wanted AS (SELECT DISTINCT p_name AS name FROM part)
  , v AS (SELECT DISTINCT name, unnest([name, lower(name), upper(substr(name, 1, 1)) || lower(substr(name, 2))]) AS variant FROM wanted)
  , f AS (SELECT DISTINCT v.name, qid, sitelinks FROM v JOIN name_hits h ON h.name = v.variant)
  , kept AS (SELECT name, qid, sitelinks, row_number() OVER (PARTITION BY name ORDER BY sitelinks DESC, qid DESC)::INT AS place FROM f QUALIFY place <= 8)"""


@query("H10_name_candidates", _CANDIDATES + " SELECT name, qid, sitelinks, place FROM kept")
def name_candidates(spark, folder):
    return H.name_candidates(V.wanted_names(spark, folder), V.name_hits(spark, folder)).select("name", "qid", "sitelinks", "place")


@query("H10_name_table", _CANDIDATES + " SELECT wanted.name, coalesce(string_agg(qid, ',' ORDER BY place), '') AS qids FROM wanted LEFT JOIN kept USING (name) GROUP BY wanted.name")
def name_table(spark, folder):
    wanted = V.wanted_names(spark, folder)
    out = H.name_table(wanted, H.name_candidates(wanted, V.name_hits(spark, folder)))
    return out.select("name", F.array_join("qids", ",").alias("qids"))


@query("H10_spelling_variants", "SELECT s_suppkey, array_to_string(list_distinct_ordered, '|') AS variants FROM (SELECT s_suppkey, CASE WHEN lower(s_name) = s_name THEN [s_name] WHEN upper(substr(s_name, 1, 1)) || lower(substr(s_name, 2)) = s_name "
       "THEN [s_name, lower(s_name)] ELSE [s_name, lower(s_name), upper(substr(s_name, 1, 1)) || lower(substr(s_name, 2))] END AS list_distinct_ordered FROM supplier)")
def spelling_variants(spark, folder):
    return V.read(spark, folder, "supplier").select("s_suppkey", F.array_join(T.spelling_variants(F.col("s_name")), "|").alias("variants"))


@query("H11_candidate_enrichment", _CANDIDATES + ", " + cte("bindings", "value_labels")[5:] + """
  , v AS (SELECT item, prop, value, min(seq) AS seq FROM bindings GROUP BY ALL)
  , c AS (SELECT k.name, k.qid, any_value(label) AS label FROM kept k JOIN (SELECT item, coalesce(arg_max(label, (seq, label)) FILTER (WHERE label IS NOT NULL), '') AS label FROM bindings GROUP BY item) e ON e.item = k.qid GROUP BY ALL)
  SELECT name, qid, label, EXISTS (SELECT 1 FROM v WHERE v.item = qid AND prop = 'P31' AND value = 'Q5') AS human,
         (SELECT count(*) FROM v WHERE v.item = qid AND prop IN ('P17', 'P27'))::INT AS countries,
         coalesce((SELECT string_agg(coalesce(lower(l.p_brand), ''), ',' ORDER BY seq, v.value) FROM v LEFT JOIN (SELECT DISTINCT 'Q' || (p_partkey % 9) AS q, 'class ' || (p_partkey % 9) AS p_brand FROM part) l ON l.q = v.value
                   WHERE v.item = c.qid AND prop = 'P31'), '') AS inst FROM c""".replace(", v AS (SELECT item, prop", ", vals AS (SELECT item, prop").replace("FROM v ", "FROM vals v "))
def candidate_enrichment(spark, folder):
    found = H.name_candidates(V.wanted_names(spark, folder), V.name_hits(spark, folder)).select("name", "qid", "place")
    entities = H.entity_records(V.bindings(spark, folder))
    n = (F.col("p_partkey") % 9).cast("string")
    labels = V.read(spark, folder, "part").select(F.concat(F.lit("Q"), n).alias("qid"), F.concat(F.lit("Class "), n).alias("label")).distinct()
    out = H.enrich(found, entities, labels)
    return out.select("name", "qid", "label", "human", F.size("country").alias("countries"), F.array_join("inst", ",").alias("inst"))


@query("H12_cache_completion", _CANDIDATES + " SELECT DISTINCT s_name AS name FROM supplier UNION SELECT name FROM wanted WHERE name NOT IN (SELECT name FROM kept WHERE sitelinks > 40)")
def cache_completion(spark, folder):
    wanted = V.wanted_names(spark, folder).unionByName(V.read(spark, folder, "supplier").select(F.col("s_name").alias("name")))
    cache = H.name_candidates(V.wanted_names(spark, folder), V.name_hits(spark, folder)).where("sitelinks > 40")
    return H.missing_from_cache(wanted, cache, "name")

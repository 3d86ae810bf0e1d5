"""Record hygiene: several valid answers, answers that changed in time, name caches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscope.functions import text as T
from answerscope.operators import order

# ---- fixed values: relation -> property id ----------------------------------
RELATION_PROPERTY = {
    "occupation": "P106",
    "place of birth": "P19",
    "genre": "P136",
    "father": "P22",
    "mother": "P25",
    "country": "P17",
    "producer": "P162",
    "director": "P57",
    "capital of": "P1376",
    "screenwriter": "P58",
    "composer": "P86",
    "color": "P462",
    "religion": "P140",
    "sport": "P641",
    "author": "P50",
    "capital": "P36",
}
CHANGING_RELATIONS = ["capital", "capital of", "color", "religion", "country"]
END_TIME = "P582"
HUMAN = "Q5"
COUNTRY_PROPERTIES = ["P17", "P27", "P495"]


def id_from_uri(uri: Column) -> Column:
    """Last path part, trailing slashes ignored."""
    return F.element_at(F.split(F.regexp_replace(uri, "/+$", ""), "/"), -1)


def property_of(relation: Column, table: dict[str, str] | None = None) -> Column:
    """Fixed lookup as a literal map; NULL for an unknown relation."""
    pairs = [F.lit(x) for kv in (table or RELATION_PROPERTY).items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), relation)


def checked_property(relation: Column, table: dict[str, str] | None = None) -> Column:
    """H02 with the guard: an unknown relation stops the job when its row is read."""
    found = property_of(relation, table)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown relation: "), relation)).cast("string"))


def unknown_relations(records: DataFrame, relation: str = "relation", table: dict[str, str] | None = None) -> DataFrame:
    """H02 guard as data: relations the lookup does not know."""
    return records.where(property_of(F.col(relation), table).isNull()).select(relation).distinct()


def ordered_keys(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Distinct keys in order."""
    return df.select(key.alias(name)).distinct().orderBy(name)


def claim_values(claims: Column, prop: Column) -> Column:
    """Entity ids of a property, deprecated and value-less claims left out, first-seen order."""
    kept = F.filter(F.try_element_at(claims, prop), lambda c: (F.coalesce(c["rank"], F.lit("")) != "deprecated")
                    & (c["snaktype"] == "value") & (c["type"] == "wikibase-entityid"))
    ids = F.array_distinct(F.transform(kept, lambda c: c["id"]))
    return F.coalesce(ids, F.array().cast("array<string>"))


def has_confirmed_change(claims: Column, prop: Column) -> Column:
    """A deprecated claim, or one with an end time, whatever its rank."""
    hit = F.exists(F.try_element_at(claims, prop), lambda c: (F.coalesce(c["rank"], F.lit("")) == "deprecated")
                   | F.coalesce(F.map_contains_key(c["qualifiers"], END_TIME), F.lit(False)))
    return F.coalesce(hit, F.lit(False))


def multi_answer_candidates(records: DataFrame, entities: DataFrame) -> DataFrame:
    """Records whose property holds more than one current value."""
    based = records.withColumn("subject_qid", id_from_uri(F.col("s_uri"))).withColumn("gold_qid", id_from_uri(F.col("o_uri"))).withColumn(
        "property_id", checked_property(F.col("relation")))
    joined = based.join(entities.select(F.col("qid").alias("subject_qid"), "claims"), "subject_qid", "left")
    values = joined.withColumn("all_value_qids", claim_values(F.col("claims"), F.col("property_id")))
    return (
        values.where(F.size("all_value_qids") > 1)
        .withColumn("gold_in_current_values", F.array_contains("all_value_qids", F.col("gold_qid")))
        .withColumn("num_values", F.size("all_value_qids"))
        .select("sample_id", "subject", "subject_qid", "relation", "property_id", "question", "gold_object", "gold_qid",
                "gold_in_current_values", "all_value_qids", "num_values")
    )


def resolve_labels(candidates: DataFrame, labels: DataFrame, key: str = "sample_id") -> DataFrame:
    """Labels in value order, the id where none is known; ``others`` lists all but the gold's.

    A record's values are a short list, so the regrouping is bounded by that list.
    """
    exploded = candidates.select(key, "gold_qid", F.posexplode("all_value_qids").alias("pos", "qid"))
    named = exploded.join(labels, "qid", "left").withColumn("label", F.coalesce("label", "qid"))
    entry = F.struct("pos", "label", (F.col("qid") == F.col("gold_qid")).alias("is_gold"))
    lists = named.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("__l"))
    joined = candidates.join(lists, key)
    return (
        joined.withColumn("all_value_labels", F.transform("__l", lambda e: e["label"]))
        .withColumn("others", F.array_join(F.transform(F.filter("__l", lambda e: ~e["is_gold"]), lambda e: e["label"]), ", "))
        .drop("__l")
    )


def with_reason(resolved: DataFrame) -> DataFrame:
    """One sentence on why the record is ambiguous."""
    return resolved.withColumn("reason", F.concat(
        F.lit("The knowledge base holds "), F.col("num_values").cast("string"), F.lit(" values for "), F.col("subject"), F.lit(" / "),
        F.col("relation"), F.lit(" ("), F.col("property_id"), F.lit("): "), F.array_join("all_value_labels", ", "),
        F.lit(". Only '"), F.col("gold_object"), F.lit("' is gold, but "), F.col("others"), F.lit(" may be right as well.")))


def split_changed(records: DataFrame, entities: DataFrame, excluded: DataFrame,
                  relations: Sequence[str] = tuple(CHANGING_RELATIONS)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(remaining, newly excluded, ids excluded twice).

    Only records of the relations that can change are checked.  The third table lists records that
    were excluded before; it must be empty for a clean merge.
    """
    subject = id_from_uri(F.col("s_uri"))
    joined = records.withColumn("subject_qid", subject).join(
        entities.select(F.col("qid").alias("subject_qid"), "claims"), "subject_qid", "left")
    changed = F.col("relation").isin(list(relations)) & has_confirmed_change(F.col("claims"), property_of(F.col("relation")))
    flagged = joined.withColumn("__changed", changed).drop("claims")
    remaining = flagged.where(~F.col("__changed")).select(*records.columns)
    newly = flagged.where("__changed").select(
        "sample_id", "subject", "subject_qid", "relation", "question", "gold_object", id_from_uri(F.col("o_uri")).alias("gold_qid"),
        F.lit("confirmed_temporal_change").alias("exclusion_type"))
    twice = newly.select("sample_id").join(excluded.select("sample_id"), "sample_id", "left_semi")
    return remaining, newly, twice


def entity_records(bindings: DataFrame) -> DataFrame:
    """Rows (item, seq, label, description, sitelinks, prop, value) -> one record per item.

    The last non-null label wins, the larger one at an equal ``seq``; values are deduplicated before
    they are collected.
    """
    def last(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("seq", c)))

    heads = bindings.groupBy("item").agg(F.coalesce(last("label"), F.lit("")).alias("label"), F.coalesce(last("description"), F.lit("")).alias("description"),
                                         F.coalesce(last("sitelinks"), F.lit(0)).alias("sitelinks"))
    values = bindings.where(F.col("prop").isNotNull() & F.col("value").isNotNull()).groupBy("item", "prop", "value").agg(F.min("seq").alias("seq"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda s: s["value"])
    lists = values.groupBy("item", "prop").agg(ordered.alias("ids"))
    claims = lists.groupBy("item").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("prop", "ids")))).alias("claims"))
    return heads.join(claims, "item", "left")


def name_candidates(wanted: DataFrame, hits: DataFrame, keep: int = 8) -> DataFrame:
    """The best hits over a name's spelling variants, by (sitelinks, qid) descending.

    ``hits`` is (name, qid, sitelinks).  Output one row per kept candidate.
    """
    variants = wanted.select("name").distinct().withColumn("variant", F.explode(T.spelling_variants(F.col("name"))))
    found = variants.join(hits.withColumnRenamed("name", "variant"), "variant").select("name", "qid", "sitelinks").distinct()
    return order.top_per_group(found, keep, ["name"], [F.desc("sitelinks"), F.desc("qid")])


def name_table(wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """(name, qids) with an empty list for names that were looked up and found nothing."""
    lists = candidates.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "qid"))), lambda s: s["qid"]).alias("qids"))
    return wanted.select("name").distinct().join(lists, "name", "left").withColumn(
        "qids", F.coalesce("qids", F.array().cast("array<string>")))


def enrich(candidates: DataFrame, entities: DataFrame, labels: DataFrame, instance: str = "P31") -> DataFrame:
    """Candidates with entity fields, lower-case class labels, human flag and countries."""
    joined = candidates.join(entities.withColumnRenamed("item", "qid"), "qid")
    nothing = F.array().cast("array<string>")

    def ids(p: str) -> Column:
        return F.coalesce(F.try_element_at(F.col("claims"), F.lit(p)), nothing)

    based = joined.withColumn("human", F.array_contains(ids(instance), HUMAN)).withColumn("country", F.concat(*[ids(p) for p in COUNTRY_PROPERTIES]))
    classes = based.select("name", "qid", F.posexplode(ids(instance)).alias("pos", "class"))
    named = classes.join(labels.select(F.col("qid").alias("class"), F.lower("label").alias("label")), "class", "left").withColumn(
        "label", F.coalesce("label", F.lit("")))
    lists = named.groupBy("name", "qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda s: s["label"]).alias("inst"))
    return based.join(lists, ["name", "qid"], "left").withColumn("inst", F.coalesce("inst", nothing))


def missing_from_cache(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Keys still to look up, each once."""
    return wanted.select(key).where(F.col(key).isNotNull()).distinct().join(cache.select(key), key, "left_anti")

"""Analysis views on the given tables, as DataFrames and as the same views in SQL.

Every view is a projection of whole tables (plus one count per fact for k), so its size and
cost follow the input.  ``cte(...)`` returns the SQL text of the views a query needs.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerscope.functions import text as T
from answerscope.functions.hashing import HASH_RANGE, hash32
from answerscope.operators import selection

CONDITIONS = ["base", "c05", "c1"]
STEPS, SLOTS = 8, 4


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The same rows, dealt out by their key over a few tasks for each core.

    A table of one row group is read by one task, which would do all work up to the next shuffle.
    """
    spark = rows.sparkSession
    tasks = max(48, 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), tasks), key)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder for round trips: shared on a cluster, temporary in a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="answerscope-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def sql_hash(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT)"


def sql_uniform(text: str) -> str:
    return f"({sql_hash(text)}::DOUBLE / {float(HASH_RANGE)}::DOUBLE)"


VIEWS: dict[str, tuple[list[str], str]] = {}


def cte(*names: str) -> str:
    """``WITH`` clause of the named SQL views and what they build on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        needs, _ = VIEWS[name]
        for n in needs:
            add(n)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered) + "\n"


# ---- attempts: answers with a score, from events -----------------------------
def attempts(spark: SparkSession, folder: str) -> DataFrame:
    fact = F.expr("event_id div 5")
    h = hash32(fact, seed="relation")
    correct = F.col("event_type").isin("purchase", "signup")
    kind = (
        F.when(correct, "correct").when(F.col("event_type") == "error", "broken").when(F.col("value") < 5, "abstain").otherwise("entity")
    )
    events = spread(read(spark, folder, "events").select("event_id", "event_type", "value"), "event_id")
    return events.select(
        F.col("event_id").alias("row_id"), fact.alias("fact"), F.expr("event_id div 10").alias("subject"),
        F.expr("cast(event_id % 5 as int)").alias("version"),
        F.concat(F.lit("r"), F.when(h % 3 == 0, F.lit(0).cast("bigint")).otherwise(h % 16).cast("string")).alias("relation"),
        correct.alias("correct"), kind.alias("kind"), F.col("value").alias("score"))


def attempts_k(spark: SparkSession, folder: str) -> DataFrame:
    return selection.with_consistency(attempts(spark, folder)).withColumn("fold", selection.fold()).withColumn("half", selection.half())


_REL = sql_hash("'relation:' || (event_id // 5)")
VIEWS["attempts"] = ([], f"""
  SELECT event_id AS row_id, event_id // 5 AS fact, event_id // 10 AS subject, (event_id % 5)::INT AS version,
         'r' || (CASE WHEN {_REL} % 3 = 0 THEN 0 ELSE {_REL} % 16 END) AS relation,
         event_type IN ('purchase', 'signup') AS correct,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'correct' WHEN event_type = 'error' THEN 'broken'
              WHEN value < 5 THEN 'abstain' ELSE 'entity' END AS kind,
         value AS score
  FROM events""")
VIEWS["attempts_k"] = (["attempts"], f"""
  SELECT a.*, k.k_correct, k.k_correct || '/5' AS fact_group, ({sql_hash("subject::VARCHAR")} % 5)::INT AS fold,
         CASE WHEN {sql_hash("subject::VARCHAR")} % 2 = 0 THEN 'dev' ELSE 'test' END AS half
  FROM attempts a JOIN (SELECT fact, count(*) FILTER (WHERE correct) AS k_correct FROM attempts GROUP BY fact) k USING (fact)""")


# ---- states: dense vectors, from embeddings ----------------------------------
def states(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("label") < 5, "correct").when(F.col("label") < 8, "broken").otherwise("entity")
    rows = read(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.expr("vec_id div 5").alias("fact"), F.expr("vec_id div 10").alias("subject"),
        F.expr("cast(vec_id % 5 as int)").alias("version"), F.expr("concat('r', cast((vec_id div 5) % 4 as string))").alias("relation"),
        (F.col("label") < 5).alias("correct"), kind.alias("kind"), F.col("label"), F.col("embedding").alias("h"))
    return rows


def states_k(spark: SparkSession, folder: str) -> DataFrame:
    return selection.with_consistency(states(spark, folder)).withColumn("fold", selection.fold()).withColumn("half", selection.half())


def acts(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse activations: vector components above 0.1."""
    long = read(spark, folder, "embeddings").select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("latent", "v"))
    return long.select("row_id", "latent", F.col("v").cast("double").alias("a")).where(F.col("a") > F.lit(0.1))


VIEWS["states"] = ([], """
  SELECT vec_id AS row_id, vec_id // 5 AS fact, vec_id // 10 AS subject, (vec_id % 5)::INT AS version, 'r' || ((vec_id // 5) % 4) AS relation,
         label < 5 AS correct, CASE WHEN label < 5 THEN 'correct' WHEN label < 8 THEN 'broken' ELSE 'entity' END AS kind, label, embedding AS h
  FROM embeddings""")
VIEWS["states_k"] = (["states"], f"""
  SELECT a.*, k.k_correct, k.k_correct || '/5' AS fact_group, ({sql_hash("subject::VARCHAR")} % 5)::INT AS fold,
         CASE WHEN {sql_hash("subject::VARCHAR")} % 2 = 0 THEN 'dev' ELSE 'test' END AS half
  FROM states a JOIN (SELECT fact, count(*) FILTER (WHERE correct) AS k_correct FROM states GROUP BY fact) k USING (fact)""")
VIEWS["acts"] = ([], """
  SELECT row_id, latent, a FROM (
    SELECT vec_id AS row_id, (unnest(generate_series(1, len(embedding))) - 1)::INT AS latent, unnest(embedding)::DOUBLE AS a FROM embeddings)
  WHERE a > 0.1::DOUBLE""")
VIEWS["dims"] = (["states_k"], """
  SELECT * EXCLUDE (h), unnest(generate_series(1, len(h))) AS dim, unnest(h)::DOUBLE AS x FROM states_k""")


# ---- answers: questions, golds and free-text answers, from documents ---------
ANSWER_WORDS = 12  # every run of so many words of a document is a gold value, so whole texts are used
ROWS_PER_DOCUMENT = 1 << 20


def sql_norm(text: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({text})), '[^a-z0-9]+', ' ', 'g'))"


def _document_words(spark: SparkSession, folder: str) -> tuple[DataFrame, Column]:
    """Documents with the ``words`` of their whole texts, and where runs of words start in them."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\S+)"), F.lit(1))
    texts = spread(read(spark, folder, "documents").select("doc_id", "source", "text"), "doc_id")
    # asked of the text: a filter on the words would move below the dealing out and cut every text a second time
    docs = texts.where(F.col("text").rlike(r"\S")).select("doc_id", "source", words.alias("words"))
    return docs, F.sequence(F.lit(0), F.size("words") - 1, F.lit(ANSWER_WORDS))


def passages(spark: SparkSession, folder: str) -> DataFrame:
    """The whole text of every document, cut into runs of words: row_id, source, words ``w``."""
    docs, starts = _document_words(spark, folder)

    def run(i: Column) -> Column:  # a slice inside a lambda goes through the whole array, for every run of it
        return F.transform(F.sequence(i, F.least(i + ANSWER_WORDS, F.size("words")) - 1), lambda j: F.get("words", j))

    runs = docs.select("doc_id", "source", F.posexplode(F.transform(starts, run)).alias("pos", "w"))
    return runs.select((F.col("doc_id") * ROWS_PER_DOCUMENT + F.col("pos")).alias("row_id"), "source", "w")


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """One answer per passage: sixteen deterministic variations of it."""
    docs = passages(spark, folder).withColumns({"gold_value": F.array_join("w", " "), "b": hash32("row_id", seed="answer") % 16})
    g, first = F.col("gold_value"), F.get("w", F.lit(0))
    backwards = F.array_join(F.reverse("w"), " ")
    forms = [
        F.lit(""), F.lit("I don't know"), F.lit("None"), F.concat(F.lit("Question: "), g), F.concat_ws(" ", g, g, g),
        F.concat(g, F.lit(".What is the capital")), F.lit("1"), F.array_join(F.slice("w", 2, ANSWER_WORDS), " "),
        F.concat(first, F.lit(" Zorblatt")), g, F.concat(F.lower(g), F.lit("!")), backwards,
        F.concat(F.substring(g, 1, 1), F.substring(g, 3, 2**31 - 1)), F.concat(g, F.lit(" IV")), F.lit("The Zorblatt Smith"), F.concat_ws(" ", g, first),
    ]
    answer = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        answer = F.when(F.col("b") == i, form).otherwise(answer)
    relation = F.when(F.col("source") == "src0", "father").when(F.col("source") == "src1", "mother").when(F.col("source") == "src2", "director").otherwise(F.col("source"))
    return docs.select(
        "row_id", F.expr("row_id div 5").alias("fact"), F.expr("cast(row_id % 5 as int)").alias("version"), relation.alias("relation"),
        F.concat(F.lit("Who wrote "), g, F.lit("?")).alias("question"), answer.alias("model_answer"), "gold_value",
        F.array(F.concat_ws(" ", g, F.lit("II")), F.lower(backwards)).alias("gold_aliases"))


def name_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Looked-up names: some found, some known to have no candidate, some never looked up."""
    docs, starts = _document_words(spark, folder)  # of a passage only its first word is needed, so no run is copied
    first = docs.select(F.explode(F.transform(starts, lambda i: F.get("words", i))).alias("first"))
    names = first.select(T.bare_name(F.concat("first", F.lit(" Zorblatt"))).alias("name")).distinct()
    h = hash32("name", seed="cache") % 3
    nothing = F.array().cast("array<string>")
    return names.where(h < 2).select("name", F.when(h == 0, nothing).otherwise(F.array(F.lit("Q1"))).alias("qids"))


_FORMS = [
    "''", "'I don''t know'", "'None'", "'Question: ' || g", "g || ' ' || g || ' ' || g", "g || '.What is the capital'", "'1'",
    "array_to_string(w[2:], ' ')", "w[1] || ' Zorblatt'", "g", "lower(g) || '!'", "array_to_string(list_reverse(w), ' ')",
    "substr(g, 1, 1) || substr(g, 3)", "g || ' IV'", "'The Zorblatt Smith'", "g || ' ' || w[1]",
]
VIEWS["passages"] = ([], rf"""
  SELECT doc_id * {ROWS_PER_DOCUMENT} + i AS row_id, source, words[i * {ANSWER_WORDS} + 1:(i + 1) * {ANSWER_WORDS}] AS w
  FROM (SELECT *, unnest(range((len(words) + {ANSWER_WORDS - 1}) // {ANSWER_WORDS})) AS i
    FROM (SELECT doc_id, source, regexp_extract_all(text, '\S+') AS words FROM documents))""")
VIEWS["answers"] = (["passages"], f"""
  SELECT row_id, row_id // 5 AS fact, (row_id % 5)::INT AS version,
         CASE source WHEN 'src0' THEN 'father' WHEN 'src1' THEN 'mother' WHEN 'src2' THEN 'director' ELSE source END AS relation,
         'Who wrote ' || g || '?' AS question,
         CASE b {" ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_FORMS))} END AS model_answer,
         g AS gold_value, [g || ' II', lower(array_to_string(list_reverse(w), ' '))] AS gold_aliases
  FROM (SELECT *, array_to_string(w, ' ') AS g, {sql_hash("'answer:' || row_id")} % 16 AS b FROM passages)""")
VIEWS["name_cache"] = (["passages"], f"""
  SELECT DISTINCT name, CASE WHEN {sql_hash("'cache:' || name")} % 3 = 0 THEN []::VARCHAR[] ELSE ['Q1'] END AS qids
  FROM (SELECT DISTINCT regexp_replace(w[1] || ' Zorblatt', '^[ ."'']+', '') AS name FROM passages)
  WHERE {sql_hash("'cache:' || name")} % 3 < 2""")


# ---- question and answer turns ------------------------------------------------
def qa(spark: SparkSession, folder: str) -> DataFrame:
    turns = read(spark, folder, "conversations")
    asked = turns.where(F.col("role") == "user").select(F.col("conv_id").alias("sample_id"), F.col("turn").alias("version"), F.col("text").alias("question"))
    said = turns.where(F.col("role") == "assistant").select(F.col("conv_id").alias("sample_id"), (F.col("turn") - 1).alias("version"), F.col("text").alias("answer"))
    return asked.join(said, ["sample_id", "version"])


VIEWS["qa"] = ([], """
  SELECT u.conv_id AS sample_id, u.turn AS version, u.text AS question, a.text AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'""")


# ---- outcomes under conditions and detector scores, from attempts -------------
def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    rows = attempts_k(spark, folder).withColumn("cond", F.explode(F.array(*[F.lit(c) for c in CONDITIONS])))
    u = hash32("cond", "row_id", seed="ok") % 100
    fixed = F.when(F.col("cond") == "c05", 25).otherwise(35)
    kept = F.when(F.col("cond") == "c05", 80).otherwise(70)
    ok = F.when(F.col("cond") == "base", F.col("correct")).when(F.col("correct"), u < kept).otherwise(u < fixed)
    v = hash32("cond", "row_id", seed="type") % 4
    rows = rows.withColumn("ok", ok).withColumn("__v", v)
    new_type = (
        F.when(F.col("ok"), "correct").when(F.col("cond") == "base", F.col("kind")).when(F.col("__v") == 0, "abstain")
        .when(F.col("__v") == 1, "broken").otherwise("entity")
    )
    return rows.select(
        "cond", "row_id", "fact", "subject", "relation", "k_correct", "fold", F.col("correct").alias("was_correct"), "ok", F.col("kind").alias("old_type"),
        new_type.alias("new_type"), F.concat(new_type, F.lit("-"), F.when(F.col("ok") & F.col("correct"), F.lit(0).cast("bigint")).otherwise(F.col("__v")).cast("string")).alias("answer"))


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Four detector scores per row; ``p_all`` has ties, ``p_mid`` leans towards right rows."""
    rows = attempts(spark, folder)
    lean = F.when(F.col("correct"), 0.2).otherwise(0.0)
    u = hash32("row_id", seed="p_mid").cast("double") / F.lit(float(HASH_RANGE))
    know = hash32("fact", seed="p_know").cast("double") / F.lit(float(HASH_RANGE))
    axis = hash32("row_id", seed="axis").cast("double") / F.lit(float(HASH_RANGE))
    return rows.select("row_id", F.col("score").alias("p_all"), (u + lean).alias("p_mid"), know.alias("p_know"), axis.alias("axis"))


_OK = sql_hash("'ok:' || cond || ':' || row_id")
_V = sql_hash("'type:' || cond || ':' || row_id")
VIEWS["outcomes"] = (["attempts_k"], f"""
  SELECT cond, row_id, fact, subject, relation, k_correct, fold, correct AS was_correct, ok, kind AS old_type, new_type,
         new_type || '-' || (CASE WHEN ok AND correct THEN 0 ELSE v END) AS answer
  FROM (SELECT *, CASE WHEN ok THEN 'correct' WHEN cond = 'base' THEN kind WHEN v = 0 THEN 'abstain' WHEN v = 1 THEN 'broken' ELSE 'entity' END AS new_type
        FROM (SELECT *, {_V} % 4 AS v, CASE WHEN cond = 'base' THEN correct
                WHEN correct THEN {_OK} % 100 < (CASE WHEN cond = 'c05' THEN 80 ELSE 70 END)
                ELSE {_OK} % 100 < (CASE WHEN cond = 'c05' THEN 25 ELSE 35 END) END AS ok
              FROM (SELECT *, unnest(['base', 'c05', 'c1']) AS cond FROM attempts_k)))""")
VIEWS["scores"] = (["attempts"], f"""
  SELECT row_id, score AS p_all, {sql_uniform("'p_mid:' || row_id")} + (CASE WHEN correct THEN 0.2::DOUBLE ELSE 0::DOUBLE END) AS p_mid,
         {sql_uniform("'p_know:' || fact")} AS p_know, {sql_uniform("'axis:' || row_id")} AS axis
  FROM attempts""")
VIEWS["policy_rows"] = (["outcomes", "scores"], """
  SELECT o.*, p_all, p_mid, p_know, axis,
         CASE WHEN k_correct = 0 THEN 8.0::DOUBLE WHEN k_correct = 5 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM (SELECT row_id, fact, k_correct, fold, bool_or(ok) FILTER (WHERE cond = 'base') AS base,
               bool_or(ok) FILTER (WHERE cond = 'c05') AS c05, bool_or(ok) FILTER (WHERE cond = 'c1') AS c1
        FROM outcomes GROUP BY ALL) o JOIN scores USING (row_id)""")


def policy_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One row per attempt with the outcome under every condition, scores and a size weight."""
    wide = outcomes(spark, folder).groupBy("row_id", "fact", "k_correct", "fold").pivot("cond", CONDITIONS).agg(F.first("ok"))
    weight = F.when(F.col("k_correct") == 0, 8.0).when(F.col("k_correct") == 5, 5.0).otherwise(1.0)
    return wide.join(scores(spark, folder), "row_id").withColumn("w", weight)


# ---- decoding slots and token canvases, from facts of attempts ----------------
SPECIAL_TOKENS, BLANK_TOKENS = [90], [10, 11]


def slots(spark: SparkSession, folder: str) -> DataFrame:
    facts = read(spark, folder, "events").select(F.expr("event_id div 5").alias("row_id")).distinct()
    grid = facts.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1)))).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))))
    lp = -(hash32("row_id", "step", "slot", seed="lp") % 1000).cast("double") / F.lit(100.0)
    mg = (hash32("row_id", "step", "slot", seed="mg") % 1000).cast("double") / F.lit(1000.0)
    return grid.select("row_id", "step", "slot", (F.col("step") < hash32("row_id", "slot", seed="mask") % (STEPS + 1)).alias("masked"), lp.alias("lp"), mg.alias("mg"))


def canvases(spark: SparkSession, folder: str) -> DataFrame:
    """Token canvases: 10 and 11 are blank tokens, 90 is special, -1 is padding."""
    facts = read(spark, folder, "events").select(F.expr("event_id div 5").alias("row_id")).distinct()

    def token(i: int) -> Column:
        h = hash32("row_id", F.lit(i), seed="token") % 10
        return F.when(h < 2, 10 + h).when(h == 8, 90).when(h == 9, -1).otherwise(20 + h).cast("int")

    return facts.withColumn("tokens", F.array(*[token(i) for i in range(SLOTS)]))


_FACTS = "SELECT DISTINCT event_id // 5 AS row_id FROM events"
VIEWS["slots"] = ([], f"""
  SELECT row_id, step, slot, step < {sql_hash("'mask:' || row_id || ':' || slot")} % {STEPS + 1} AS masked,
         -({sql_hash("'lp:' || row_id || ':' || step || ':' || slot")} % 1000)::DOUBLE / 100.0::DOUBLE AS lp,
         ({sql_hash("'mg:' || row_id || ':' || step || ':' || slot")} % 1000)::DOUBLE / 1000.0::DOUBLE AS mg
  FROM (SELECT row_id, slot, unnest(range({STEPS}))::INT AS step FROM (SELECT row_id, unnest(range({SLOTS}))::INT AS slot FROM ({_FACTS})))""")
VIEWS["canvases"] = ([], f"""
  SELECT row_id, list(CASE WHEN h < 2 THEN 10 + h WHEN h = 8 THEN 90 WHEN h = 9 THEN -1 ELSE 20 + h END ORDER BY i)::INT[] AS tokens
  FROM (SELECT row_id, i, {sql_hash("'token:' || row_id || ':' || i")} % 10 AS h FROM (SELECT row_id, unnest(range({SLOTS})) AS i FROM ({_FACTS})))
  GROUP BY row_id""")


# ---- records with nested claims, from parts; bindings and names from line items ----
def records(spark: SparkSession, folder: str) -> DataFrame:
    from answerscope.operators.hygiene import RELATION_PROPERTY

    names = F.array(*[F.lit(x) for x in RELATION_PROPERTY])
    part = read(spark, folder, "part")
    return part.select(
        F.col("p_partkey").cast("string").alias("sample_id"), F.col("p_name").alias("subject"),
        F.get(names, (F.col("p_partkey") % len(RELATION_PROPERTY)).cast("int")).alias("relation"),
        F.concat(F.lit("Which one is "), F.col("p_name"), F.lit("?")).alias("question"), F.concat(F.lit("value "), (F.col("p_partkey") % 97).cast("string")).alias("gold_object"),
        F.concat(F.lit("http://kb.example/entity/Q"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, F.lit("/")).otherwise(F.lit(""))).alias("s_uri"),
        F.concat(F.lit("http://kb.example/entity/V"), (F.col("p_partkey") % 97).cast("string")).alias("o_uri"))


def entities(spark: SparkSession, folder: str) -> DataFrame:
    """Claims of every part's subject: up to four claims of its relation's property."""
    from answerscope.operators.hygiene import END_TIME, RELATION_PROPERTY

    properties = F.array(*[F.lit(x) for x in RELATION_PROPERTY.values()])
    k, size = F.col("p_partkey"), F.col("p_size")

    def claim(i: int, value: Column) -> Column:
        key = k + i
        return F.struct(
            F.when(key % 11 == 0, "deprecated").when(key % 7 == 0, "preferred").otherwise("normal").alias("rank"),
            F.when(key % 13 == 0, "novalue").otherwise("value").alias("snaktype"),
            F.when(key % 17 == 0, "string").otherwise("wikibase-entityid").alias("type"),
            F.concat(F.lit("V"), value.cast("string")).alias("id"),
            F.when(key % 19 == 0, F.create_map(F.lit(END_TIME), F.lit("2001"))).otherwise(F.create_map(F.lit("P580"), F.lit("1999"))).alias("qualifiers"))

    claims = F.array(claim(0, k % 97), claim(1, (k * 3) % 89), claim(2, k % 97), claim(3, size % 83))
    some = F.slice(claims, F.lit(1), (size % 4 + 1).cast("int"))
    return read(spark, folder, "part").select(
        F.concat(F.lit("Q"), k.cast("string")).alias("qid"),
        F.create_map(F.get(properties, (k % len(RELATION_PROPERTY)).cast("int")), some).alias("claims"))


def value_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of the values; the higher numbers have none."""
    n = (F.col("p_partkey") % 60).cast("string")
    return read(spark, folder, "part").select(F.concat(F.lit("V"), n).alias("qid"), F.concat(F.lit("value "), n).alias("label")).distinct()


def _claim_sql(i: int, value: str) -> str:
    k = f"(p_partkey + {i})"
    return f"""{{'pos': {i}, 'rank': CASE WHEN {k} % 11 = 0 THEN 'deprecated' WHEN {k} % 7 = 0 THEN 'preferred' ELSE 'normal' END,
      'snaktype': CASE WHEN {k} % 13 = 0 THEN 'novalue' ELSE 'value' END, 'type': CASE WHEN {k} % 17 = 0 THEN 'string' ELSE 'wikibase-entityid' END,
      'id': 'V' || ({value}), 'ended': {k} % 19 = 0}}"""


def _relation_sql() -> tuple[str, str]:
    from answerscope.operators.hygiene import RELATION_PROPERTY

    relations = "[" + ", ".join(f"'{x}'" for x in RELATION_PROPERTY) + "]"
    properties = "[" + ", ".join(f"'{x}'" for x in RELATION_PROPERTY.values()) + "]"
    return f"{relations}[p_partkey % {len(RELATION_PROPERTY)} + 1]", f"{properties}[p_partkey % {len(RELATION_PROPERTY)} + 1]"


_RELATION, _PROPERTY = _relation_sql()
VIEWS["records"] = ([], f"""
  SELECT p_partkey::VARCHAR AS sample_id, p_name AS subject, {_RELATION} AS relation, {_PROPERTY} AS property_id, 'Which one is ' || p_name || '?' AS question,
         'value ' || (p_partkey % 97) AS gold_object, 'Q' || p_partkey AS subject_qid, 'V' || (p_partkey % 97) AS gold_qid
  FROM part""")
VIEWS["claims"] = ([], f"""
  SELECT qid, c.pos, c.rank, c.snaktype, c.type, c.id, c.ended FROM (
    SELECT 'Q' || p_partkey AS qid, unnest([{_claim_sql(0, "p_partkey % 97")}, {_claim_sql(1, "(p_partkey * 3) % 89")}, {_claim_sql(2, "p_partkey % 97")},
           {_claim_sql(3, "p_size % 83")}][1:(p_size % 4 + 1)]) AS c FROM part)""")
VIEWS["current_values"] = (["claims"], """
  SELECT qid, id, min(pos) AS pos FROM claims WHERE rank <> 'deprecated' AND snaktype = 'value' AND type = 'wikibase-entityid' GROUP BY qid, id""")
VIEWS["value_labels"] = ([], """
  SELECT DISTINCT 'V' || (p_partkey % 60) AS qid, 'value ' || (p_partkey % 60) AS label FROM part""")


def bindings(spark: SparkSession, folder: str) -> DataFrame:
    """Property bindings of suppliers, one per line item, in line order."""
    line = read(spark, folder, "lineitem")
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    prop = F.when(F.col("l_returnflag") == "A", "P31").when(F.col("l_returnflag") == "N", "P17").otherwise("P27")
    return line.select(
        F.concat(F.lit("Q"), F.col("l_suppkey").cast("string")).alias("item"), seq.alias("seq"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Label "), F.col("l_orderkey").cast("string"))).alias("label"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("desc "), F.col("l_linenumber").cast("string"))).alias("description"),
        F.when(F.col("l_tax") > 0.02, (F.col("l_partkey") % 300).cast("int")).alias("sitelinks"), prop.alias("prop"),
        F.concat(F.lit("Q"), (F.col("l_partkey") % 9).cast("string")).alias("value"))


VIEWS["bindings"] = ([], """
  SELECT 'Q' || l_suppkey AS item, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_linenumber % 2 = 0 THEN 'Label ' || l_orderkey END AS label,
         CASE WHEN l_linestatus = 'F' THEN 'desc ' || l_linenumber END AS description, CASE WHEN l_tax > 0.02 THEN (l_partkey % 300)::INT END AS sitelinks,
         CASE WHEN l_returnflag = 'A' THEN 'P31' WHEN l_returnflag = 'N' THEN 'P17' ELSE 'P27' END AS prop, 'Q' || (l_partkey % 9) AS value
  FROM lineitem""")


def wanted_names(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "part").select(F.col("p_name").alias("name"))


def name_hits(spark: SparkSession, folder: str) -> DataFrame:
    """(name, qid, sitelinks) hits: part names in three spellings."""
    p = read(spark, folder, "part")
    spelled = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(
        F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 2**31 - 1)))
    return p.select(spelled.alias("name"), F.concat(F.lit("Q"), (F.col("p_partkey") % 500).cast("string")).alias("qid"), F.col("p_size").alias("sitelinks"))


VIEWS["name_hits"] = ([], """
  SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN p_name ELSE upper(substr(p_name, 1, 1)) || substr(p_name, 2) END AS name,
         'Q' || (p_partkey % 500) AS qid, p_size AS sitelinks FROM part""")

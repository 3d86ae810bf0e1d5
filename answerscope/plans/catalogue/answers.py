"""Queries on answer texts: extraction, grading, error types."""

from pyspark.sql import functions as F

from answerscope.functions import arrays as A
from answerscope.functions import text as T
from answerscope.functions.similarity import similarity_ratio, sorted_ratio
from answerscope.operators import error_types, grading, reshape
from answerscope.operators.selection import with_consistency
from answerscope.plans import views as V
from answerscope.plans.catalogue.registry import long_of, query, rounded
from answerscope.plans.views import cte, sql_norm
from answerscope.session import cut_lineage

# ---- SQL fragments ------------------------------------------------------------
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_STOP_TITLES = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS + T.TITLES) + "]"
_ROMAN = "[" + ", ".join(f"'{w}'" for w in T.ROMAN_NUMERALS) + "]"
_FUNCTION = ", ".join(f"'{w}'" for w in T.FUNCTION_WORDS)
_WEB = T.WEB_PATTERN
_MATH = T.MATH_PATTERN.removeprefix("(?U)")
_GLUED = rf"[a-z0-9)][.!?](?:{T.GLUED_WORDS})\b"
_LEAK = T.LEAK_PATTERN.replace("(?iU)", "(?i)")


def _words(n: str) -> str:
    return f"list_filter(string_split({n}, ' '), lambda x: x <> '')"


def _most(values: str) -> str:
    return f"coalesce(list_max(map_values(list_aggregate({values}, 'histogram'))), 0)"


def _loop(w: str) -> str:
    pairs = f"list_transform(list_zip({w}[1:len({w}) - 1], {w}[2:]), lambda p: p[1] || ' ' || p[2])"
    longer = f"list_filter({w}, lambda x: length(x) >= 3 AND NOT list_contains({_STOP}, x))"
    return f"(len({w}) >= 4 AND ({_most(pairs)} >= 3 OR {_most(longer)} >= 4))"


def _before(a: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches({a}, '{pattern}') THEN length(regexp_extract({a}, '(?s)^(.*?)(?:{pattern})', 1)) END"


def _cut(a: str) -> str:
    return f"least({_before(a, _WEB)}, {_before(a, _MATH)}, {_before(a, _GLUED)} + 2)"


_DOCS = f"docs AS (SELECT *, {_words('n')} AS w FROM (SELECT doc_id AS row_id, text AS a, {sql_norm('text')} AS n FROM documents))"
_QA_LINE = "regexp_replace(split_part(regexp_replace(answer, '^\\s+', ''), chr(10), 1), '\\s+$', '')"


def _documents(spark, folder):
    return V.read(spark, folder, "documents").select(F.col("doc_id").alias("row_id"), "text", T.normalise(F.col("text")).alias("n"))


# ---- reshaping and extraction ---------------------------------------------------
@query("X01_wide_to_long", """
  SELECT row_id, version, question FROM (
    SELECT doc_id AS row_id, text AS question, lang AS v1, source AS v2, upper(lang) AS v3, n_chars::VARCHAR AS v4 FROM documents)
  UNPIVOT (question FOR version IN (question, v1, v2, v3, v4))""")
def wide_to_long(spark, folder):
    d = V.read(spark, folder, "documents")
    wide = d.select(F.col("doc_id").alias("row_id"), F.col("text").alias("question"), F.col("lang").alias("v1"), F.col("source").alias("v2"),
                    F.upper("lang").alias("v3"), F.col("n_chars").cast("string").alias("v4"))
    return reshape.wide_to_long(wide, ["row_id"])


@query("X02_gold_resolution", """
  SELECT p_partkey::VARCHAR AS sample_id, p_name AS gold_value, [p_brand, p_type] AS gold_aliases FROM part
  UNION ALL SELECT 's' || s_suppkey, s_name, [s_name || ' Inc'] FROM supplier""")
def gold_resolution(spark, folder):
    part, supplier = V.read(spark, folder, "part"), V.read(spark, folder, "supplier")
    flat = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("obj"), F.to_json(F.array("p_brand", "p_type")).alias("o_aliases"))
    nested = supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("question_id"),
                             F.struct(F.col("s_name").alias("value"), F.array(F.concat("s_name", F.lit(" Inc"))).alias("aliases")).alias("answer"))
    return reshape.gold_flat(flat).unionByName(reshape.gold_nested(nested))


@query("X03_template", cte("qa") + f"SELECT sample_id, version, '{reshape.INSTRUCTION}Question: ' || question || chr(10) || 'Answer:' AS prompt FROM qa")
def template(spark, folder):
    return reshape.with_template(V.qa(spark, folder)).select("sample_id", "version", "prompt")


@query("X04_first_line", cte("qa") + f"SELECT sample_id, version, {_QA_LINE} AS line FROM qa")
def first_line(spark, folder):
    return V.qa(spark, folder).select("sample_id", "version", T.first_line(F.col("answer")).alias("line"))


@query("X05_cut_tokens", cte("canvases") + """
  SELECT row_id, len(body)::BIGINT AS n_tokens, coalesce(list_sum(body), 0)::BIGINT AS token_sum FROM (
    SELECT row_id, CASE WHEN p IS NULL THEN tokens ELSE tokens[1:p - 1] END AS body FROM (
      SELECT row_id, tokens, list_min(list_filter(generate_series(1, len(tokens)), lambda i: tokens[i] < 0 OR tokens[i] = 90)) AS p FROM canvases))""")
def cut_tokens(spark, folder):
    body = A.cut_at_special(F.col("tokens"), V.SPECIAL_TOKENS)
    total = F.aggregate(body, F.lit(0).cast("bigint"), lambda acc, t: acc + t)
    return V.canvases(spark, folder).select("row_id", F.size(body).cast("bigint").alias("n_tokens"), total.alias("token_sum"))


@query("X06_structured_validation", """
  SELECT event_type IN ('click', 'view') AS complete, count(*) AS n, count(DISTINCT event_id) AS n_keys FROM events GROUP BY 1""")
def structured_validation(spark, folder):
    ev = V.read(spark, folder, "events")
    full = F.to_json(F.struct(*[F.col("event_type").alias(k) for k in reshape.PARAPHRASE_KEYS]))
    short = F.to_json(F.struct(F.col("event_type").alias("v1")))
    raw = F.when(F.col("event_type").isin("click", "view"), full).when(F.col("event_type") == "error", F.lit("not json")).otherwise(short)
    good, rejected = reshape.validate_structured(ev.select("event_id", raw.alias("content")), "content", reshape.PARAPHRASE_KEYS)

    def counted(df, flag):
        return df.agg(F.lit(flag).alias("complete"), F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_keys"))

    return counted(good, True).unionByName(counted(rejected, False))


@query("X07_longest_mention", cte("answers") + """
  SELECT row_id, list_reduce(list_prepend(NULL, f), lambda b, x: CASE WHEN b IS NULL OR length(x) > length(b) THEN x ELSE b END) AS alias, len(f) > 0 AS found
  FROM (SELECT row_id, list_filter(list_prepend(gold_value, gold_aliases), lambda x: x <> '' AND strpos(lower(question), lower(x)) > 0) AS f FROM answers)""")
def longest_mention(spark, folder):
    rows = V.answers(spark, folder)
    hit = reshape.longest_mention(F.col("question"), F.concat(F.array("gold_value"), "gold_aliases"))
    return rows.withColumn("m", hit).select("row_id", F.col("m.alias").alias("alias"), F.col("m").isNotNull().alias("found"))


@query("X08_change_count", cte("qa") + f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE answer IS DISTINCT FROM {_QA_LINE}) AS changed FROM qa")
def change_count(spark, folder):
    qa = V.qa(spark, folder)
    rebuilt = qa.withColumn("answer", T.first_line(F.col("answer")))
    return reshape.change_count(qa, rebuilt, ["sample_id", "version"], "answer")


@query("X09_position_slices", """
  SELECT vec_id AS row_id, round(list_sum(embedding[-1:])::DOUBLE, 6) AS end1, round(list_sum(list_transform(embedding[-4:], lambda x: x::DOUBLE)), 6) AS end4,
         round(list_sum(list_transform(embedding[9:16], lambda x: x::DOUBLE)), 6) AS middle FROM embeddings""")
def position_slices(spark, folder):
    e = V.read(spark, folder, "embeddings")
    h = F.col("embedding")

    def total(a):
        return F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x)

    out = e.select(F.col("vec_id").alias("row_id"), total(A.last_n(h, 1)).alias("end1"), total(A.last_n(h, 4)).alias("end4"), total(A.position_range(h, 8, 8)).alias("middle"))
    return rounded(out, "end1", "end4", "middle")


# ---- grading --------------------------------------------------------------------
@query("G01_normalise", f"SELECT doc_id AS row_id, {sql_norm('text')} AS n FROM documents")
def normalise(spark, folder):
    return _documents(spark, folder).select("row_id", "n")


@query("G02_loop", f"WITH {_DOCS} SELECT row_id, {_loop('w')} AS looping FROM docs")
def loop(spark, folder):
    return _documents(spark, folder).select("row_id", T.is_looping(F.col("n")).alias("looping"))


@query("G03_continuation_start", f"WITH t AS (SELECT row_id, a FROM (SELECT doc_id AS row_id, text AS a FROM documents)), {cte('answers')[5:]} "
       f"SELECT 'document' AS source, row_id, {_cut('a')}::BIGINT AS cut FROM t UNION ALL SELECT 'answer', row_id, {_cut('model_answer')}::BIGINT FROM answers")
def continuation_start(spark, folder):
    docs = V.read(spark, folder, "documents").select(F.lit("document").alias("source"), F.col("doc_id").alias("row_id"), F.col("text").alias("a"))
    rows = V.answers(spark, folder).select(F.lit("answer").alias("source"), "row_id", F.col("model_answer").alias("a"))
    return docs.unionByName(rows).select("source", "row_id", T.continuation_start(F.col("a")).cast("bigint").alias("cut"))


@query("G04_leak", f"SELECT doc_id AS row_id, regexp_matches(text, '{_LEAK}') AS leak FROM documents")
def leak(spark, folder):
    return V.read(spark, folder, "documents").select(F.col("doc_id").alias("row_id"), T.has_leak(F.col("text")).alias("leak"))


_JUNK = f"CASE WHEN regexp_matches(a, '{_LEAK}') THEN 'leak' WHEN {_loop('w')} THEN 'loop' WHEN {_cut('a')} IS NOT NULL THEN 'continuation' END"
_ANSWERS_N = f", ans AS (SELECT *, {_words('n')} AS w FROM (SELECT *, model_answer AS a, {sql_norm('model_answer')} AS n FROM answers))"


@query("G05_junk_kind", cte("answers") + _ANSWERS_N + f"SELECT row_id, {_JUNK} AS junk FROM ans")
def junk_kind(spark, folder):
    rows = V.answers(spark, folder).withColumn("n", T.normalise(F.col("model_answer")))
    return rows.select("row_id", T.junk_kind(F.col("model_answer"), F.col("n")).alias("junk"))


def _graded_pairs(spark, folder):
    rows = grading.prepared(V.answers(spark, folder)).select("row_id", "answer_norm", F.explode("golds").alias("gold"))
    return rows.where(F.col("answer_norm") != "")


@query("G06_similarity_ratio")
def ratio(spark, folder):
    pairs = _graded_pairs(spark, folder)
    return rounded(pairs.select("row_id", "gold", similarity_ratio(F.col("answer_norm"), F.col("gold")).alias("ratio")), "ratio")


@query("G07_token_sort_ratio")
def token_sort_ratio(spark, folder):
    pairs = _graded_pairs(spark, folder)
    return rounded(pairs.select("row_id", "gold", sorted_ratio(F.col("answer_norm"), F.col("gold")).alias("ratio")), "ratio")


def _numerals(n: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter(string_split({n}, ' '), lambda x: list_contains({_ROMAN}, x)))), ' ')"


@query("G08_numeral_guard", cte("answers") + _ANSWERS_N + f"""
  SELECT row_id, {_numerals('n')} AS numerals, {_numerals('n')} = {_numerals(sql_norm('gold_value'))} AS agree FROM ans""")
def numeral_guard(spark, folder):
    n, g = T.numerals(T.normalise(F.col("model_answer"))), T.numerals(T.normalise(F.col("gold_value")))
    return V.answers(spark, folder).select("row_id", F.array_join(n, " ").alias("numerals"), (n == g).alias("agree"))


_EXACT = f"""
  , golds AS (SELECT row_id, {sql_norm("unnest(list_prepend(gold_value, gold_aliases))")} AS g FROM answers)
  , exact AS (SELECT ans.row_id, ans.fact, ans.version, coalesce(bool_or({_JUNK} IS NULL AND n <> '' AND g <> '' AND g = n AND {_numerals('n')} = {_numerals('g')}), false) AS exact
              FROM ans LEFT JOIN golds USING (row_id) GROUP BY ALL)"""


@query("G09_exact_match", cte("answers") + _ANSWERS_N + _EXACT + "SELECT row_id, exact FROM exact")
def exact_match(spark, folder):
    return grading.exact_match(grading.prepared(V.answers(spark, folder))).select("row_id", "exact")


@query("G09_correctness")
def correctness(spark, folder):
    return grading.grade(V.answers(spark, folder), keep_parts=True).select("row_id", "exact", "fuzzy", "correct")


@query("G10_group_consistency", cte("answers") + _ANSWERS_N + _EXACT + """
  SELECT row_id, exact, count(*) FILTER (WHERE exact) OVER (PARTITION BY fact) AS k_correct,
         count(*) FILTER (WHERE exact) OVER (PARTITION BY fact) || '/5' AS fact_group FROM exact""")
def group_consistency(spark, folder):
    graded = grading.exact_match(grading.prepared(V.answers(spark, folder))).select("row_id", "fact", "exact")
    rows = cut_lineage(graded)  # read by the counts of a fact and by their join
    return with_consistency(rows, "exact").select("row_id", "exact", "k_correct", "fact_group")


@query("G11_regrade_diff", cte("outcomes") + """
  SELECT count(*) FILTER (WHERE a.row_id IS NOT NULL AND b.row_id IS NOT NULL AND (a.ok IS DISTINCT FROM b.ok OR a.new_type IS DISTINCT FROM b.new_type)) AS changed,
         count(*) FILTER (WHERE b.row_id IS NULL) AS only_old, count(*) FILTER (WHERE a.row_id IS NULL) AS only_new
  FROM (SELECT * FROM outcomes WHERE cond = 'base') a FULL JOIN (SELECT * FROM outcomes WHERE cond = 'c1' AND relation <> 'r1') b ON a.row_id = b.row_id""")
def regrade_diff(spark, folder):
    o = V.outcomes(spark, folder)
    return grading.difference_count(o.where("cond = 'base'"), o.where("cond = 'c1' and relation <> 'r1'"), ["row_id"], ["ok", "new_type"])


# ---- error types ------------------------------------------------------------------
_TYPED = f"""
  , parts AS (SELECT *, {_cut('a')} AS cut, {_words(sql_norm('question'))} AS q,
                     list_filter({_words('n')}, lambda x: NOT list_contains({_STOP_TITLES}, x)) AS cw,
                     regexp_replace(regexp_replace(a, '^[ ."'']+', ''), '[ ."'']+$', '') AS name FROM ans)
  , heads AS (SELECT *, CASE WHEN cut IS NULL THEN n ELSE {sql_norm('substr(a, 1, cut)')} END AS nh FROM parts)
  , ruled AS (SELECT *, CASE
      WHEN n = '' THEN 'broken-empty'
      WHEN nh <> '' AND len({_words('nh')}) <= 14 AND (regexp_matches(nh, '{T.REFUSAL_PATTERN}') OR nh IN ('no', 'none', 'nobody', 'nothing')) THEN 'abstain'
      WHEN regexp_matches(a, '{_LEAK}') THEN 'broken-leak'
      WHEN {_loop('w')} THEN 'broken-loop'
      WHEN cut IS NOT NULL THEN 'broken-continuation'
      WHEN regexp_matches(replace(n, ' ', ''), '^[0-9]+$') OR length(replace(n, ' ', '')) = 1 OR n IN ({_FUNCTION}) THEN 'broken-invalid'
      WHEN len(cw) > 0 AND len(list_filter(cw, lambda x: NOT list_contains(q, x))) = 0 THEN 'broken-copy'
      WHEN relation NOT IN ('father', 'mother') AND len(list_filter(regexp_split_to_array(trim(name), '\\s+'), lambda x: x <> '')) BETWEEN 1 AND 6
           AND len(list_filter(cw, lambda x: list_contains(q, x))) > 0 AND len(list_filter(cw, lambda x: NOT list_contains(q, x))) > 0 THEN 'lookup'
      ELSE 'entity' END AS early FROM heads)
  , typed AS (SELECT r.row_id, r.fact, r.early, c.qids, e.exact AS correct,
      CASE WHEN e.exact THEN 'correct' WHEN early = 'lookup' AND len(c.qids) = 0 THEN 'broken-fabricated' WHEN early = 'lookup' THEN 'entity' ELSE early END AS rule,
      NOT e.exact AND early = 'lookup' AND c.qids IS NULL AS unverified
      FROM ruled r JOIN exact e USING (row_id) LEFT JOIN name_cache c ON c.name = r.name)
  , final AS (SELECT *, CASE WHEN rule LIKE 'broken%' THEN 'broken' ELSE rule END AS type3 FROM typed)"""
_BASE = cte("answers", "name_cache") + _ANSWERS_N + _EXACT + _TYPED


def _ruled(spark, folder):
    return error_types.rule_inputs(V.answers(spark, folder))


def _exactly_graded(spark, folder):
    """Answers graded by the exact branch only, which plain SQL can also compute."""
    return grading.exact_match(grading.prepared(V.answers(spark, folder))).withColumn("correct", F.col("exact")).drop("golds", "junk", "usable", "exact")


def _typed(spark, folder):
    return error_types.classify(_exactly_graded(spark, folder), V.name_cache(spark, folder))


def _rule_query(name, condition, sql):
    @query(name, _BASE + f"SELECT row_id, {sql} AS hit FROM heads")
    def run(spark, folder):
        return _ruled(spark, folder).select("row_id", condition().alias("hit"))


_rule_query("C01_broken_empty", lambda: F.col("__norm") == "", "n = ''")
_rule_query("C02_abstain", lambda: T.is_refusal(F.col("__head")),
            f"nh <> '' AND len({_words('nh')}) <= 14 AND (regexp_matches(nh, '{T.REFUSAL_PATTERN}') OR nh IN ('no', 'none', 'nobody', 'nothing'))")
_rule_query("C03_broken_leak", lambda: T.has_leak(F.col("__raw")), f"regexp_matches(a, '{_LEAK}')")
_rule_query("C04_broken_loop", lambda: T.is_looping(F.col("__norm")), _loop("w"))
_rule_query("C05_broken_continuation", lambda: F.col("__cut").isNotNull(), "cut IS NOT NULL")
_rule_query("C06_broken_invalid", lambda: T.is_invalid_shape(F.col("__norm")),
            f"regexp_matches(replace(n, ' ', ''), '^[0-9]+$') OR length(replace(n, ' ', '')) = 1 OR n IN ({_FUNCTION})")
_rule_query("C08_broken_copy", error_types.is_copy, "len(cw) > 0 AND len(list_filter(cw, lambda x: NOT list_contains(q, x))) = 0")


@query("C07_content_words", f"WITH {_DOCS} SELECT row_id, array_to_string(list_filter(w, lambda x: NOT list_contains({_STOP_TITLES}, x)), ' ') AS content FROM docs")
def content_words(spark, folder):
    return _documents(spark, folder).select("row_id", F.array_join(T.content_words(F.col("n")), " ").alias("content"))


@query("C09_maybe_fabricated", _BASE + "SELECT row_id, early FROM ruled")
def maybe_fabricated(spark, folder):
    return _ruled(spark, folder).select("row_id", error_types.early_rule().alias("early"))


@query("C10_three_valued_lookup", _BASE + """
  SELECT row_id, CASE WHEN correct OR early <> 'lookup' THEN NULL WHEN qids IS NULL THEN 'unknown' WHEN len(qids) = 0 THEN 'absent' ELSE 'found' END AS lookup, rule, unverified
  FROM final""")
def three_valued_lookup(spark, folder):
    rows = error_types.classify(_exactly_graded(spark, folder), V.name_cache(spark, folder), keep_lookup=True)
    return rows.select("row_id", "lookup", "rule", "unverified")


@query("C11_cascade", _BASE + "SELECT row_id, correct, type3, rule, unverified FROM final")
def cascade(spark, folder):
    return _typed(spark, folder).select("row_id", "correct", "type3", "rule", "unverified")


@query("C12_type_counts", _BASE + "SELECT type3, rule, count(*) AS n, count(*) FILTER (WHERE unverified) AS n_unverified FROM final WHERE NOT correct GROUP BY ALL")
def type_counts(spark, folder):
    return error_types.type_counts(_typed(spark, folder))


@query("C13_wrong_row_diff", _BASE + """
  SELECT count(*) FILTER (WHERE final.rule IS DISTINCT FROM CASE WHEN correct THEN 'correct' ELSE ruled.early END) AS changed,
         0::BIGINT AS only_old, 0::BIGINT AS only_new FROM final JOIN ruled USING (row_id)""")
def wrong_row_diff(spark, folder):
    # both sides look up the same rules, so texts are graded and ruled once
    ruled = cut_lineage(error_types.ruled(_exactly_graded(spark, folder)).select("row_id", "__rule", "__key"))
    names = V.name_cache(spark, folder)
    new = error_types.classify(ruled, names).select("row_id", "rule")
    before = error_types.classify(ruled, names.limit(0), keep_lookup=True)
    old = before.select("row_id", F.when(F.col("lookup").isNotNull(), "lookup").otherwise(F.col("rule")).alias("rule"))
    return grading.difference_count(old, new, ["row_id"], ["rule"])


@query("C14_type_mix", _BASE + """
  , k AS (SELECT fact, count(*) FILTER (WHERE correct) || '/5' AS fact_group FROM final GROUP BY fact)
  SELECT coalesce(fact_group, 'all') AS fact_group, count(DISTINCT fact) AS facts, count(*) AS rows, count(*) FILTER (WHERE type3 = 'correct') AS correct,
         count(*) FILTER (WHERE type3 = 'entity') AS entity, count(*) FILTER (WHERE type3 = 'broken') AS broken, count(*) FILTER (WHERE type3 = 'abstain') AS abstain,
         round(count(*) FILTER (WHERE type3 = 'broken')::DOUBLE / nullif(count(*) FILTER (WHERE NOT correct), 0), 6) AS broken_of_wrong
  FROM final JOIN k USING (fact) GROUP BY ROLLUP (fact_group)""")
def type_mix(spark, folder):
    typed = cut_lineage(_typed(spark, folder).select("fact", "correct", "type3"))  # read by the counts of a fact and by their join
    mix = error_types.type_mix(with_consistency(typed))
    return rounded(mix.select("fact_group", *long_of("facts", "rows", "correct", "entity", "broken", "abstain"), "broken_of_wrong"), "broken_of_wrong")


@query("C15_rule_mix", _BASE + """
  SELECT type3, rule, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY type3)::DOUBLE, 6) AS share FROM final WHERE NOT correct GROUP BY type3, rule""")
def rule_mix(spark, folder):
    return rounded(error_types.rule_mix(_typed(spark, folder)), "share")

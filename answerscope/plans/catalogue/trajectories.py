"""Queries on decoding trajectories."""

from pyspark.sql import functions as F

from answerscope.operators import trajectories as T
from answerscope.plans import views as V
from answerscope.plans.catalogue.registry import query, rounded
from answerscope.plans.views import STEPS, cte

_COMMITS = ", commits AS (SELECT row_id, slot, coalesce(min(step) FILTER (WHERE NOT masked), 8)::INT AS commit FROM slots GROUP BY ALL)"
_RANGES = """
  , cuts AS (SELECT row_id, tokens, coalesce(list_min(list_filter(generate_series(1, len(tokens)), lambda i: tokens[i] < 0 OR tokens[i] = 90)) - 1, len(tokens)) AS stop FROM canvases)
  , firsts AS (SELECT row_id, stop::INT AS stop, list_min(list_filter(generate_series(1, stop), lambda i: tokens[i] NOT IN (10, 11))) - 1 AS first FROM cuts)
  , ranges AS (SELECT row_id, stop, coalesce(first, -1)::INT AS start FROM firsts)"""
_VIEW = cte("slots", "canvases") + _COMMITS + _RANGES
_ANSWER = """
  , answer AS (SELECT row_id, coalesce(arg_min(commit, slot), -1)::INT AS first, coalesce(max(commit), -1)::INT AS last, coalesce(min(commit), -1)::INT AS earliest
               FROM ranges LEFT JOIN commits ON commits.row_id = ranges.row_id AND start >= 0 AND slot >= start AND slot < stop GROUP BY ranges.row_id)"""
_ANSWER = _ANSWER.replace("SELECT row_id, coalesce(arg_min", "SELECT ranges.row_id, coalesce(arg_min")


@query("T01_commit_step", cte("slots") + _COMMITS + " SELECT row_id, slot, commit FROM commits")
def commit_step(spark, folder):
    return T.commit_steps(V.slots(spark, folder), STEPS)


@query("T02_answer_range", _VIEW + " SELECT row_id, start, stop FROM ranges")
def answer_range(spark, folder):
    return T.answer_range(V.canvases(spark, folder), V.SPECIAL_TOKENS, V.BLANK_TOKENS).select("row_id", "start", "stop")


def _answer(spark, folder):
    ranges = T.answer_range(V.canvases(spark, folder), V.SPECIAL_TOKENS, V.BLANK_TOKENS)
    return T.answer_commit(T.commit_steps(V.slots(spark, folder), STEPS), ranges)


@query("T03_answer_commit", _VIEW + _ANSWER + " SELECT * FROM answer")
def answer_commit(spark, folder):
    return _answer(spark, folder)


@query("T04_early_late", cte("slots", "canvases", "outcomes") + _COMMITS + _RANGES + _ANSWER + """
  SELECT cond, CASE WHEN first < 0 THEN 'empty' WHEN first <= 3 THEN 'early' ELSE 'late' END AS timing, count(*) AS n,
         round(avg((new_type = 'correct')::INT), 6) AS share_correct, round(avg((new_type = 'broken')::INT), 6) AS share_broken
  FROM outcomes JOIN answer ON answer.row_id = outcomes.fact GROUP BY ALL""")
def early_late(spark, folder):
    """The slots of a fact stand for those of its answers; eight steps, so 'early' means three."""
    outcomes = V.outcomes(spark, folder).drop("row_id").withColumnRenamed("fact", "row_id")
    return rounded(T.early_late(_answer(spark, folder), outcomes, boundary=3), "share_correct", "share_broken")

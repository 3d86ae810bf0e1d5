"""Typing wrong answers: the first matching rule wins."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from answerscope.functions import text as T

RULES = ["broken-empty", "abstain", "broken-leak", "broken-loop", "broken-continuation", "broken-invalid", "broken-copy",
         "broken-fabricated", "entity"]


def _normalised_parts(answers: pa.Array, questions: pa.Array, cuts: pa.Array) -> list[pa.Array]:
    """Answers, questions and heads, normalised; an answer that is not cut is its own head."""
    raw, cut = answers.to_pylist(), pc.is_valid(cuts)
    heads = T.normalised(pa.array([a[:n] for a, n in zip(raw, cuts.to_pylist()) if n is not None], pa.string()))
    mine = T.normalised(answers)
    return [mine, T.normalised(questions), pc.replace_with_mask(mine, cut, heads) if len(heads) else mine]


@F.arrow_udf(StructType().add("norm", StringType()).add("head", StringType()).add("question", ArrayType(StringType())).add("content", ArrayType(StringType())))
def _forms(answers: pa.Array, questions: pa.Array, cuts: pa.Array) -> pa.Array:
    """Normalised answer and head, words of the question, content words of the answer."""
    mine, asked, heads = _normalised_parts(answers, questions, cuts)
    lists = [pa.array(x, pa.list_(pa.string())) for x in (T.words_of(asked), [T.content_of(w) for w in T.words_of(mine)])]
    return pa.StructArray.from_arrays([mine, heads, *lists], ["norm", "head", "question", "content"])


def rule_inputs(df: DataFrame, answer: str = "model_answer", question: str = "question") -> DataFrame:
    """Everything the rules look at, computed once per row."""
    raw = F.coalesce(F.col(answer), F.lit(""))
    based = df.withColumns({"__raw": raw, "__asked": F.col(question), "__cut": T.continuation_start(raw)})
    return (
        based.withColumn("__forms", _forms(F.col("__raw"), F.col("__asked"), F.col("__cut")))
        .withColumns({"__norm": F.col("__forms.norm"), "__head": F.col("__forms.head"), "__question": F.col("__forms.question"),
                      "__content": F.col("__forms.content"), "__name": T.bare_name(F.col("__raw"))}).drop("__forms")
    )


def is_copy() -> Column:
    """Every content word of the answer is a word of the question."""
    content = F.col("__content")
    return (F.size(content) > 0) & (F.size(F.array_except(content, F.col("__question"))) == 0)


def _may_be_fabricated(answer: str, content: set[str], question: set[str], relation: str | None) -> bool:
    """C09 before the lookup: a short name partly made of question words, outside family relations."""
    if relation in T.KIN_RELATIONS or content.isdisjoint(question) or content <= question:
        return False
    return 1 <= len(answer.strip(T.AROUND_NAMES).split()) <= 6


@F.arrow_udf(StringType())
def _early_rule(answers: pa.Array, questions: pa.Array, cuts: pa.Array, leaks: pa.Array, relations: pa.Array) -> pa.Array:
    mine, asked, heads = (x.to_pylist() for x in _normalised_parts(answers, questions, cuts))

    def one(answer, norm, asked, head, cut, leak, relation):
        w = norm.split()
        if not w:
            return "broken-empty"
        if T.refuses(w if head == norm else head.split()):
            return "abstain"
        if leak:
            return "broken-leak"
        if T.loops(w):
            return "broken-loop"
        if cut is not None:
            return "broken-continuation"
        if T.has_invalid_shape(w):
            return "broken-invalid"
        content, question = set(T.content_of(w)), set(asked.split())
        if content and content <= question:
            return "broken-copy"
        return "lookup" if _may_be_fabricated(answer, content, question, relation) else "entity"

    rows = zip(answers.to_pylist(), mine, asked, heads, cuts.to_pylist(), leaks.to_pylist(), relations.to_pylist())
    return pa.array([one(*row) for row in rows], pa.string())


def early_rule(relation: str = "relation") -> Column:
    """C01-C08, then 'lookup' where the name table decides, then 'entity': the words of a row are looked at in one Python pass."""
    return _early_rule(F.col("__raw"), F.col("__asked"), F.col("__cut"), T.has_leak(F.col("__raw")), F.col(relation))


def ruled(df: DataFrame, row_id: str = "row_id", answer: str = "model_answer", question: str = "question",
          relation: str = "relation", correct: str | None = "correct") -> DataFrame:
    """Adds ``__rule``, 'lookup' where the name table decides, and the ``__key`` to look up.

    Rows that need no lookup get a key of their own, which never matches and spreads evenly,
    instead of one shared NULL key.
    """
    rows = rule_inputs(df, answer, question).withColumn("__rule", early_rule(relation))
    if correct:
        rows = rows.withColumn("__rule", F.when(F.col(correct), "correct").otherwise(F.col("__rule")))
    own_key = F.concat(F.lit("\x00"), F.col(row_id).cast("string"))
    return rows.withColumn("__key", F.when(F.col("__rule") == "lookup", F.col("__name")).otherwise(own_key)).drop(
        "__raw", "__asked", "__norm", "__question", "__cut", "__head", "__content", "__name")


def classify(df: DataFrame, names: DataFrame, row_id: str = "row_id", answer: str = "model_answer", question: str = "question",
             relation: str = "relation", correct: str | None = "correct", keep_lookup: bool = False) -> DataFrame:
    """C11: adds type3, rule and unverified (and the three-valued ``lookup`` of the rows that needed one).

    ``names`` is (name, qids): a missing name is unknown, an empty list means no candidate (C10).
    Rows that ``ruled`` has been through keep its rules, so a table looked up twice is ruled once.
    """
    rows = df if "__rule" in df.columns else ruled(df, row_id, answer, question, relation, correct)
    needs = F.col("__rule") == "lookup"
    known = names.select(F.col("name").alias("__key"), F.size("qids").alias("__candidates"))
    joined = rows.join(known, "__key", "left")
    rule = (
        F.when(needs & (F.col("__candidates") == 0), "broken-fabricated").when(needs, "entity").otherwise(F.col("__rule"))
    )
    found = F.when(F.col("__candidates").isNull(), "unknown").when(F.col("__candidates") == 0, "absent").otherwise("found")
    kind = F.when(rule.startswith("broken"), "broken").otherwise(rule)
    helpers = ["__rule", "__key", "__candidates"]
    typed = joined.withColumn("type3", kind).withColumn("rule", rule).withColumn("unverified", needs & F.col("__candidates").isNull())
    if keep_lookup:
        typed = typed.withColumn("lookup", F.when(needs, found))
    return typed.drop(*helpers)


def type_counts(typed: DataFrame) -> DataFrame:
    """Wrong rows per type and rule, with the unverified ones.

    Wrong rows are counted rather than filtered: a filter on the rule would be pushed below the
    text work and evaluate every pattern twice.
    """
    counts = typed.groupBy("type3", "rule").agg(F.count_if(~F.col("correct")).alias("n"), F.count_if("unverified").alias("n_unverified"))
    return counts.where(F.col("n") > 0)


def type_mix(typed: DataFrame, by: Sequence[str] = ("fact_group",), fact: str = "fact") -> DataFrame:
    """C14: facts, rows and rows per type, with the broken share of wrong rows, plus a total row."""
    keys = list(by)
    label = [F.coalesce(F.col(k).cast("string"), F.lit("all")).alias(k) for k in keys]
    # a fact lies in one group, so distinct facts are counted once per group and summed upwards
    per_fact = typed.groupBy(*keys, fact).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("type3") == t).alias(t) for t in ("correct", "entity", "broken", "abstain")])
    totals = per_fact.rollup(*keys).agg(
        F.count(F.lit(1)).alias("facts"), F.sum("rows").alias("rows"), *[F.sum(t).alias(t) for t in ("correct", "entity", "broken", "abstain")])
    wrong = (F.col("rows") - F.col("correct")).cast("double")
    return totals.select(*label, "facts", "rows", "correct", "entity", "broken", "abstain",
                         (F.col("broken") / F.nullif(wrong, F.lit(0.0))).alias("broken_of_wrong"))


def rule_mix(typed: DataFrame, within: str = "type3", rule: str = "rule") -> DataFrame:
    """Share of each rule inside its type among wrong rows (a handful of rows after the first aggregation)."""
    counts = typed.groupBy(within, rule).agg(F.count_if(~F.col("correct")).alias("n")).where(F.col("n") > 0)
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(within)).cast("double"))

"""Reshaping and text extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSIONS = ["question", "v1", "v2", "v3", "v4"]

# ---- fixed values -----------------------------------------------------------
INSTRUCTION = "Answer the question with only the direct answer: a short phrase or name, no explanation, no full sentences.\n\n"
PARAPHRASE_KEYS = ["answer_type", "relation", "v1", "v2", "v3", "v4"]


def wide_to_long(df: DataFrame, keys: Sequence[str], versions: Sequence[str] = tuple(VERSIONS)) -> DataFrame:
    """One row per wording."""
    return df.unpivot(list(keys), list(versions), "version", "question")


def parse_aliases(column: Column) -> Column:
    """Alias list kept as JSON text; missing means none, malformed text fails."""
    return F.from_json(F.coalesce(column, F.lit("[]")), "array<string>", {"mode": "FAILFAST"})


def gold_flat(df: DataFrame) -> DataFrame:
    """Flat source, gold in ``obj`` and aliases as JSON text in ``o_aliases``."""
    return df.select(F.col("id").cast("string").alias("sample_id"), F.col("obj").alias("gold_value"), parse_aliases(F.col("o_aliases")).alias("gold_aliases"))


def gold_nested(df: DataFrame) -> DataFrame:
    """Nested source, gold in ``answer.value`` and ``answer.aliases``."""
    nothing = F.array().cast("array<string>")
    return df.select(F.col("question_id").cast("string").alias("sample_id"), F.col("answer.value").alias("gold_value"),
                     F.coalesce(F.col("answer.aliases"), nothing).alias("gold_aliases"))


def with_template(df: DataFrame, instruction: str = INSTRUCTION + "Question: ", question: str = "question", tail: str = "\nAnswer:",
                  name: str = "prompt") -> DataFrame:
    """Instruction + question."""
    return df.withColumn(name, F.concat(F.lit(instruction), F.col(question), F.lit(tail)))


def validate_structured(df: DataFrame, column: str, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose JSON object holds all required keys, parsed, and the rejected rest."""
    schema = ", ".join(f"`{c}` string" for c in required)
    parsed = df.withColumn("__p", F.from_json(column, schema))
    needed = F.array(*[F.lit(c) for c in required])
    complete = F.coalesce(F.size(F.array_except(needed, F.json_object_keys(column))) == 0, F.lit(False))
    good = parsed.where(complete).select(*df.columns, *[F.col(f"__p.{c}").alias(f"out_{c}") for c in required])
    return good, parsed.where(~complete).drop("__p")


def longest_mention(text: Column, aliases: Column) -> Column:
    """The longest alias found in the text, any case, as struct(alias, start); NULL when none is."""
    lower = F.lower(text)
    found = F.filter(aliases, lambda a: (a != "") & (F.instr(lower, F.lower(a)) > 0))
    best = F.aggregate(found, F.lit(None).cast("string"),
                       lambda acc, a: F.when(acc.isNull() | (F.length(a) > F.length(acc)), a).otherwise(acc))
    return F.when(F.size(found) > 0, F.struct(best.alias("alias"), (F.instr(lower, F.lower(best)) - 1).alias("start")))


def change_count(old: DataFrame, new: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Rows whose rebuilt value differs."""
    again = new.select(*keys, F.col(column).alias("__new"))
    return old.join(again, list(keys)).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col(column).eqNullSafe(F.col("__new"))).alias("changed"))

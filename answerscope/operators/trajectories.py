"""Per-row trajectories over decoding steps, on ``slots(row_id, step, slot, masked, ...)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscope.functions.arrays import cut_at_special, leading_count
from answerscope.functions.text import bind


def commit_steps(slots: DataFrame, steps: int) -> DataFrame:
    """Number of leading masked steps of every slot, ``steps`` when never filled.

    Equal to the first unmasked step, so a plain minimum does it: no window, combined map-side.
    """
    first = F.min(F.when(~F.col("masked"), F.col("step")))
    return slots.groupBy("row_id", "slot").agg(F.coalesce(first, F.lit(steps)).cast("int").alias("commit"))


def answer_range(canvases: DataFrame, special: Sequence[int], blank: Sequence[int], tokens: str = "tokens") -> DataFrame:
    """First and past-the-end answer slot; start is -1 for an empty answer."""
    def bounds(body: Column) -> Column:
        first, end = leading_count(body, blank), F.size(body)
        return F.struct(F.when(first < end, first).otherwise(F.lit(-1)).alias("start"), end.alias("stop"))

    found = bind(F.col(tokens), lambda t: bind(cut_at_special(t, special), bounds))
    return canvases.withColumn("__r", found).withColumn("start", F.col("__r.start")).withColumn("stop", F.col("__r.stop")).drop("__r")


def answer_commit(commits: DataFrame, ranges: DataFrame) -> DataFrame:
    """Commit step of the first answer slot, the latest and the earliest; -1 for empty answers."""
    inside = commits.join(ranges.select("row_id", "start", "stop"), "row_id").where(
        (F.col("start") >= 0) & (F.col("slot") >= F.col("start")) & (F.col("slot") < F.col("stop")))
    stats = inside.groupBy("row_id").agg(
        F.min_by("commit", "slot").alias("first"), F.max("commit").alias("last"), F.min("commit").alias("earliest"))
    missing = {c: F.coalesce(F.col(c), F.lit(-1)) for c in ("first", "last", "earliest")}
    return ranges.select("row_id").join(stats, "row_id", "left").withColumns(missing)


def early_late(commit: DataFrame, outcomes: DataFrame, boundary: int = 8) -> DataFrame:
    """Outcome shares of rows whose first slot was filled early, late, or never held an answer."""
    when = F.when(F.col("first") < 0, "empty").when(F.col("first") <= boundary, "early").otherwise("late")
    return outcomes.join(commit.select("row_id", when.alias("timing")), "row_id").groupBy("cond", "timing").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("new_type") == "correct").cast("double")).alias("share_correct"),
        F.avg((F.col("new_type") == "broken").cast("double")).alias("share_broken"))

"""Row selection, knowledge states, leak-free splits and seeded samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscope.functions.hashing import hash32
from answerscope.operators import order


def with_consistency(df: DataFrame, correct: str = "correct", fact: str = "fact", wordings: int = 5) -> DataFrame:
    """Adds k_correct and fact_group 'k/<wordings>' to every row.

    Counts are combined map-side and joined back; the join splits a hot fact, a window could not.
    """
    k = df.groupBy(fact).agg(F.count_if(F.col(correct)).alias("k_correct"))
    return df.join(k, fact).withColumn("fact_group", F.concat(F.col("k_correct").cast("string"), F.lit(f"/{wordings}")))


def partly_known(df: DataFrame, min_k: int = 1, wordings: int = 5) -> DataFrame:
    """facts right in ``min_k`` .. all-but-one wordings."""
    return df.where(F.col("k_correct").between(min_k, wordings - 1))


def with_both_outcomes(df: DataFrame, correct: str = "correct", fact: str = "fact") -> DataFrame:
    """rows of facts that hold a right and a wrong row."""
    mixed = df.groupBy(fact).agg(F.bool_or(correct).alias("__any"), F.bool_and(correct).alias("__every"))
    return df.join(mixed.where(F.col("__any") & ~F.col("__every")), fact, "left_semi")


def typed_or_mixed(df: DataFrame, kinds: Sequence[str] = ("entity", "broken")) -> DataFrame:
    """wrong rows of the given types, or partly known rows of facts with both outcomes, each once."""
    typed = ~F.col("correct") & F.col("kind").isin(list(kinds))
    outcomes = partly_known(df).groupBy("fact").agg(F.bool_or("correct").alias("__any"), F.bool_and("correct").alias("__every"))
    mixed = outcomes.where(F.col("__any") & ~F.col("__every")).select("fact", F.lit(True).alias("__mixed"))
    return df.join(mixed, "fact", "left").where(typed | F.col("__mixed")).drop("__mixed")


def known_state(kind_wanted: str, min_k: int = 1) -> Column:
    """know / known5 / kbw / dont for one wrong type, NULL for rows to leave out."""
    mid = F.col("k_correct").between(min_k, 4)
    right = F.col("correct")
    wanted = ~right & (F.col("kind") == kind_wanted)
    return (
        F.when(right & mid, "know").when(right & (F.col("k_correct") == 5), "known5")
        .when(wanted & mid, "kbw").when(wanted & (F.col("k_correct") == 0), "dont")
    )


def three_way_state() -> Column:
    """KNOW, UNK or KBW, NULL for right rows of partly known facts."""
    k = F.col("k_correct")
    return (
        F.when(F.col("correct") & (k == 5), "KNOW").when(~F.col("correct") & (k == 0), "UNK")
        .when(~F.col("correct") & k.between(1, 4), "KBW")
    )


def effective_type(kind: str = "type3") -> Column:
    """the error type of wrong rows, 'correct' otherwise."""
    return F.when(F.col("correct"), F.lit("correct")).otherwise(F.col(kind))


def with_subject(df: DataFrame, facts: DataFrame, fact: str = "fact") -> DataFrame:
    """attach the split unit; Spark broadcasts the fact table only when it measures small."""
    return df.join(facts, fact)


def half(unit: str = "subject") -> Column:
    """'dev' or 'test' by hash of the split unit, so a unit is never on both sides."""
    return F.when(hash32(unit) % 2 == 0, "dev").otherwise("test")


def fold(unit: str = "subject", n: int = 5) -> Column:
    """fold number of the split unit."""
    return (hash32(unit) % n).cast("int")


def inner_fold(unit: str = "subject", n: int = 5) -> Column:
    """fold inside one side; a second salt keeps it independent of the outer split."""
    return (hash32(unit, seed="inner") % n).cast("int")


def sample_per_class(df: DataFrame, n: int, by: Sequence[str], row_id: str = "row_id", seed: object = 0, **kw) -> DataFrame:
    """exactly ``n`` rows per class, or all of a smaller class."""
    return order.take_by_hash(df, row_id, by, F.lit(n), seed, **kw)


def cap_rows(df: DataFrame, n: int = 20_000, row_id: str = "row_id", seed: object = 0, **kw) -> DataFrame:
    """at most ``n`` training rows."""
    return order.take_by_hash(df, row_id, (), F.lit(n), seed, **kw)


def share_found(df: DataFrame, flag: str) -> DataFrame:
    """F13 guard: share of rows with the flag set."""
    return df.agg(F.avg(F.col(flag).cast("double")).alias("found_share"))


def non_zero_vectors(df: DataFrame, vector: str = "h") -> DataFrame:
    """rows whose vector is not all zeros."""
    return df.where(F.exists(vector, lambda x: x != 0))


def identical_only(df: DataFrame, rerun: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """rows whose regenerated value equals the stored one."""
    again = rerun.select(*keys, F.col(column).alias("__again"))
    return df.join(again, list(keys)).where(F.col(column).eqNullSafe(F.col("__again"))).drop("__again")


def same_fact_donor(targets: DataFrame, donors: DataFrame, fact: str = "fact", row_id: str = "row_id") -> DataFrame:
    """the first donor row of the target's own fact, NULL without one."""
    first = donors.groupBy(fact).agg(F.min(row_id).alias("donor"))
    return targets.join(first, fact, "left")


def same_category_donor(targets: DataFrame, donors: DataFrame, category: str = "relation", fact: str = "fact",
                        row_id: str = "row_id", seed: object = 0) -> DataFrame:
    """a pseudo-random donor of the same category and another fact, NULL only when none exists.

    A category has as many hash slots as donors, so that all are within reach; each slot keeps its
    best donor and the best donor of another fact, so a target joins one row, never a list.  A target whose own
    slot holds no usable donor takes the category-wide pair in the same way.
    """
    sizes = donors.groupBy(category).agg(F.count(F.lit(1)).alias("__slots"))
    ranked = donors.join(sizes, category).select(
        category, F.col(fact).alias("__fact"),
        F.struct(hash32(row_id, seed=seed).alias("h"), F.col(row_id).cast("bigint").alias("id"), F.col(fact).alias("f")).alias("__d"),
        (hash32(row_id, seed=f"{seed}:slot") % F.col("__slots")).alias("__slot"))
    per_fact = ranked.groupBy(category, "__slot", "__fact").agg(F.min("__d").alias("__d"))

    def two_best(rows: DataFrame, keys: list[str], prefix: str) -> DataFrame:
        best = rows.groupBy(*keys).agg(F.min("__d").alias(f"{prefix}1"))
        other = (
            rows.join(best, keys).where(F.col("__d.f") != F.col(f"{prefix}1.f"))
            .groupBy(*keys).agg(F.min("__d").alias(f"{prefix}2"))
        )
        return best.join(other, keys, "left")

    slot_best = two_best(per_fact, [category, "__slot"], "__s")
    all_best = two_best(per_fact, [category], "__c")

    def usable(d: str) -> Column:
        return F.when(F.col(f"{d}.f") != F.col(fact), F.col(f"{d}.id"))

    return (
        targets.join(sizes, category, "left").withColumn("__slot", hash32(row_id, seed=f"{seed}:target") % F.col("__slots"))
        .join(slot_best, [category, "__slot"], "left").join(all_best, category, "left")
        .withColumn("donor", F.coalesce(usable("__s1"), usable("__s2"), usable("__c1"), usable("__c2")))
        .drop("__slot", "__slots", "__s1", "__s2", "__c1", "__c2")
    )


def uneven_conditions(outcomes: DataFrame, condition: str = "cond", row_id: str = "row_id") -> DataFrame:
    """conditions that lack a row some other condition has; empty means the guard holds."""
    pairs = outcomes.select(condition, row_id).distinct()
    total = pairs.select(row_id).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return pairs.groupBy(condition).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_all", total).where("n_rows <> n_all")

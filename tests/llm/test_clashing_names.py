"""Columns of the input that are called like columns the operators make themselves keep their values."""

import pytest
from pyspark.sql import functions as F

from answerscope.llm import language_id, mixing, suffix_dedup, toxicity
from answerscope.llm.common import free_name

TEXT = "some plain words about a river and its banks "


def rows():
    return [(k, TEXT * (1 + k % 3) + str(k), "en", "ab"[k % 2]) for k in range(6)] + [(7, None, "en", "a"), (7, None, "en", "a"), (None, "x y", None, None)]


def clashing(spark, *names):
    docs = spark.createDataFrame(rows(), "doc_id bigint, text string, lang string, source string")
    for k, n in enumerate(names):
        docs = docs.withColumn(n, F.coalesce(F.col("doc_id"), F.lit(-1)) * 10 + k)
    return docs


def holds(got, names):
    found = got.select("doc_id", *[f"`{n}`" for n in names]).collect()
    return all(r[1 + k] == (-1 if r[0] is None else r[0]) * 10 + k for r in found for k in range(len(names)))


def test_free_name():
    assert [free_name("a", c) for c in ([], ["b"], ["A"], ["a", "a_"])] == ["a", "a", "a_", "a__"]


@pytest.mark.parametrize("names", [("m_size", "mix_copy"), ("mix_n", "m_list", "m_id", "M_SIZE"), ("m_source", "start", "m_copies", "row")])
def test_mixed_rows(spark, names):
    docs = clashing(spark, *names)
    got = mixing.mixed_rows(docs)
    copy = free_name("mix_copy", docs.columns)
    assert got.columns == [*docs.columns, copy]
    assert holds(got, names)
    plain = mixing.mixed_rows(clashing(spark)).groupBy("doc_id").agg(F.max("mix_copy")).collect()
    assert sorted(map(tuple, got.groupBy("doc_id").agg(F.max(copy)).collect()), key=str) == sorted(map(tuple, plain), key=str)


def test_remove_repeats(spark):
    names = ("s_hash", "s_places", "s_id", "s_text", "s_key")
    docs = clashing(spark, *names).withColumn("text", F.concat("text", F.lit("=" * 250)))
    got = suffix_dedup.remove_repeats(docs)
    assert got.columns == docs.columns and got.count() == docs.count() and holds(got, names)
    assert "=" not in "".join(r.text or "" for r in got.collect())


def test_without_toxic_and_language(spark):
    names = ("x_score", "x_toxic", "X_TEXT", "score", "lang_pred", "toxic_flag")
    docs = clashing(spark, *names)
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)] + [(1, 0), (2, 1)], "doc_id bigint, toxic int")
    got = toxicity.without_toxic(docs, labels)
    assert got.columns == docs.columns and holds(got, names)
    model = toxicity.train(docs, labels)
    scored = toxicity.with_scores(docs, model)
    assert scored.columns[-2:] == ["score", "toxic_flag"] and scored.columns.count("score") == 1
    assert all(0 <= r.score <= 1 for r in scored.collect())
    spoken = language_id.with_language(docs, language_id.train(docs))
    assert spoken.columns[-2:] == ["lang_pred", "score"] and spoken.columns.count("score") == 1
    assert {r.lang_pred for r in spoken.collect()} == {"en", "und"}

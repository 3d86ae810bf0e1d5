"""Steps that must not lie in one task, be done twice or be multiplied: rows of their own."""

import random
import re
import unicodedata
from difflib import SequenceMatcher
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from answerscope.functions import hashing, similarity
from answerscope.functions import text as T
from answerscope.operators import dictionaries, error_types, grading, metrics
from answerscope.plans import views
from answerscope.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def one_group(tmp_path_factory):
    """Tables of one row group each, which one task reads."""
    folder = tmp_path_factory.mktemp("tables")
    words = "the quick brown fox jumps over a lazy dog while twelve more words follow it until an answer ends".split()
    rng = random.Random(0)
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(60)]
    pq.write_table(pa.table({"doc_id": list(range(60)), "source": [f"src{i % 4}" for i in range(60)], "text": texts}), folder / "documents.parquet")
    events = {"event_id": list(range(400)), "event_type": [rng.choice(["purchase", "click", "error"]) for _ in range(400)],
              "value": [rng.random() * 20 for _ in range(400)]}
    pq.write_table(pa.table(events), folder / "events.parquet")
    return str(folder)


@pytest.mark.parametrize("view", [views.answers, views.attempts])
def test_rows_of_one_row_group_are_dealt_to_several_tasks(spark, one_group, view):
    assert view(spark, one_group).select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("name", ["C13_wrong_row_diff", "C14_type_mix", "G10_group_consistency"])
def test_texts_are_graded_once(spark, one_group, name):
    """Nothing of the grading is left in the plan of what reads the graded rows."""
    plan = QUERIES[name](spark, one_group)._jdf.queryExecution().optimizedPlan().toString()
    assert "_fold(" not in plan


@pytest.mark.parametrize("name", ["M02_within_fact_auroc", "M03_mean_within_fact_auroc", "M07_pair_restricted_auroc", "M08_bootstrap_interval"])
def test_ranked_rows_are_joined_once(spark, one_group, name):
    plan = QUERIES[name](spark, one_group)._jdf.queryExecution().optimizedPlan().toString()
    assert "event_id" not in plan and "parquet" not in plan


def test_ruled_rows_are_classified_as_others(spark, one_group):
    rows = views.answers(spark, one_group).withColumn("correct", F.lit(False))
    names = views.name_cache(spark, one_group)
    columns = ["row_id", "type3", "rule", "unverified", "lookup"]
    at_once = error_types.classify(rows, names, keep_lookup=True).select(*columns).orderBy("row_id").collect()
    assert error_types.classify(error_types.ruled(rows), names, keep_lookup=True).select(*columns).orderBy("row_id").collect() == at_once


def test_similarity_in_blocks_is_difflib(monkeypatch):
    rng = random.Random(1)

    def text():
        letters = rng.choice(["ab", "abcdefgh ", "aé漢😀 xyz\x00ÿþ"])
        return "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 30, 199, 200, 250, 1100])))

    pairs = [(text(), text()) for _ in range(300)]
    want = [100.0 * SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    for cells in (1 << 15, 1 << 10):
        monkeypatch.setattr(similarity, "CELLS", cells)
        assert similarity.similarity_ratio.func(*[pa.array(x) for x in zip(*pairs)]).to_pylist() == want
    short = [(a, b) for a, b in pairs if len(b) < similarity.AUTOJUNK and len(a) < 100]
    found = similarity.matched_characters(*zip(*short)).tolist()
    assert found == [sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks()) for a, b in short]


def test_draw_sums_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(hashing, "DRAW_GROUPS", 2)
    rows = [(g, i, None if (i + j) % 7 == 0 else float(i)) for j, g in enumerate(["a", "b", None, "c"]) for i in range(20)] + [("d", 1, None)]
    table = spark.createDataFrame(rows, "g string, i long, v double")
    got = hashing.draw_sums(table, 6, {"s": F.col("v"), "n": F.lit(1)}, "g", "i", by=["g"], seed=3).collect()
    want = {}
    for g, i, v in rows:
        for draw in range(6):
            key = ":".join(str(x) for x in (3, draw // 4, g, i) if x is not None)
            u = int(md5(key.encode()).hexdigest()[draw % 4 * 8:][:8], 16) / 2**32
            weight = sum(u >= cut for cut in hashing._POISSON_CDF)
            s, n = want.get((g, draw), (None, 0))
            want[g, draw] = (s if v is None else (s or 0) + weight * v, n + weight)
    assert {(r["g"], r["draw"]): (r["s"], r["n"]) for r in got} == want


def test_shuffled_labels_plan_the_rows_once(spark):
    data = pd.DataFrame({"row_id": range(300), "fact": [i % 40 for i in range(300)], "score": [i * 7 % 100 / 10 for i in range(300)],
                         "correct": [i * 11 % 3 == 0 for i in range(300)]})
    shuffled = metrics.shuffled_labels(spark.createDataFrame(data), "row_id", ["fact"], F.col("correct"), draws=5, limit=6)
    assert shuffled._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 2
    got = shuffled.toPandas()
    assert len(got) == 1500
    assert (got.groupby(["draw", "fact"]).shuffled.sum().unstack(0).T == data.groupby("fact").correct.sum()).all(axis=None)


def test_rows_meet_a_small_dictionary_in_one_python_pass(spark):
    """Packs of rows reach Python many at a time, so a worker's memory would grow with its partition."""
    features = [(i, [float(i == j) for j in range(3)], 0.0, 0.5, [float(i == j) for j in range(3)]) for i in range(3)]
    table = spark.createDataFrame(features, "latent int, w_enc array<double>, b_enc double, threshold double, w_dec array<double>")
    small = dictionaries.Dictionary(table, [0.0] * 3)
    rows = spark.createDataFrame(
        [(1, [2.0, 0.1, 1.0], None, {"a": 1}, ("x", None)), (2, None, "lost", None, None), (2, [0.0, 3.0, 0.0], "", {}, None), (2, [0.0] * 3, "b", None, ("y", 2))],
        "row_id long, h array<float>, name string, counts map<string,int>, pair struct<p:string,q:int>")
    acts, rebuilt = dictionaries.encode(rows, small), dictionaries.reconstruct(rows, small)
    for out in (acts, rebuilt):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan and "CoGroups" not in plan
    assert sorted(map(tuple, acts.collect())) == [(1, 0, 2.0), (1, 2, 1.0), (2, 1, 3.0)]
    got = {r.name: r for r in rebuilt.collect()}
    assert len(got) == 3 and got[None].counts == {"a": 1} and got[""].counts == {} and got["b"].counts is None
    assert tuple(got[None].pair) == ("x", None) and got[""].pair is None and tuple(got["b"].pair) == ("y", 2)
    assert {n: (r.r, r.active) for n, r in got.items()} == {None: ([2.0, 0.0, 1.0], 2), "": ([0.0, 3.0, 0.0], 1), "b": ([0.0] * 3, 0)}
    assert np.allclose(got[None].e, [0.0, 0.1, 0.0])


def test_activations_of_many_features_are_held_for_some_rows_at_a_time(monkeypatch):
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(50, 4)), rng.normal(size=(40, 4))
    given, held = (w, np.zeros(40).tobytes(), np.full(40, 0.5).tobytes(), np.zeros(4)), []
    whole, active = dictionaries._active(x, *given), dictionaries._active
    monkeypatch.setattr(dictionaries, "_active", lambda *a: held.append(active(*a)) or held[-1])
    got = np.zeros_like(whole)
    for batch in dictionaries._encoded(pa.array(range(50)), x, np.arange(40).tobytes(), given, 7 * 40 * 8):
        got[batch["row_id"], batch["latent"]] = batch["a"]
    r, on = dictionaries._decoded(x, given, w, 7 * 40 * 8)
    assert np.allclose(got, whole) and np.allclose(r, whole @ w) and (on == (whole > 0).sum(1)).all()
    assert len(held) == 16 and max(a.nbytes for a in held) <= 7 * 40 * 8


def _odd_texts(rng, n):
    letters = ["ab  .,", "AbiIvVxX  1\t\n", "aé漢😀 xyz\x00ÿþ\x1f", "İıſKΣς\u0301\u0308 ﬁA\u2003", "i v x iv viii xiii  "]
    words = "the a an of who wrote I don't know none Question: Answer: not known Paris.What Zorblatt Smith IV ii x 1 me $ equation Solve it You are here dıRect direct answer".split()
    out = [None, "", " ", "\x1f", "ab\x1fcd", "1", "Me", "None", "DIRECT answer", "dırect anſwer", "paris.What is", "e\u0301quation", "Solve\u0301 x", "a b a b a b"]
    out += ["".join(rng.choice(rng.choice(letters)) for _ in range(rng.choice([1, 5, 30, 300]))) for _ in range(n)]
    return out + [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8, 20]))) for _ in range(n)]


def _plainly(t):
    wide = unicodedata.normalize("NFKD", (t or "").lower())
    return re.sub("[^a-z0-9]+", " ", "".join(c for c in wide if not unicodedata.combining(c))).strip(" ")


def test_texts_normalised_together_are_those_normalised_alone(monkeypatch):
    texts = _odd_texts(random.Random(2), 400)
    want = [_plainly(t) for t in texts]
    for together in (1 << 18, 50):
        monkeypatch.setattr(T, "_TOGETHER", together)
        got = T.normalised(pa.array(["cut off", *texts], pa.string()).slice(1))
        got.validate(full=True)
        assert got.to_pylist() == want
    bits = T.numeral_bits(got).tolist()
    assert bits == [sum(1 << i for i, x in enumerate(T.ROMAN_NUMERALS) if x in t.split()) for t in want] and any(bits)
    assert T.normalised(pa.array([], pa.string())).to_pylist() == [] and T.numeral_bits(pa.array([], pa.string())).tolist() == []


def test_answers_are_prepared_and_ruled_as_by_columns(spark):
    rng = random.Random(4)
    texts = _odd_texts(rng, 150)
    rows = [(i, t, rng.choice(texts), rng.choice(texts), rng.choice([None, [], [rng.choice(texts), None, t]]), rng.choice([None, "father", "director"])) for i, t in enumerate(texts)]
    rows += [(len(rows) + i, *r) for i, r in enumerate([("Out Riley", "Who directed Outing Riley?", "x", [], "director"), (" 'Out\u2003Riley'", "Riley?", "x", None, "father")])]
    table = spark.createDataFrame(rows, "row_id long, model_answer string, question string, gold_value string, gold_aliases array<string>, relation string")
    inputs = error_types.rule_inputs(table)
    words = T.raw_word_count(F.col("__name")).between(1, 6)
    partly = F.arrays_overlap("__content", "__question") & (F.size(F.array_except("__content", "__question")) > 0)
    expected = (
        F.when(F.col("__norm") == "", "broken-empty").when(T.is_refusal(F.col("__head")), "abstain")
        .when(F.col("__raw").rlike(T.LEAK_PATTERN), "broken-leak").when(T.is_looping(F.col("__norm")), "broken-loop")
        .when(F.col("__cut").isNotNull(), "broken-continuation").when(T.is_invalid_shape(F.col("__norm")), "broken-invalid").when(error_types.is_copy(), "broken-copy")
        .when(~F.coalesce("relation", F.lit("")).isin(T.KIN_RELATIONS) & words & partly, "lookup").otherwise("entity"))
    any_cut = F.col("__raw").rlike(T.WEB_PATTERN) | F.col("__raw").rlike(T.MATH_PATTERN) | F.col("__raw").rlike(T.GLUED_PATTERN)
    got = inputs.select("row_id", "__raw", "__norm", "__head", "__cut", "__question", "__content", any_cut.alias("cuts"), expected.alias("want"), error_types.early_rule().alias("rule")).orderBy("row_id").collect()
    for r, (_, answer, question, *_) in zip(got, rows, strict=True):
        assert (r.rule, r["__cut"] is not None, r["__norm"]) == (r.want, r.cuts, _plainly(answer)), r
        assert r["__head"] == _plainly(r["__raw"][:r["__cut"]]) and r["__question"] == _plainly(question).split()
        assert r["__content"] == [w for w in r["__norm"].split() if w not in T.STOP_WORDS + T.TITLES]
    assert {r.rule for r in got} == {"lookup", *error_types.RULES} - {"broken-fabricated"}

    def numerals(t):
        return set(t.split()) & set(T.ROMAN_NUMERALS)

    junk = T.junk_kind(F.coalesce("model_answer", F.lit("")), T.normalise(F.col("model_answer")))
    ready = grading.prepared(table).withColumn("want", junk).orderBy("row_id").collect()
    for r, (_, answer, _, gold, aliases, _) in zip(ready, rows, strict=True):
        mine, golds = _plainly(answer), [_plainly(g) for g in [gold, *(aliases or [])]]
        assert (r.answer_norm, r.junk) == (mine, r.want)
        assert r.golds == [g for g in golds if g and numerals(g) == numerals(mine)]


def test_ratios_and_their_bounds_are_those_of_difflib():
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["henry", "iv", "of", "the", "rhine", "x"]) for _ in range(rng.choice([1, 3, 12, 60]))) for _ in range(120)]
    pairs = list(zip(texts, texts[1:])) + [(t, t + " iv") for t in texts] + [(t[:1] + t[2:], t) for t in texts] + [(t, t[3:-4]) for t in texts] + [("", ""), ("", "a"), ("é漢", "漢")]
    want = [100.0 * SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert similarity.ratios(pairs) == want
    bounds = similarity.shared_bounds(*zip(*pairs))
    assert [100.0 * SequenceMatcher(None, a, b).quick_ratio() for a, b in pairs] == bounds.tolist()
    in_order = [tuple(" ".join(sorted(t.split())) for t in p) for p in pairs]
    columns = [pa.array([*x, None, "a"]) for x in zip(*pairs)]
    columns[1] = pa.array([*columns[1].to_pylist()[:-1], None])
    assert similarity.sorted_ratio.func(*columns).to_pylist() == [*similarity.ratios(in_order), None, None]
    golds = [[b, a] if i % 3 else [b] for i, (a, b) in enumerate(pairs)] + [None, []]
    alone = [bool(g) and any(max(similarity.ratios([(a, x), (" ".join(sorted(a.split())), " ".join(sorted(x.split())))])) >= 90 for x in g) for (a, _), g in zip([*pairs, ("a", 0), ("a", 0)], golds)]
    assert grading.any_similar.func(pa.array([*(a for a, _ in pairs), "a", "a"]), pa.array(golds, pa.list_(pa.string()))).to_pylist() == alone


def test_whole_texts_are_cut_into_words_once(spark, one_group):
    """A filter on the words cut them again below the dealing out, in the one task that reads a row group."""
    for view in (views.passages, views.answers, views.name_cache):
        plan = view(spark, one_group)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1 and "slice(words" not in plan


@pytest.mark.parametrize("name", ["C11_cascade", "C12_type_counts", "G07_token_sort_ratio", "G06_similarity_ratio", "G09_correctness"])
def test_words_of_answers_are_looked_at_in_python(spark, one_group, name):
    """Word rules as lambdas were interpreted word by word, each with patterns and sorts of its own."""
    plan = QUERIES[name](spark, one_group)._jdf.queryExecution().optimizedPlan().toString()
    assert "_compared(" in plan and "array_sort" not in plan and "sort_array" not in plan and "[^a-z0-9]+" not in plan


def test_passages_of_a_long_text(spark, tmp_path):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (1, 11, 12, 13, 24, 5000)] + ["", " \t\n", None, "\u2003x"]
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "source": ["s"] * len(texts), "text": texts}), tmp_path / "documents.parquet")
    want = {(d * views.ROWS_PER_DOCUMENT + i, tuple(re.findall(r"[^ \t\n]+", t)[i * 12:i * 12 + 12]))
            for d, t in enumerate(texts) if t for i in range(-(-len(re.findall(r"[^ \t\n]+", t)) // 12))}
    got = views.passages(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.row_id, tuple(r.w)) for r in got} == want
    names = {r.name for r in views.name_cache(spark, str(tmp_path)).collect()}
    assert names and names <= {f"{w[0]} Zorblatt" for _, w in want}

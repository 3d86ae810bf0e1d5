"""Golden rows for grading and typing, and text rules against plain Python."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from answerscope.functions import text as T
from answerscope.functions.similarity import similarity_ratio
from answerscope.operators import error_types, grading

Q = "Who directed Outing Riley?"
TYPED = [
    # question, relation, answer, type, rule, unverified
    (Q, "director", "", "broken", "broken-empty", False),
    (Q, "director", "I don't know", "abstain", "abstain", False),
    (Q, "director", "None", "abstain", "abstain", False),
    (Q, "director", "Question: Who?", "broken", "broken-leak", False),
    (Q, "director", "the answer is the answer is the answer is", "broken", "broken-loop", False),
    (Q, "director", "Paris.What is the capital", "broken", "broken-continuation", False),
    (Q, "director", "1", "broken", "broken-invalid", False),
    (Q, "director", "X", "broken", "broken-invalid", False),
    (Q, "director", "Me", "broken", "broken-invalid", False),
    ("Who directed The City?", "director", "The City", "broken", "broken-copy", False),
    (Q, "director", "Out Riley", "broken", "broken-fabricated", False),
    (Q, "director", "New Riley", "entity", "entity", True),
    (Q, "director", "Old Riley", "entity", "entity", False),
    (Q, "father", "New Riley", "entity", "entity", False),
    ("Which band?", "genre", "The Who", "entity", "entity", False),
    (Q, "director", "Unknown. You are here", "abstain", "abstain", False),
    (Q, "director", "\"Kaufman\" Take the 2-minute tour", "broken", "broken-continuation", False),
]
GRADED = [
    ("Beyoncé", "Beyonce", [], True),
    ("Obama Barack", "Barack Obama", [], True),
    ("Barak Obama", "Barack Obama", [], True),
    ("Henry IV", "Henry V", [], False),
    ("Louis XIV", "Louis XV", [], True),
    ("", "x", [], False),
    ("Question: Paris", "Question: Paris", [], False),
    ("Lutetia", "Paris", ["Lutetia"], True),
    ("Lutetia", "Paris", ["", "Londinium"], False),
    ("ﬁve", "five", [], True),
    ("!!!", "...", [], False),
]


def test_typing(spark):
    rows = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(TYPED)], "row_id long, question string, relation string, model_answer string")
    names = spark.createDataFrame([("Out Riley", []), ("Old Riley", ["Q1"])], "name string, qids array<string>")
    out = error_types.classify(rows, names, correct=None).orderBy("row_id").collect()
    assert [(r.type3, r.rule, r.unverified) for r in out] == [t[3:] for t in TYPED]


def test_grading(spark):
    rows = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(GRADED)], "row_id long, model_answer string, gold_value string, gold_aliases array<string>")
    out = grading.grade(rows).orderBy("row_id").collect()
    assert [r.correct for r in out] == [g[3] for g in GRADED]


def brute_loop(n: str) -> bool:
    w = n.split()
    if len(w) < 4:
        return False
    long_words = [x for x in w if len(x) > 2 and x not in T.STOP_WORDS]
    return max(Counter(zip(w, w[1:])).values()) > 2 or max(Counter(long_words).values(), default=0) > 3


def test_loop_against_python(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "ab", "abc", "de", "word", "x"]) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "n string").select("n", T.is_looping(F.col("n")).alias("hit")).collect()
    assert [r.hit for r in rows] == [brute_loop(r.n) for r in rows]
    assert any(r.hit for r in rows) and not all(r.hit for r in rows)


@pytest.mark.parametrize("text,line", [(" \n\t Paris  \nnext", "Paris"), ("", ""), (None, ""), ("a\r\nb", "a"), ("\x1c x", "x"), ("  ", "")])
def test_first_line(spark, text, line):
    assert spark.createDataFrame([(text,)], "t string").select(T.first_line(F.col("t"))).first()[0] == line


@pytest.mark.parametrize("text,cut", [
    ("Paris", None), ("Paris.What is", 6), ("Paris. What is", None), ("ab You are here", 3), ("x $ y", 2), ("Rome.Theo", None), ("1).How", 3), ("\U0001f600 ok.Who is", 5)])
def test_continuation(spark, text, cut):
    assert spark.createDataFrame([(text,)], "t string").select(T.continuation_start(F.col("t"))).first()[0] == cut


def test_similarity_is_difflib(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("abc ") for _ in range(rng.randint(0, 260))), "".join(rng.choice("abc ") for _ in range(rng.randint(0, 260)))) for _ in range(60)]
    out = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(r.r == pytest.approx(100 * SequenceMatcher(None, r.a, r.b).ratio()) for r in out)


def test_grading_against_python(spark, folder):
    """The pruned, row-local decision equals checking every gold in plain Python."""
    from answerscope.plans import views as V

    prepared = grading.prepared(V.answers(spark, folder)).select("row_id", "answer_norm", "junk", "golds").collect()
    got = {r.row_id: r.correct for r in grading.grade(V.answers(spark, folder)).select("row_id", "correct").collect()}

    def close(a, b):
        return 100 * SequenceMatcher(None, a, b).ratio() >= 90

    for r in prepared:
        c = r.answer_norm
        expected = r.junk is None and c != "" and any(
            c == g or close(c, g) or close(" ".join(sorted(c.split())), " ".join(sorted(g.split()))) for g in r.golds)
        assert got[r.row_id] == expected, r
    assert 0 < sum(got.values()) < len(got)

import random
import re

import pytest

from answerscope.llm import minhash_join as M
from answerscope.llm.common import Scratch

SCHEMA = "doc_id bigint, text string, lang string, source string, node bigint"
BLANKS = " \t\n\x0b\x0c\r"


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(f"[{BLANKS}]+", low) if w]
    n = max(1, len(words) - 4) if words else 0
    return frozenset(tuple(words[k:k + 5]) for k in range(n))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]) or rows[i][0] is not None and rows[i][0] == rows[j][0]:
                root[find(i)] = find(j)
    out = []
    for k, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        comp = min(ids) if ids else None
        out.append((doc, len(sets[k]), comp, doc is not None and doc == comp))
    return out


def corpus():
    rnd = random.Random(4)
    word = lambda: rnd.choice("ABcdé") + "".join(rnd.choice("abcdefgh") for _ in range(3))
    prose = lambda n: [word() for _ in range(n)]
    texts = [prose(rnd.randint(1, 80)) for _ in range(40)]
    common = prose(60)
    texts += [common + prose(10) for _ in range(25)]  # much in common, mostly not enough
    base = prose(150)
    for k in range(60):  # one group in which copies drift away from one another
        copy = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 4])):
            copy[rnd.randrange(len(copy))] = word()
        texts.append(copy)
        if k % 10 == 0:
            base = copy
    texts += [prose(3)] * 3 + [prose(4), [], [], texts[5], [w.upper() for w in texts[6]], texts[7] + ["x"]]
    rows = [(k, "\n ".join(t)) for k, t in enumerate(texts)]
    rows += [(900, None), (901, " \t"), (None, rows[3][1]), (None, "alone here"), (None, "alone here"), (902, " ".join(prose(20_000)))]
    rnd.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, None, "s", 1) for k, t in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, M.near_duplicates(docs, Scratch(spark, "test")).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    kept = M.one_of_each_group(docs)
    assert kept.columns == docs.columns
    stays = sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect())
    assert stays == sorted(d for d, _, _, k in brute(rows) if k)


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 1)] * 3 + [(2, "a b c d e f", "en", "s", 1), (3, None, "en", "s", 1)], SCHEMA)
    assert sorted(r.doc_id for r in M.one_of_each_group(docs).collect()) == [1, 3]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (20, 21), (21, 20), (30, 30)] + [(100 + k, 101 + k) for k in range(30)]
    got = {r.node: r.comp for r in M.components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "test")).collect()}
    assert got == {2: 1, 3: 1, 9: 1, 21: 20} | {101 + k: 100 for k in range(30)}


@pytest.mark.parametrize("texts", [[], [None, ""]])
def test_no_sets(spark, texts):
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], SCHEMA)
    assert sorted(map(tuple, M.near_duplicates(docs, Scratch(spark, "test")).collect())) == [(k, 0, k, True) for k in range(len(texts))]


def test_rows_stay_by_text_when_ids_are_missing_or_repeated(spark):
    long = "one two three four five six seven eight nine ten " * 3
    rows = [(None, "a b c d e f"), (None, "A b  c d e f"), (7, "a b c d e f"), (None, "only here g h i"), (None, "only here g h i"), (None, "Only here g h i"), (5, "k l m n o p"), (5, "q r s t u v"), (5, "q r s t u v"),
            (6, "Q r s t u v"), (None, long + "x"), (None, long + "x"), (8, None), (8, None), (8, " "), (None, ""), (None, "")]
    docs = spark.createDataFrame([(k, t, None, "s", n) for n, (k, t) in enumerate(rows)], SCHEMA).repartition(3)
    kept = M.one_of_each_group(docs)
    got = sorted(((r.doc_id, r.text.lower() if r.text else r.text) for r in kept.collect()), key=str)
    assert got == sorted([(7, "a b c d e f"), (None, "only here g h i"), (5, "k l m n o p"), (5, "q r s t u v"), (None, long + "x"), (8, None), (8, " "), (None, ""), (None, "")], key=str)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, M.one_of_each_group(docs.repartition(5)).collect()), key=str)

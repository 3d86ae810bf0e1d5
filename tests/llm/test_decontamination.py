import random

import numpy as np
import pytest

from answerscope.llm import decontamination as D

SCHEMA = "doc_id bigint, text string, lang string, source string, item_id bigint"


def naive_tiles(item, doc, least):
    """Greedy string tiling as it is defined: the longest common unmarked run first."""
    fi, fd, total = [True] * len(item), [True] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(doc)):
                n = 0
                while p + n < len(item) and t + n < len(doc) and fi[p + n] and fd[t + n] and item[p + n] == doc[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < least:
            return total
        for j in range(n):
            fi[p + j] = fd[t + j] = False
        total += n


def test_tiles_cover_what_the_definition_covers():
    rnd = random.Random(3)
    for _ in range(60):
        item = np.array([rnd.randrange(50) for _ in range(rnd.randint(5, 40))], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        parts = [item[a:a + rnd.randint(3, 20)] for a in (rnd.randrange(len(item)) for _ in range(4))]
        noise = lambda: np.array([1000 + rnd.randrange(9) for _ in range(rnd.randint(0, 4))], dtype=np.uint64)
        doc = np.concatenate([x for p in parts for x in (p, noise())])
        tiles = D.tile(item, doc, np.arange(len(doc)))
        assert sum(n for _, _, n in tiles) == naive_tiles(item.tolist(), doc.tolist(), D.MIN_MATCH)
        marks = np.zeros(len(item))
        for p, t, n in tiles:
            assert np.array_equal(item[p:p + n], doc[t:t + n])
            marks[p:p + n] += 1
        assert marks.max(initial=0) <= 1


def texts():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(30) for _ in range(20)] + ["one two three", "", None, prose(30)]
    a = items[0].split()
    docs = [prose(200) + " " + items[3].upper() + "! " + prose(100), " ".join(a[20:] + ["x"] + a[10:20] + ["y"] + a[:10]), " ".join(a[:16]), " ".join(a[:14]),
            "one two three", "", None, prose(30_000) + items[5], (items[7] + " ") * 300, prose(50)]
    return docs, items


@pytest.mark.parametrize("block_words", [1 << 20, 40])
def test_documents(spark, block_words):
    docs, items = texts()
    d = spark.createDataFrame([(k if k != 8 else None, t, "en", "s", 5) for k, t in enumerate(docs)], SCHEMA).repartition(3)
    b = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in D.contaminated(d, b, block_words=block_words).collect()}
    assert set(got) == {(0, 3), (1, 0), (2, 0), (4, 20), (7, 5), (None, 7)}  # an item of three words matches whole
    assert (got[1, 0].coverage, got[1, 0].tiles) == (1.0, 3) and got[2, 0].matched_words == 16
    kept = D.without_contaminated(d, b, block_words=block_words)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 9]


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id bigint, text string")
    assert D.contaminated(d, b).count() == 0 and D.without_contaminated(d, b).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f g")], "item_id bigint, text string")
    assert D.contaminated(d, some).count() == 0


def test_scripts_without_blanks_and_unicode_punctuation(spark):
    items = ["天空为什么是蓝色的因为光的散射", "ทำไมท้องฟ้าถึงเป็นสีฟ้า", "なぜ空は青いのですか。", "the quick brown fox jumps over it"]
    docs = ["前言。" + items[0] + "！后记", "ก่อน " + items[1], "abc" + items[2][:-1] + "xyz", "he said “the quick—brown…fox «jumps» over it”", "天空很高云很白", items[0][:6], None]
    d = spark.createDataFrame([(k, t, None, "s", 5) for k, t in enumerate(docs)], SCHEMA)
    b = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in D.contaminated(d, b).collect()}
    assert got == {(k, k): 1.0 for k in range(4)}
    assert sorted(r.doc_id for r in D.without_contaminated(d, b).collect()) == [4, 5, 6]


def test_spaced():
    words = lambda t: D.spaced(t.encode()).decode().split()
    assert words("日本go語が") == ["日", "本", "go", "語", "が"] and words("น้ำ") == ["น้", "ำ"] and words("naïve‑été\u00a0x") == ["naïve", "été", "x"]
    assert D.spaced(b"\xff ok") == b"\xff ok" and words("Ελλάδα привет") == ["Ελλάδα", "привет"]


def test_short_items_match_whole(spark):
    items = ["alpha beta gamma delta", "omega", "1 2 3 4 5"]
    docs = ["say alpha beta, gamma DELTA now", "alpha beta gamma", "gamma delta alpha beta", "the omega", "omegas", "1 2 3 4"]
    d = spark.createDataFrame([(k, t, None, "s", 5) for k, t in enumerate(docs)], SCHEMA)
    b = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    assert {(r.doc_id, r.item_id, r.coverage) for r in D.contaminated(d, b).collect()} == {(0, 0, 1.0), (3, 1, 1.0)}


def test_repetitive_texts_take_no_pairs():
    one = np.full(20_000, 7, dtype=np.uint64)
    tiles = D.tile(one[:400], one, np.arange(len(one)))
    assert tiles == [(0, 0, 400)]
    two = np.tile(np.array([3, 9], dtype=np.uint64), 10_000)
    item = np.concatenate([two[:300], one[:200], two[1:300]])
    assert sum(n for _, _, n in D.tile(item, np.concatenate([two, one]), np.arange(40_000))) == len(item)
    rnd = random.Random(4)
    for _ in range(60):
        item, doc = (np.array([rnd.randrange(2) for _ in range(rnd.randint(1, 40))], dtype=np.uint64) for _ in range(2))
        assert sum(n for _, _, n in D.tile(item, doc, np.arange(len(doc)), 2)) == naive_tiles(item.tolist(), doc.tolist(), 2)

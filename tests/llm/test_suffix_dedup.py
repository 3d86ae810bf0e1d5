import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from answerscope.llm import suffix_dedup as S

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, s_key string"


def brute(texts):
    seen = Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - 199):
            if seen[t[i:i + 200]] > 1:
                gone[i:i + 200] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone]) if len(t) else b""
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdéß日 ") for _ in range(rnd.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(120), prose(60)
    texts = [prose(rnd.randint(1, 300)) for _ in range(40)]
    texts += [prose(40) + passage + prose(40) for _ in range(30)]
    texts += [prose(5) + line * 3, line, "ab" * 700, "ab" * 150 + "c", "x" * 199, "x" * 200, "", None, None]
    base = prose(300)
    for _ in range(10):
        at = rnd.randrange(len(base))
        texts.append(base[:at] + "#" + base[at + 1:])
    texts += [texts[3]] * 3
    texts.append(prose(20_000))
    return texts


@pytest.mark.parametrize("crowded", [2000, 2])
def test_against_brute_force(spark, tmp_path, crowded, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 20_000)
    texts = corpus()
    monkeypatch.setattr(S, "CROWDED", crowded)
    rows = [(k if k % 9 else None, t, None, "s", 0, "clash") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    spans = S.repeated_spans(docs, S.Scratch(spark, "test"), crowded)
    got = S.with_places(docs, spans).mapInArrow(S._digest_rows, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string").collect()
    want = [(r[0], *b) for r, b in zip(rows, brute([(t or "").encode() for t in texts]))]
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    assert order(got) == order(want)


def test_levels_are_common_prefixes():
    rnd = random.Random(1)
    for _ in range(30):
        text = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 30))) for _ in range(4)]
        flags = S.repeated_starts(text, 5)
        seen = Counter(t[i:i + 5] for t in text for i in range(len(t) - 4))
        assert [f.tolist() for f in flags] == [[seen[t[i:i + 5]] > 1 for i in range(len(t) - 4)] for t in text]


def test_remove_repeats_keeps_rows_and_columns(spark):
    texts = ["é" * 150 + "a", "é" * 150 + "b", None, "", "short"]
    docs = spark.createDataFrame([(k, t, "fr", None, 7, "x") for k, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in S.remove_repeats(docs).collect()}
    assert S.remove_repeats(docs).columns == docs.columns
    assert [got[k].text for k in range(5)] == ["a", "b", None, "", "short"]
    assert got[2].n_chars == 7 and got[0].n_chars == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert S.remove_repeats(docs).count() == 0


def removed(spark, texts):
    docs = spark.createDataFrame([(k, t, None, "s", 0, "x") for k, t in enumerate(texts)], SCHEMA)
    spans = S.repeated_spans(docs, S.Scratch(spark, "test"))
    got = S.with_places(docs, spans).mapInArrow(S._digest_rows, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return [tuple(r)[1:] for r in got.orderBy("doc_id").collect()]


def test_strings_that_repeat_inside_one_run_only(spark):
    rnd = random.Random(9)
    letters = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    texts = ["ab" * 150, "=" * 300, letters(60) * 5, letters(90) + "word " * 60 + letters(90), letters(136) * 2 + letters(40), "-" * 201, "+" * 200, letters(400)]
    for period in (1, 2, 63, 64, 65, 100, 135, 136, 137, 138, 200):
        unit = letters(period)
        texts += [letters(50) + (unit * 500)[:199 + period + extra] + letters(50) for extra in (0, 1, 2, 60)]
    want = brute([t.encode() for t in texts])
    assert all(w[1] for w in want[:4])
    assert removed(spark, texts) == want
    for text, found in zip(texts[:5], want[:5]):
        assert removed(spark, [text]) == brute([text.encode()])

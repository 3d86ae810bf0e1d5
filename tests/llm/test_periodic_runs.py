import hashlib
import random
import zlib

import numpy as np

from answerscope.llm import periodic_runs as P

SCHEMA = "doc_id bigint, text string, n_runs string"


def brute(words):
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                best.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, m, q) for (s, m), q in best.items()), key=lambda r: (r[0], r[2]))


def word_lists():
    rnd = random.Random(2)
    out = [[], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 300, list("ab") * 40, list("aab") * 9 + list("aab") * 3]
    for size in (2, 3, 6):
        for _ in range(60):
            out.append([str(rnd.randrange(size)) for _ in range(rnd.randint(1, 150))])
    for _ in range(80):
        words = []
        while len(words) < 200:
            base = [str(rnd.randrange(4)) for _ in range(rnd.randint(1, 30))]
            words += base * rnd.randint(1, 6) + base[:rnd.randrange(len(base) + 1)]
        out.append(words)
    fib = ["a"], ["a", "b"]
    while len(fib[1]) < 400:
        fib = fib[1], fib[1] + fib[0]
    return out + [fib[1]]


def test_runs_against_brute_force():
    lists = word_lists()
    got = P.find_runs([P.numbered([w.encode() for w in words]) for words in lists])
    for words, runs in zip(lists, got, strict=True):
        assert runs == brute(words)


def test_wavelet_tree():
    rnd = np.random.default_rng(1)
    values = rnd.integers(0, 100, 300)
    tree = P.WaveletTree(values)
    low = rnd.integers(0, 300, 200)
    high = low + rnd.integers(1, 301 - low)
    bound = rnd.integers(0, 200, 200)
    for a, b, c, got in zip(low, high, bound, tree.below(low, high, bound), strict=True):
        assert got == (values[a:b] < c).sum()
    nth = rnd.integers(0, high - low)
    for a, b, k, got in zip(low, high, nth, tree.nth(low, high, nth), strict=True):
        assert got == np.sort(values[a:b])[k]


def test_query_rows(spark, tmp_path):
    lists = word_lists()[:120]
    rows = [(k if k != 5 else None, " \n".join(w), "clash") for k, w in enumerate(lists)] + [(900, None, None), (901, "", ""), (7, " x" * 30_000, None), (7, " x" * 30_000, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, P.op12_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for doc_id, text, _ in rows[:-2]:
        words = (text or "").split()
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        s, m, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((doc_id, len(runs), s, m, q, m and 1000 * m // q, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone))))
    want += [(7, 1, 0, 30_000, 1, 30_000_000, hashlib.sha256(b"0,30000,1\n").hexdigest(), hashlib.sha256(b"x").hexdigest())] * 2
    assert got == sorted(want, key=repr)
    assert P.runs_of(spark.createDataFrame([], SCHEMA)).count() == 0

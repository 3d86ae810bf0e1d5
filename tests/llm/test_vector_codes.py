import hashlib

import numpy as np
import pytest

from answerscope.llm import vector_codes as V

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string"


def brute(rows):
    kept = []
    for vec_id, v, label, *_ in rows:
        if v is not None and all(c is not None and np.isfinite(c) for c in v):
            kept.append((vec_id, [int(np.floor(1024.0 * float(np.float32(c)))) for c in v], label))
    size = max(len(v) for _, v, _ in kept)
    width = max(1, -(-size // 4))
    x = np.array([v + [0] * (4 * width - len(v)) for _, v, _ in kept], dtype=np.int64).reshape(len(kept), 4, width)
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:256]
    books = x[order].transpose(1, 0, 2).copy()
    for step in range(5):
        d = np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(axis=2) for p in range(4)], axis=1)
        a = d.argmin(axis=2)
        if step < 4:
            for p in range(4):
                for e in range(len(order)):
                    mine = x[a[:, p] == e, p]
                    if len(mine):
                        books[p, e] = mine.sum(axis=0) // len(mine)
    error = d.min(axis=2).sum(axis=1)
    labels = [r[2] for r in kept]
    total = {k: int(sum(e for e, m in zip(error, labels, strict=True) if m == k)) for k in set(labels)}
    sha = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    return [(k[0], "".join(f"{c:02x}" for c in a[i]), int(error[i]), total[k[2]], sha) for i, k in enumerate(kept)]


@pytest.mark.parametrize("first_b", [16, 2])
def test_against_brute_force(spark, first_b):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(0, 0.3, (20, 16))
    rows = [(k, (centres[k % 20] + rnd.normal(0, 0.02 * (k % 7), 16)).astype(np.float32).tolist(), k % 4 if k % 9 else None, "clash") for k in range(900)]
    rows += [(None, rows[3][1], 1, None), (5, rows[8][1], 2, None), (5, rows[5][1], rows[5][2], None), (901, None, 1, None), (902, [1.0, None], 1, None),
             (903, [float("nan")] * 16, 1, None), (904, [float("inf")] + [0.0] * 15, 1, None), (905, [0.5] * 13, 2, None), (906, [], 2, None)]
    got = V.compressed(spark.createDataFrame(rows, SCHEMA).repartition(5), first_b).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows), key=repr)


def test_given_table(spark, folder):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = V.op13_vector_codes(spark, folder).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows), key=repr)


def test_small_and_empty(spark):
    few = [(2, [1.0, 2.0, 3.0, 4.0], 0, None), (1, [0.0] * 4, None, None)]
    assert sorted(map(tuple, V.compressed(spark.createDataFrame(few, SCHEMA)).collect())) == sorted(brute(few))
    assert V.compressed(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        V.compressed(spark.createDataFrame([(1, [1e9], 0, None)], SCHEMA))

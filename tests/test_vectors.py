import numpy as np
import pytest
from pyspark.sql import functions as F

from answerscope.functions import vectors as V

ROWS = [(None, [1.0, 0.0], 2.0), ([3.0, 4.0], [1.0, 0.0], 2.0), ([3.0, 4.0], None, 2.0), (None, None, None), ([0.0, 0.0], [0.0, 1.0], 1.0), ([1.0, 2.0], [2.0, 1.0], None), (None, [5.0, 5.0], 1.0)]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(ROWS)], "k int, a array<double>, b array<double>, s double").coalesce(1)


def wanted(fn, *names):
    out = []
    for a, b, s in ROWS:
        given = [{"a": a, "b": b, "s": s}[n] for n in names]
        out.append(None if any(x is None for x in given) else fn(*map(np.asarray, given)))
    return out


def unit(a):
    return a / (np.linalg.norm(a) or 1.0)


@pytest.mark.parametrize("udf, fn, names", [
    (V.dot, lambda a, b: a @ b, "ab"), (V.norm, np.linalg.norm, "a"), (V.distance, lambda a, b: np.linalg.norm(a - b), "ab"),
    (V.cosine, lambda a, b: unit(a) @ unit(b) if a.any() and b.any() else None, "ab"), (V.subtract, lambda a, b: a - b, "ab"),
    (V.add_scaled, lambda a, b, s: a + s * b, "abs"), (V.scale_by, lambda a, s: a * s, "as"), (V.unit, unit, "a")])
def test_null_in_gives_null_out(pairs, udf, fn, names):
    got = [r[0] for r in pairs.orderBy("k").select(udf(*[F.col(n) for n in names])).collect()]
    for g, w in zip(got, wanted(fn, *names), strict=True):
        assert (g is None) == (w is None) and (w is None or np.allclose(g, w))


def test_vectors_of_several_widths_fail(spark):
    with pytest.raises(Exception, match="one width"):
        spark.createDataFrame([([1.0],), ([1.0, 2.0, 3.0],)], "a array<double>").coalesce(1).select(V.norm(F.col("a"))).collect()

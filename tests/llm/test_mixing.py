import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from answerscope.llm import mixing as M

SCHEMA = "doc_id bigint, text string, source string, lang string, m_size bigint"


def targets(sizes, weights=(5, 2, 1), most=3):
    """Reshare by weight until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = sum(w[s] for s in order if s not in full)
        now = {s: left * w[s] / rest for s in order if s not in full}
        over = {s for s, t in now.items() if t > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in full else now[s] for s in order}
        full |= over


@pytest.fixture
def rows():
    rnd = random.Random(2)
    out = []
    for k in range(1500):
        source = rnd.choice(["hot"] * 9 + ["a", "b", "é", None, "tiny"]) if k % 97 else "rare"
        n = rnd.choice([0, 1, 40, 40, 41, 500]) if source != "tiny" else 1
        out.append((k if k % 50 else None, None if k % 31 == 0 else " w\t" * n, source, "en", 7))
    return out + [(5, "x y", "hot", "en", 7)] * 3


def test_against_targets(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = M.op1_mix_sources(spark, str(tmp_path)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, M.op1_mix_sources(spark, str(tmp_path)).collect()))
    sizes, taken, seen = defaultdict(int), defaultdict(int), {}
    source_of = {r[0]: r[2] for r in rows if r[0] is not None}
    for _, t, s, _, _ in rows:
        sizes[s] += len((t or "").split())
    want = targets(dict(sizes))
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        if r.doc_id is not None:
            s = source_of[r.doc_id]
            seen[s] = r
            assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-12, abs_tol=1e-9)
    mix = M.mixed_rows(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    for r in mix:
        taken[r.source] += len((r.text or "").split())
    assert sum(r.taken for r in got) == sum(taken.values()) and len(got) == len(rows)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 3 * 500, (s, taken[s], t)


def test_all_sources_full_or_empty(spark):
    frame = lambda x: spark.createDataFrame(x, "m_source string, m_size bigint")
    for sizes in ({"a": 10}, {"a": 0, None: 0}, {"a": 1, "b": 1000}, {"a": 5, "b": 5, "c": 5}):
        got = {r.m_source: r.m_target for r in M.source_targets(frame(list(sizes.items()))).collect()}
        assert got == pytest.approx(targets(sizes))


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert M.mixed_rows(docs).count() == 0 and M.mixed_rows(docs).columns == [*docs.columns, "mix_copy"]


def test_no_python_in_the_plan(spark, rows):
    plan = M.mixed_rows(spark.createDataFrame(rows, SCHEMA).where(F.col("doc_id") > 0))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

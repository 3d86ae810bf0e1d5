"""Models fitted together against the optimality conditions and single fits."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from answerscope.operators import grouped as G
from answerscope.operators import metrics
from answerscope.operators import probes as P


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    n, d = 600, 5
    y = rng.random(n) < 0.4
    x = 50.0 + rng.normal(size=(n, d)) * [1, 2, 0.1, 5, 1] + y[:, None] * np.array([0.7, 0, -0.1, 0, 0.3])
    x[:, 4] = np.where(rng.random(n) < 0.5, 3.0, x[:, 4])
    return pd.DataFrame({"row_id": np.arange(n), "fact": np.arange(n) // 6, "fold": (np.arange(n) // 12) % 3, "part": np.where(np.arange(n) // 12 % 2, "dev", "test"),
                         "layer": np.arange(n) % 2, "correct": y, "h": [v.tolist() for v in x]})


@pytest.fixture(scope="module")
def table(spark, data):
    return spark.createDataFrame(data).repartition(4)


def gradient(train, fitted, c, balanced=False):
    x, y = np.stack(train.h), train.correct.to_numpy(float)
    z = (x - x.mean(0)) / x.std(0)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if balanced else 1.0
    w = fitted.weights
    r = weight * (1 / (1 + np.exp(-(z @ w[:-1] + w[-1]))) - y)
    return np.abs(np.r_[w[:-1] + c * z.T @ r, c * r.sum()]).max()


@pytest.mark.parametrize("balanced", [False, True])
def test_all_models_of_a_grid_are_at_their_optimum(table, data, balanced):
    rows = G.rows_of(table, F.col("correct"), slice_by=F.col("layer"), part=F.col("fold"), keep=["row_id"])
    models = [G.Model(f"{layer}/{g}/{c}", c, str(layer), str(g)) for layer in (0, 1) for g in range(3) for c in (0.01, 1.0, 100.0)]
    fitted = G.fit_models(rows, models, balanced=balanced)
    assert [f.model for f in fitted] == models
    for f in fitted:
        train = data[(data.layer == int(f.model.slice)) & (data.fold != int(f.model.held))]
        assert gradient(train, f, f.model.c, balanced) < 1e-7
    scored = G.score_models(rows, fitted).toPandas()
    assert len(scored) == 3 * len(data)
    by_name = {f.model.name: f for f in fitted}
    x = np.stack(data.h)
    for name, part in scored.groupby("model"):
        f = by_name[name]
        assert set(part.row_id) == set(data[(data.layer == int(f.model.slice)) & (data.fold == int(f.model.held))].row_id)
        z = (x[part.row_id] - f.mean) / f.scale
        assert np.allclose(part.score, z @ f.weights[:-1] + f.weights[-1])


def test_blocks_flushes_and_waves_change_nothing(table, monkeypatch):
    rows = G.rows_of(table, F.col("correct"), part=F.col("fold"), keep=["row_id"])
    models = [G.Model(str(g), 0.1, held=str(g)) for g in range(3)]
    plain = G.fit_models(rows, models)
    for name, value in {"SHARED_BYTES": 200, "CHUNK_BYTES": 400, "SUMS_BYTES": 300, "BLOCK_VALUES": 12}.items():
        monkeypatch.setattr(G, name, value)
    for a, b in zip(plain, G.fit_models(rows, models)):
        assert a.model == b.model and np.allclose(a.weights, b.weights, atol=1e-9)


def test_sweeps_agree_with_single_fits(table):
    rows = G.rows_of(table, F.col("correct"), part=F.col("fold"), keep=["row_id", "fact", "correct"])
    got = {r["name"]: r["score"] for r in G.sweep(rows, {"a": 0.003, "b": 0.3}, 3).collect()}
    ready = P.with_vector(table.withColumn("inner_fold", F.col("fold")), "h")
    single = dict(P.sweep(ready, {"a": lambda t, e: P.fit_logistic(t, F.col("correct"), 0.003).score(e),
                                  "b": lambda t, e: P.fit_logistic(t, F.col("correct"), 0.3).score(e)}, 3))
    assert got == pytest.approx(single, abs=1e-3)
    sliced = G.rows_of(table, F.col("correct"), slice_by=F.col("layer"), part=F.col("part"), keep=["correct"])
    aucs = {r.slice: r.auc for r in G.slice_sweep(sliced, ["0", "1"], 0.01).collect()}
    for layer in (0, 1):
        one = ready.where(F.col("layer") == layer)
        probe = P.fit_logistic(one.where("part = 'dev'"), F.col("correct"), 0.01)
        assert aucs[str(layer)] == pytest.approx(metrics.auroc(probe.score(one.where("part = 'test'")), "score", F.col("correct")).first()["auc"], abs=1e-3)


def test_the_number_of_jobs_does_not_grow_with_the_grid(spark, table):
    rows = G.rows_of(table, F.col("correct"), part=F.col("fold"))
    calls = []
    whole = G._solve
    try:
        G._solve = lambda *a: calls.append(1) or whole(*a)
        G.fit_models(rows, [G.Model("a", 0.1, held="0")])
        few = len(calls)
        calls.clear()
        G.fit_models(rows, [G.Model(f"{i}", 0.1 / (1 + i), held=str(i % 3)) for i in range(60)])
        assert len(calls) <= few + 2
    finally:
        G._solve = whole


def test_rows_that_cannot_be_used(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", "x", True, [0.0, 1.0]), ("a", "x", False, [1.0, 1.0]), ("a", "x", True, [2.0, 1.0]), ("a", "x", None, [9.0, 1.0]), ("a", None, True, [7.0, 1.0]),
            ("a", "x", True, None), ("a", "x", True, [nan, 1.0]), ("a", "x", False, [inf, 1.0]), ("a", "x", True, [None, 1.0]), ("b", "x", True, [1.0]), ("b", "x", True, [2.0])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, s string, part string, y boolean, h array<double>")
    ready = G.rows_of(df, F.col("y"), slice_by=F.col("s"), part=F.col("part"), keep=["id"])
    fitted = G.fit_models(ready, [G.Model("a", 1.0, "a"), G.Model("b", 1.0, "b"), G.Model("none", 1.0, "c")])
    assert [f.model.name for f in fitted] == ["a"] and fitted[0].weights[1] == pytest.approx(0)  # a constant component has no weight
    assert sorted(r.id for r in G.score_models(ready, fitted).collect()) == [0, 1, 2, 3]
    assert G.fit_models(ready.limit(0), [G.Model("a", 1.0)]) == []
    mixed = G.rows_of(df.where("h is not null and part is not null"), F.col("y"), keep=["id"])
    with pytest.raises(Exception, match="(?i)widths|dimension|size|length"):
        G.fit_models(mixed, [G.Model("a", 1.0)])

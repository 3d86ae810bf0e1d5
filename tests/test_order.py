"""Order statistics with groups forced to be hot, against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from answerscope.operators import metrics, order, outcomes

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.9, 0.975, 1.0]
HOT = {"limit": 20, "parts": 8}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    n = 3000
    group = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 60, n))
    score = np.where(rng.random(n) < 0.33, 1.5, np.round(rng.normal(size=n), 2))
    return pd.DataFrame({"row_id": np.arange(n), "g": group, "score": score, "y": rng.random(n) < 0.4, "k": rng.integers(0, 6, n)})


@pytest.fixture(scope="module")
def table(spark, data):
    return spark.createDataFrame(data)


@pytest.mark.parametrize("how", [{}, HOT])
def test_quantiles(table, data, how):
    got = order.quantiles(table, "score", PROBABILITIES, ["g"], **how).toPandas()
    for g, rows in data.groupby("g"):
        assert np.allclose(got[got.g == g].sort_values("p").q, np.quantile(rows.score, PROBABILITIES))
    pooled = order.quantiles(table, "score", PROBABILITIES, **how).toPandas().sort_values("p")
    assert np.allclose(pooled.q, np.quantile(data.score, PROBABILITIES))


@pytest.mark.parametrize("how", [{}, HOT])
def test_average_ranks(table, data, how):
    got = order.average_ranks(table, "score", ["g"], **how).toPandas()
    both = data.assign(r=data.groupby("g").score.rank()).merge(got, on=["g", "score"])
    assert len(both) == len(data) and np.allclose(both.r, both.avg_rank)


@pytest.mark.parametrize("how", [{}, HOT])
def test_auroc(table, data, how):
    got = metrics.auroc(table, "score", F.col("y"), ["g"], **how).toPandas().set_index("g")
    for g, rows in data.groupby("g"):
        p, n = rows.score[rows.y].to_numpy(), rows.score[~rows.y].to_numpy()
        if len(p) and len(n):
            assert got.auc[g] == pytest.approx((p[:, None] > n).mean() + 0.5 * (p[:, None] == n).mean())
        else:
            assert g not in got.index


@pytest.mark.parametrize("how", [{}, HOT])
def test_spearman(table, data, how):
    got = metrics.spearman(table, "score", "k", **how).first()
    assert got.rho == pytest.approx(np.corrcoef(data.score.rank(), data.k.rank())[0, 1])


def test_take_by_hash_is_exact_and_stable(table, data):
    plain = {r.row_id for r in order.take_by_hash(table, "row_id", ["g"], F.lit(30), 5).collect()}
    split = {r.row_id for r in order.take_by_hash(table, "row_id", ["g"], F.lit(30), 5, limit=25).collect()}
    assert plain == split
    assert data[data.row_id.isin(plain)].groupby("g").size().to_dict() == data.groupby("g").size().clip(upper=30).to_dict()


def test_shuffled_labels_keep_counts(table, data):
    out = metrics.shuffled_labels(table, "row_id", ["g"], F.col("y"), draws=3, limit=50).toPandas()
    assert len(out) == 3 * len(data)
    counts = out.groupby(["draw", "g"]).shuffled.sum()
    for draw in range(3):
        assert (counts[draw] == data.groupby("g").y.sum()).all()
    assert (out.shuffled != out.y).any()


def test_null_is_about_half(table):
    shuffled = metrics.shuffled_labels(table, "row_id", ["g"], F.col("y"), draws=10)
    per = metrics.auroc(shuffled, "score", F.col("shuffled"), ["g", "draw"])
    null = metrics.null_summary(metrics.mean_over_groups(per, ["draw"])).first()
    assert abs(null.null_mean - 0.5) < 0.03 and null.draws == 10


def test_bootstrap_brackets_the_mean(table):
    per = metrics.auroc(table, "score", F.col("y"), ["g"])
    r = metrics.bootstrap_mean(per, ["g"], "auc", draws=300).first()
    assert r.lo < r["mean"] < r.hi


def test_treated_share_curve(spark, data):
    rng = np.random.default_rng(2)
    d = pd.DataFrame({"row_id": np.arange(500), "s": rng.permutation(500).astype(float), "base": rng.random(500) < 0.5, "c": rng.random(500) < 0.5})
    got = outcomes.treated_share_curves(spark.createDataFrame(d), "c", ["s"], [0.2, 0.5, 1.0]).toPandas()
    gain = d.c.astype(int) - d.base.astype(int)
    for share in (0.2, 0.5, 1.0):
        n = round(share * 500)
        expected = d.base.mean() + gain[np.argsort(d.s)[:n]].sum() / 500
        best = d.base.mean() + np.sort(-gain)[:n].sum() * -1 / 500
        row = got[np.isclose(got.share, share)].set_index("ranking").accuracy
        assert row["s"] == pytest.approx(expected) and row["oracle"] == pytest.approx(best)

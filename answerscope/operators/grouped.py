"""Many small logistic models fitted together by Newton's method.

A grid of configurations, folds, layers and steps is one table of rows and a list of models. A model
names the slice it reads, the part of it that is held out and its inverse strength C. Each pass reads
the rows once for all models: tasks add up loss, gradient and Hessian rows of every model by Arrow
batch, Spark sums them by (model, block) map-side, and each model is solved in a task of its own. So the
number of jobs is that of the Newton passes, whatever the size of the grid.

What reaches the driver and is broadcast are the models' weights, whose size is that of the grid and is
checked: a grid beyond ``SHARED_BYTES`` is fitted in waves. A model's Hessian has the square of the
vector's width and must fit a task; for vectors of several thousand components use
``probes.fit_logistic``, whose state is a few vectors.

Rows without slice, part, vector or with a component that is null or not finite take no part; rows without
label are scored but not trained on. A model whose training rows lack a class, or that has none, scores NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerscope.operators import metrics
from answerscope.session import cut_lineage

SHARED_BYTES = 64 << 20  # weights, means and deviations of one wave of models
CHUNK_BYTES = 8 << 20  # values of the rows a task works on at a time
SUMS_BYTES = 128 << 20  # sums a task holds before it passes them on
BLOCK_VALUES = 1 << 16  # values of one block of Hessian rows
TOLERANCE = 1e-16  # Newton decrement at which the step taken is the last one
HEAD = -1  # block number of loss and gradient


class Model(NamedTuple):
    name: str
    c: float
    slice: str = ""
    held: str | None = None  # trained on all other parts, scored on this one; None: all rows for both


class Fitted(NamedTuple):
    model: Model
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of standardised components, the intercept last

    def raw(self) -> np.ndarray:
        """Weights of the plain components, the intercept last."""
        w = self.weights[:-1] / self.scale
        return np.append(w, self.weights[-1] - w @ self.mean)


def rows_of(df: DataFrame, label: Column, vector: str = "h", slice_by: Column | None = None, part: Column | None = None,
            fit: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The rows in the form that ``fit_models`` and ``score_models`` read, cut from their lineage.

    ``slice_by`` and ``part`` default to one slice and one part; ``fit`` marks rows that may be trained on.
    """
    one = F.lit("")
    ready = df.select(
        (one if slice_by is None else slice_by.cast("string")).alias("slice"), (one if part is None else part.cast("string")).alias("part"),
        label.cast("double").alias("y"), F.coalesce((F.lit(True) if fit is None else fit) & label.isNotNull(), F.lit(False)).alias("fit"),
        F.col(vector).cast("array<double>").alias("x"), F.struct(*[F.col(k) for k in keep]).alias("info") if keep else F.lit(0).alias("info"))
    ready = ready.where(F.col("slice").isNotNull() & F.col("part").isNotNull() & F.col("x").isNotNull())
    finite = F.forall("x", lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))  # NaN is above infinity here
    return cut_lineage(ready.where(finite).sortWithinPartitions("slice", "part"))


def _chunks(batch: pa.RecordBatch):
    """(slice, first row, rows, vectors): stretches of rows of one slice, bounded in bytes."""
    names, x = batch.column("slice"), batch.column("x")
    values = x.flatten().to_numpy(zero_copy_only=False)
    widths = x.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.r_[0, np.cumsum(widths)]
    codes = names.dictionary_encode()
    ids = codes.indices.to_numpy(zero_copy_only=False)
    edges = np.r_[0, np.flatnonzero(np.diff(ids)) + 1, len(ids)]
    for lo, hi in zip(edges[:-1], edges[1:]):
        width = int(widths[lo])
        if (widths[lo:hi] != width).any():
            raise ValueError(f"vectors of different widths in slice {names[lo].as_py()!r}")
        size = max(1, CHUNK_BYTES // (8 * max(width, 1)))
        for first in range(lo, hi, size):
            last = min(first + size, hi)
            yield names[int(lo)].as_py(), first, last - first, values[starts[first]:starts[last]].reshape(last - first, width)


def _moments(rows: DataFrame) -> list:
    """Rows, hits, mean and squared deviations of the training rows by (slice, part): as many rows as the grid names."""
    x = array_to_vector("x")
    stats = rows.where("fit").groupBy("slice", "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits"), vector_to_array(Summarizer.mean(x)).alias("mean"),
        vector_to_array(Summarizer.variance(x)).alias("variance"))
    return stats.collect()


class _State:
    """A model on its way: the best point, the direction from it and the point tried."""

    def __init__(self, model: Model, parts: list, balanced: bool, centre: bool, standardise: bool):
        parts = [p for p in parts if p["part"] != model.held]
        n, hits = sum(p["n"] for p in parts), sum(p["hits"] for p in parts)
        self.model, self.usable, self.done = model, 0 < hits < n, False
        if not self.usable:
            return
        means, sizes = np.array([p["mean"] for p in parts]), np.array([p["n"] for p in parts], float)
        mean = sizes @ means / n
        spread = sum(np.array(p["variance"]) * (p["n"] - 1) for p in parts) + sizes @ (means - mean) ** 2
        deviation = np.sqrt(spread / n)
        self.mean = mean if centre else np.zeros_like(mean)
        self.scale = np.where(deviation > 0, deviation, 1.0) if standardise else np.ones_like(mean)
        self.up, self.down = (n / (2 * hits), n / (2 * (n - hits))) if balanced else (1.0, 1.0)
        self.trial = np.zeros(len(mean) + 1)
        self.best, self.loss, self.direction, self.length = self.trial, np.inf, self.trial, 1.0

    def shared(self) -> tuple:
        return self.model.held, self.model.c, self.mean, self.scale, self.up, self.down, self.trial

    def update(self, loss: float, step: np.ndarray, decrement: float) -> None:
        """Take the tried point if it is no worse, else go back half the way."""
        if loss <= self.loss + 1e-10 * abs(loss):
            self.best, self.loss, self.direction, self.length = self.trial, loss, step, 1.0
            self.done = decrement <= TOLERANCE * max(1.0, abs(loss))
        else:
            self.length /= 2.0
        self.trial = self.best + self.length * self.direction


def _margins(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z = np.empty((len(x), x.shape[1] + 1))
    np.divide(x - mean, scale, out=z[:, :-1])
    z[:, -1] = 1.0
    return z, z @ w


def _pass(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """(model, block, sums): block -1 holds loss and gradient, the others rows of the Hessian."""

    def run(batches):
        by_slice: dict[str, list] = {}
        for i, (name, *rest) in shared.value.items():
            by_slice.setdefault(name, []).append((i, *rest))
        sums, held_bytes = {}, 0

        def flush():
            for i, (head, hessian) in sums.items():
                width = len(hessian)
                lines = max(1, BLOCK_VALUES // width)
                pieces = [(HEAD, head)] + [(b, hessian[lo:lo + lines].ravel()) for b, lo in enumerate(range(0, width, lines))]
                for block, values in pieces:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i], pa.int32()), pa.array([block], pa.int32()), pa.array([values], pa.list_(pa.float64()))], ["model", "block", "sums"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part, y = batch.column("part").to_numpy(zero_copy_only=False), batch.column("y").to_numpy(zero_copy_only=False)
            fit = batch.column("fit").to_numpy(zero_copy_only=False).astype(bool)
            for name, first, n, x in _chunks(batch):
                here = slice(first, first + n)
                for i, held, c, mean, scale, up, down, w in by_slice.get(name, ()):
                    use = fit[here] & (part[here] != held)
                    if not use.any():
                        continue
                    z, margin = _margins(x[use], mean, scale, w)
                    hit = y[here][use] > 0
                    weight = np.where(hit, up, down)
                    loss = weight @ np.logaddexp(0.0, np.where(hit, -margin, margin))
                    p = 0.5 * (1.0 + np.tanh(0.5 * margin))
                    head = np.r_[loss, z.T @ (weight * (p - hit))]
                    hessian = z.T @ (z * (weight * p * (1.0 - p))[:, None])
                    if i in sums:
                        sums[i][0][:] += head
                        sums[i][1][:] += hessian
                    else:
                        sums[i] = (head, hessian)
                        held_bytes += hessian.nbytes
                    if held_bytes > SUMS_BYTES:
                        yield from flush()
                        sums, held_bytes = {}, 0
        yield from flush()

    partial = rows.select("slice", "part", "y", "fit", "x").mapInArrow(run, "model int, block int, sums array<double>")
    return partial.groupBy("model", "block").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))


def _solve(sums: DataFrame, shared: Broadcast) -> DataFrame:
    """The Newton step of each model; one task holds one model's Hessian."""

    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("block")
        i = int(pieces["model"].iloc[0])
        _, _, c, *_, w = shared.value[i]
        head = np.asarray(pieces["sums"].iloc[0])
        hessian = c * np.concatenate([np.asarray(s) for s in pieces["sums"].iloc[1:]]).reshape(len(w), len(w))
        free = np.append(w[:-1], 0.0)  # the intercept bears no penalty
        gradient = free + c * head[1:]
        hessian[np.arange(len(w) - 1), np.arange(len(w) - 1)] += 1.0
        step = -np.linalg.solve(hessian, gradient)
        return pd.DataFrame({"model": [i], "loss": [0.5 * free @ free + c * head[0]], "step": [step.tolist()], "decrement": [-gradient @ step]})

    return sums.groupBy("model").applyInPandas(run, "model int, loss double, step array<double>, decrement double")


def _waves(states: list[_State]) -> list[dict[int, _State]]:
    out, used = [{}], 0
    for i, state in enumerate(states):
        size = 24 * (len(state.trial) + 1)
        if out[-1] and used + size > SHARED_BYTES:
            out.append({})
            used = 0
        out[-1][i] = state
        used += size
    return out


def fit_models(rows: DataFrame, models: Sequence[Model], balanced: bool = False, centre: bool = True, standardise: bool = True,
               max_passes: int = 60) -> list[Fitted]:
    """Penalised logistic models 0.5 |w|^2 + C * sum of losses; components are standardised on each model's training rows.

    ``rows`` come from ``rows_of``.  Models without both classes are left out; one that has not converged fails.
    """
    spark = rows.sparkSession
    stats: dict[str, list] = {}
    for r in _moments(rows):
        stats.setdefault(r["slice"], []).append(r)
    states = [_State(m, stats.get(m.slice, []), balanced, centre, standardise) for m in models]
    states = [s for s in states if s.usable]
    for wave in _waves(states):
        for _ in range(max_passes):
            active = {i: s for i, s in wave.items() if not s.done}
            if not active:
                break
            shared = spark.sparkContext.broadcast({i: (s.model.slice, *s.shared()) for i, s in active.items()})
            for r in _solve(_pass(rows, shared), shared).collect():
                active[r["model"]].update(r["loss"], np.asarray(r["step"]), r["decrement"])
            shared.unpersist()
        open_ = [s.model.name for s in wave.values() if not s.done]
        if open_:
            raise ValueError(f"{len(open_)} models did not converge, first {open_[0]!r}")
    return [Fitted(s.model, s.mean, s.scale, s.trial) for s in states]


def score_models(rows: DataFrame, fitted: Sequence[Fitted]) -> DataFrame:
    """(model name, the kept columns, score): the margin of every row of a model's held part, in one pass over the rows."""
    spark = rows.sparkSession
    kept = rows.schema["info"].dataType
    fields = "" if kept.typeName() == "integer" else kept.simpleString()
    waves, used = [[]], 0
    for f in fitted:
        if waves[-1] and used + 8 * len(f.weights) > SHARED_BYTES:
            waves.append([])
            used = 0
        waves[-1].append((f.model.name, f.model.slice, f.model.held, f.raw()))
        used += 8 * len(f.weights)

    def scorer(shared: Broadcast) -> Callable:
        def run(batches):
            by_slice: dict[str, list] = {}
            for name, slice_, held, w in shared.value:
                by_slice.setdefault(slice_, []).append((name, held, w))
            for batch in batches:
                if not batch.num_rows:
                    continue
                part = batch.column("part").to_numpy(zero_copy_only=False)
                for slice_, first, n, x in _chunks(batch):
                    here = part[first:first + n]
                    for name, held, w in by_slice.get(slice_, ()):
                        mine = np.arange(n) if held is None else np.flatnonzero(here == held)
                        if len(mine):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([name] * len(mine)), batch.column("info").take(pa.array(first + mine)), pa.array(x[mine] @ w[:-1] + w[-1])],
                                ["model", "info", "score"])

        return run

    out = None
    for wave in waves:
        scored = rows.select("slice", "part", "x", "info").mapInArrow(
            scorer(spark.sparkContext.broadcast(wave)), f"model string, info {fields or 'int'}, score double")
        out = scored if out is None else out.unionByName(scored)
    return out.select("model", *([f"info.{n}" for n in kept.names] if fields else []), "score")


def sweep(rows: DataFrame, configurations: dict[str, float], folds: int, label: str = "correct", fact: str = "fact") -> DataFrame:
    """(name, position, score): mean over folds of the mean within-fact AUROC, for named values of C.

    ``rows`` hold the fold as part and keep ``label`` and ``fact``.  A fold without a fact of both outcomes, or whose
    training rows lack a class, does not count; a configuration without any such fold scores NULL.
    """
    names = list(configurations)
    models = [Model(f"{i}:{g}", configurations[name], held=str(g)) for i, name in enumerate(names) for g in range(folds)]
    scored = score_models(rows, fit_models(rows, models))
    per_fold = metrics.mean_over_groups(metrics.auroc(scored, "score", F.col(label), ["model", fact]), ["model"])
    means = per_fold.groupBy(F.split_part("model", F.lit(":"), F.lit(1)).cast("int").alias("position")).agg(F.avg("mean_auc").alias("score"))
    return named(rows.sparkSession, names).join(means, "position", "left")


def named(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "position int, name string")


def slice_sweep(rows: DataFrame, slices: Sequence[str], c: float, held: str = "test", label: str = "correct") -> DataFrame:
    """(slice, auc) of one model a slice, trained outside the held part; slices without both classes are absent."""
    models = [Model(s, c, s, held) for s in slices]
    scored = score_models(rows, fit_models(rows, models))
    return metrics.auroc(scored, "score", F.col(label), ["model"]).select(F.col("model").alias("slice"), "auc")

"""Reproducible pseudo-randomness: every draw is a hash of a seed and a key.

md5 is used because any SQL engine computes the same value, so splits, samples
and resamples can be recomputed elsewhere, and because a task that is run again
after an executor loss draws the same numbers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_RANGE = 2**32


def hash32(*keys: Column | str, seed: object = None) -> Column:
    """Uniform integer in [0, 2**32) from the keys, joined by ':' after the seed."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    parts = [p.cast("string") for p in parts]
    if seed is not None:
        parts = [F.lit(str(seed))] + parts
    digest = F.md5(F.concat_ws(":", *parts) if len(parts) > 1 else parts[0])
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def uniform(*keys: Column | str, seed: object = None) -> Column:
    """Uniform double in [0, 1)."""
    return hash32(*keys, seed=seed).cast("double") / F.lit(float(HASH_RANGE))


# Cumulative Poisson(1) probabilities: how often a unit is drawn in one resample.
# The tail above 10 has probability 1e-8.
_POISSON_CDF = []
_term, _total = 0.36787944117144233, 0.0
for _j in range(11):
    _total += _term
    _POISSON_CDF.append(round(_total, 12))
    _term /= _j + 1


PER_DIGEST = 4  # one md5 holds four 32-bit numbers, so four draws share it


DRAW_ROWS, DRAW_GROUPS = 128, 64  # rows weighed at once, groups a task adds up before it hands them on


def _weights(keys: Sequence[str], draws: int, seed: object) -> np.ndarray:
    """Poisson(1) weights [key, draw] by md5 of seed, block of draws and key."""
    starts = [f"{seed}:{block}:".encode() for block in range((draws - 1) // PER_DIGEST + 1)]
    digests = b"".join([md5(s + k, usedforsecurity=False).digest() for k in (key.encode() for key in keys) for s in starts])
    h = np.frombuffer(digests, ">u4").astype(np.uint32).reshape(len(keys), -1)[:, :draws]
    weight = np.zeros(h.shape, np.uint8)
    for cut in _POISSON_CDF:
        weight += h >= np.uint32(math.ceil(cut * HASH_RANGE))  # the product is exact
    return weight.astype(np.float64)


def draw_sums(df: DataFrame, draws: int, values: dict[str, Column], *keys: Column | str, by: Sequence[str] = (), seed: object = None) -> DataFrame:
    """Per group and draw the sums of Poisson(1) weight times value, the weight by (draw, keys).

    Rows are weighed in blocks inside a task and never multiplied by the draws; a task hands on ``draws`` rows
    of a group. A sum without values is NULL.
    """
    key = F.concat_ws(":", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    source = df.select(*by, key.alias("__key"), *[v.cast("double").alias(n) for n, v in values.items()])
    spark = df.sparkSession
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(48, 4 * spark.sparkContext.defaultParallelism))
    source = source.repartition(tasks, "__key")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:len(by)]], "draw int", *[f"`{n}` double" for n in values]])
    by, sums_of = list(by), list(values)

    def handed_on(sums: dict, types: list) -> pa.RecordBatch:
        groups = [pa.array([g[i] for g in sums for _ in range(draws)], types[i]) for i in range(len(by))]
        totals = []
        for j in range(len(sums_of)):
            known = np.concatenate([np.full(draws, counts[j] > 0) for _, counts in sums.values()])
            totals.append(pa.array(np.concatenate([t[j] for t, _ in sums.values()]), pa.float64(), mask=~known))
        return pa.RecordBatch.from_arrays([*groups, pa.array(np.tile(np.arange(draws, dtype=np.int32), len(sums))), *totals], [*by, "draw", *sums_of])

    def run(batches):
        sums, types = {}, []
        for batch in batches:
            types = batch.schema.types
            groups = list(zip(*[batch.column(i).to_pylist() for i in range(len(by))])) if by else [()] * batch.num_rows
            texts = batch.column(len(by)).to_pylist()
            given = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in sums_of], axis=1)
            present = np.stack([batch.column(n).is_valid().to_numpy(zero_copy_only=False) for n in sums_of], axis=1)
            for first in range(0, batch.num_rows, DRAW_ROWS):
                part = slice(first, min(first + DRAW_ROWS, batch.num_rows))
                place = {k: i for i, k in enumerate(dict.fromkeys(texts[part]))}
                weight = _weights(list(place), draws, seed)
                members: dict = {}
                for i, name in enumerate(groups[part]):
                    members.setdefault(name, []).append(i)
                for name, at in members.items():
                    here, value = present[part][at], given[part][at]
                    total, count = sums.setdefault(name, (np.zeros((len(sums_of), draws)), np.zeros(len(sums_of), np.int64)))
                    total += np.where(here, value, 0.0).T @ weight[[place[k] for k in (texts[first + i] for i in at)]]
                    count += here.sum(axis=0)
                    if len(sums) >= DRAW_GROUPS:
                        yield handed_on(sums, types)
                        sums = {}
        if sums:
            yield handed_on(sums, types)

    return source.mapInArrow(run, schema).groupBy(*by, "draw").agg(*[F.sum(n).alias(n) for n in sums_of])


def draw_uniform_sql(seed: object, draw: str, keys: str) -> str:
    """The uniform behind a draw weight as SQL text; ``keys`` is the ':'-joined key text."""
    digest = f"md5('{seed}:' || ({draw} // {PER_DIGEST}) || ':' || {keys})"
    return f"(('0x' || substr({digest}, ({draw} % {PER_DIGEST}) * 8 + 1, 8))::BIGINT::DOUBLE / {float(HASH_RANGE)}::DOUBLE)"


def poisson_sql(u: str) -> str:
    """The Poisson(1) count of a uniform value, the number of cut points at or below it, as SQL text."""
    return " + ".join(f"({u} >= {cut}::DOUBLE)::INT" for cut in _POISSON_CDF)

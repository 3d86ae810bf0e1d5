"""Sparse feature dictionaries as tables of latent blocks.

A dictionary of any number of entries stays on Spark: entries are packed into blocks of bounded size, states
into packs of rows, and every pack meets every block by a join on the block number. A block of features answers for
itself, so encoding needs nothing more; partial reconstructions are added by pack. Packs and blocks are shuffled, the
blocks under several salts, so that no task has all the packs of a block. Only where the whole dictionary is small, by its
checked size, is it broadcast; rows then go through Python once, in Spark's batches of rows, without packs. The driver
sees the features that a caller names and such a small dictionary, never a larger matrix.

Rows without a vector take no part. Numbers are kept in the type of the table's arrays and computed in double.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerscope.session import cut_lineage

BLOCK_BYTES = 32 << 20  # encoder and decoder rows of one block
PACK_BYTES = 4 << 20  # vectors of one pack of rows; also their activations at a time
BROADCAST_BYTES = 32 << 20  # a dictionary up to this size is sent to every executor
MOMENT_VALUES = 1 << 19  # values of one block of rows of the moment matrix


class Dictionary:
    """Encoder and decoder rows of the features: ``table`` has latent, w_enc array, b_enc, threshold, w_dec array.

    Features are dealt to blocks by hash, so block sizes vary about the mean, which is half of ``block_bytes``.
    """

    def __init__(self, table: DataFrame, b_dec: Sequence[float], block_bytes: int | None = None, broadcast_bytes: int | None = None):
        block_bytes = BLOCK_BYTES if block_bytes is None else block_bytes
        self.b_dec = np.asarray(b_dec, np.float64)
        element = table.schema["w_enc"].dataType.elementType.typeName()
        self.dtype = np.dtype(np.float32 if element == "float" else np.float64)
        self.table = cut_lineage(table.select("latent", "w_enc", "b_enc", "threshold", "w_dec"))
        row_bytes = 2 * self.width * self.dtype.itemsize
        n = self.table.count()
        self.n_blocks = max(1, -(-2 * n * row_bytes // block_bytes)) if n * row_bytes > block_bytes else 1
        self.small = n * row_bytes <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes)
        dtype = self.dtype

        def pack(features: pd.DataFrame) -> pd.DataFrame:
            features = features.sort_values("latent")
            return pd.DataFrame({
                "block": [int(features["block"].iloc[0])], "latent": [features["latent"].to_numpy(np.int64).tobytes()],
                "w_enc": [np.stack(features["w_enc"].to_list()).astype(dtype).tobytes()], "b_enc": [features["b_enc"].to_numpy(np.float64).tobytes()],
                "threshold": [features["threshold"].to_numpy(np.float64).tobytes()], "w_dec": [np.stack(features["w_dec"].to_list()).astype(dtype).tobytes()]})

        dealt = self.table.withColumn("block", F.pmod(F.xxhash64("latent"), F.lit(self.n_blocks)).cast("int"))
        self.blocks = cut_lineage(dealt.groupBy("block").applyInPandas(
            pack, "block int, latent binary, w_enc binary, b_enc binary, threshold binary, w_dec binary"))

    @property
    def width(self) -> int:
        return len(self.b_dec)

    @cached_property
    def shared(self) -> Broadcast:
        """The blocks of a small dictionary."""
        return self.blocks.sparkSession.sparkContext.broadcast([row.asDict() for row in self.blocks.collect()])

    @cached_property
    def latents(self) -> list[int]:
        """The feature numbers in order."""
        return sorted(r["latent"] for r in self.table.select("latent").collect())

    def features(self, latents: Iterable[int]) -> pd.DataFrame:
        """The rows of the features a caller names, by number."""
        wanted = sorted({int(x) for x in latents})
        names = self.table.sparkSession.createDataFrame([(x,) for x in wanted], "latent long")
        found = self.table.join(names, "latent", "left_semi").toPandas().set_index("latent")
        missing = [x for x in wanted if x not in found.index]
        if missing:
            raise KeyError(f"no features {missing[:5]}")
        return found.loc[wanted]

    def bases(self, sets: dict[int, Sequence[int]]) -> dict[int, np.ndarray]:
        """Orthonormal bases [dim, K] of the unit decoder rows of several sets of features."""
        found = self.features(x for s in sets.values() for x in s)["w_dec"]
        out = {}
        for name, latents in sets.items():
            w = np.stack([np.asarray(found.loc[int(x)], np.float64) for x in latents])
            out[name] = np.linalg.qr((w / np.linalg.norm(w, axis=1, keepdims=True)).T)[0]
        return out

    def basis(self, latents: Sequence[int]) -> np.ndarray:
        return self.bases({0: latents})[0]


def _source(states: DataFrame, vector: str, columns: Sequence[str]) -> DataFrame:
    info = F.struct(*[F.col(c) for c in columns])
    return states.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("x"), info.alias("info"))


def _parts(batches: Iterable[pa.RecordBatch], width: int, limit: int) -> Iterator[tuple[np.ndarray, pa.StructArray]]:
    """Vectors of up to ``limit`` bytes together, with the named columns of their rows."""
    size = max(1, limit // (8 * width))
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False)
        if len(x) != n * width or (batch.column("x").value_lengths().to_numpy(zero_copy_only=False) != width).any():
            raise ValueError(f"a vector does not have the dictionary's {width} components")
        for first in range(0, n, size):
            yield x[first * width:(first + size) * width].reshape(-1, width), batch.column("info").slice(first, size)


def _packs(states: DataFrame, vector: str, columns: Sequence[str], width: int) -> DataFrame:
    """(pack, x, info): vectors of up to ``PACK_BYTES`` together, with the named columns of their rows."""
    source, limit = _source(states, vector, columns), PACK_BYTES

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for x, info in _parts(batches, width, limit):
            rows = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), info)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([x.tobytes()], pa.binary()), rows], ["pack", "x", "info"])
            number += 1

    return source.mapInArrow(run, f"pack long, x binary, info array<{source.schema['info'].dataType.simpleString()}>")


def _met(packs: DataFrame, dictionary: Dictionary, *columns: str) -> DataFrame:
    """Every pack with every block; the blocks' named columns come with it."""
    blocks = dictionary.blocks.select("block", *columns)
    salts = max(1, int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // dictionary.n_blocks)
    spread = packs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(dictionary.n_blocks - 1)))).withColumn(
        "salt", F.pmod(F.xxhash64("pack"), F.lit(salts)).cast("int"))
    return spread.join(blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["block", "salt"])


def _vectors(content: bytes, width: int, dtype: np.dtype = np.dtype(np.float64)) -> np.ndarray:
    return np.frombuffer(content, dtype).reshape(-1, width).astype(np.float64, copy=False)


def _active(x: np.ndarray, w_enc: np.ndarray, b_enc: bytes, threshold: bytes, b_dec: np.ndarray) -> np.ndarray:
    pre = (x - b_dec) @ w_enc.T + np.frombuffer(b_enc)
    return np.where(pre > np.frombuffer(threshold), pre, 0.0)


def _some(n: int, columns: int, limit: int) -> Iterator[slice]:
    """Rows of which a matrix with so many columns stays within ``limit`` bytes."""
    size = max(1, limit // (8 * max(1, columns)))
    return (slice(first, first + size) for first in range(0, n, size))


def _encoded(ids: pa.Array, x: np.ndarray, latent: bytes, given: tuple, limit: int) -> Iterator[pa.RecordBatch]:
    """Active features of one block, for some rows at a time."""
    latents = np.frombuffer(latent, np.int64)
    for rows in _some(len(x), len(latents), limit):
        a = _active(x[rows], *given)
        at_row, at_latent = np.nonzero(a)
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(at_row + rows.start)).cast(pa.int64()), pa.array(latents[at_latent].astype(np.int32)), pa.array(a[at_row, at_latent])], ["row_id", "latent", "a"])


def _decoded(x: np.ndarray, given: tuple, w_dec: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """What one block adds to the reconstruction, and each row's count of its active features."""
    r, active = np.empty(x.shape), np.empty(len(x), np.int64)
    for rows in _some(len(x), len(w_dec), limit):
        a = _active(x[rows], *given)
        r[rows], active[rows] = a @ w_dec, (a > 0).sum(1)
    return r, active


def encode(states: DataFrame, dictionary: Dictionary, vector: str = "h", row_id: str = "row_id") -> DataFrame:
    """Active features only, as (row_id, latent, a)."""
    width, dtype, b_dec, limit = dictionary.width, dictionary.dtype, dictionary.b_dec, PACK_BYTES
    schema = "row_id long, latent int, a double"
    if dictionary.small:
        shared = dictionary.shared

        def rowwise(batches):
            blocks = [(b["latent"], (_vectors(b["w_enc"], width, dtype), b["b_enc"], b["threshold"], b_dec)) for b in shared.value]
            for x, info in _parts(batches, width, limit):
                for latent, given in blocks:
                    yield from _encoded(info.flatten()[0], x, latent, given, limit)

        return _source(states, vector, [row_id]).mapInArrow(rowwise, schema)
    met = _met(_packs(states, vector, [row_id], width), dictionary, "latent", "w_enc", "b_enc", "threshold")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x, w_enc, latent, b_enc, threshold = [batch.column(c)[i].as_py() for c in ("x", "w_enc", "latent", "b_enc", "threshold")]
                ids = batch.column("info")[i].values.flatten()[0]
                yield from _encoded(ids, _vectors(x, width), latent, (_vectors(w_enc, width, dtype), b_enc, threshold, b_dec), limit)

    return met.select("x", "info", "latent", "w_enc", "b_enc", "threshold").mapInArrow(run, schema)


def reconstruct(states: DataFrame, dictionary: Dictionary, vector: str = "h") -> DataFrame:
    """Reconstruction r, residual e = h - r, and the row's count of active features; other columns stay."""
    width, dtype, b_dec, limit = dictionary.width, dictionary.dtype, dictionary.b_dec, PACK_BYTES
    kept = [f for f in states.schema.fields if f.name not in ("r", "e", "active")]
    names = [f.name for f in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", r array<double>, e array<double>, active long"

    def lists(m: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, width), pa.int32()), pa.array(m.ravel()))

    def summed(x: np.ndarray, columns: list[pa.Array], parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
        r, active = b_dec + np.zeros_like(x), np.zeros(len(x), np.int64)
        for more, on in parts:
            r += more
            active += on
        return [*columns, lists(r), lists(x - r), pa.array(active)]

    if dictionary.small:
        shared = dictionary.shared

        def rowwise(batches):
            blocks = [((_vectors(b["w_enc"], width, dtype), b["b_enc"], b["threshold"], b_dec), _vectors(b["w_dec"], width, dtype)) for b in shared.value]
            for x, info in _parts(batches, width, limit):
                columns = summed(x, info.flatten(), (_decoded(x, given, w_dec, limit) for given, w_dec in blocks))
                yield pa.RecordBatch.from_arrays(columns, [*names, "r", "e", "active"])

        return _source(states, vector, names).mapInArrow(rowwise, schema)
    packs = cut_lineage(_packs(states, vector, names, width))  # met by the blocks, then by the sums

    def pieces(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                pack, x, w_enc, b_enc, threshold, w_dec = [batch.column(c)[i].as_py() for c in ("pack", "x", "w_enc", "b_enc", "threshold", "w_dec")]
                r, active = _decoded(_vectors(x, width), (_vectors(w_enc, width, dtype), b_enc, threshold, b_dec), _vectors(w_dec, width, dtype), limit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([pack], pa.int64()), pa.array([r.tobytes()], pa.binary()), pa.array([active.tobytes()], pa.binary())], ["pack", "r", "active"])

    def finished(pack: pa.Table, parts: pa.Table) -> pa.Table:
        x = _vectors(pack["x"][0].as_py(), width)
        added = ((_vectors(r.as_py(), width), np.frombuffer(on.as_py(), np.int64)) for r, on in zip(parts["r"], parts["active"], strict=True))
        return pa.Table.from_arrays(summed(x, pack["info"][0].values.flatten(), added), [*names, "r", "e", "active"])

    met = _met(packs.select("pack", "x"), dictionary, "w_enc", "b_enc", "threshold", "w_dec")
    partial = met.select("pack", "x", "w_enc", "b_enc", "threshold", "w_dec").mapInArrow(pieces, "pack long, r binary, active binary")
    return packs.groupBy("pack").cogroup(partial.groupBy("pack")).applyInArrow(finished, schema)


def remove_features(states: DataFrame, dictionary: Dictionary, latents: Sequence[int], vector: str = "h") -> DataFrame:
    """H minus what the chosen features themselves contribute to its reconstruction."""
    chosen = dictionary.features(latents)
    w_enc, w_dec = [np.stack(chosen[c].map(lambda v: np.asarray(v, np.float64)).to_list()) for c in ("w_enc", "w_dec")]
    parameters = (w_enc, chosen["b_enc"].to_numpy(np.float64).tobytes(), chosen["threshold"].to_numpy(np.float64).tobytes(), dictionary.b_dec)
    shared = states.sparkSession.sparkContext.broadcast((parameters, w_dec))

    @F.pandas_udf("array<double>")
    def take_off(h: pd.Series) -> pd.Series:
        given, decoder = shared.value
        x = np.stack(h.to_numpy()).astype(np.float64)
        return pd.Series(list(x - _active(x, *given) @ decoder))

    return states.withColumn(vector, take_off(F.col(vector)))


def direction_moments(states: DataFrame, width: int, vector: str = "h") -> DataFrame:
    """(block, sums): rows of the mean of hh' / |h|^2, added up in one pass; vectors of zeros count for nothing."""
    lines = max(1, MOMENT_VALUES // width)
    source = states.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("x"))

    def run(batches):
        total, n = np.zeros((width, width)), 0
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            size = np.einsum("ij,ij->i", x, x)
            x = x[size > 0] / np.sqrt(size[size > 0])[:, None]
            total += x.T @ x
            n += len(x)
        if n:
            for block, first in enumerate(range(0, width, lines)):
                sums = np.append(total[first:first + lines].ravel(), n)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sums], pa.list_(pa.float64()))], ["block", "sums"])

    partial = source.mapInArrow(run, "block int, sums array<double>")
    return partial.groupBy("block").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))


def set_energy(states: DataFrame, dictionary: Dictionary, sets: DataFrame, by: str = "draw", vector: str = "h") -> DataFrame:
    """(draw, energy): mean share of |h|^2 that the decoder rows of each set of features span.

    The states are read once, whatever the number of sets: with S the moment matrix, U the unit decoder rows of a
    set and V = US, the share is trace((UU')^-1 UV'). ``sets`` is (draw, latent) and stays a table; a task holds one set.
    """
    width = dictionary.width
    named = sets.select(by, "latent").where(F.col("latent").isNotNull()).distinct()
    used = dictionary.table.select("latent", "w_dec").join(named.select("latent").distinct(), "latent", "left_semi")
    moments = cut_lineage(direction_moments(states, width, vector))
    n_blocks = -(-width // max(1, MOMENT_VALUES // width))
    spread = _packs(used, "w_dec", ["latent"], width).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def products(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                sums = batch.column("sums")[i].values.to_numpy(zero_copy_only=False)
                u = _vectors(batch.column("x")[i].as_py(), width)
                u = u / np.linalg.norm(u, axis=1, keepdims=True)
                v = u @ (sums[:-1].reshape(-1, width) / sums[-1]).T
                latents = batch.column("info")[i].values.flatten()[0].cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [latents, pa.array([batch.column("block")[i].as_py()] * len(u), pa.int32()), pa.array(list(v), pa.list_(pa.float64()))], ["latent", "block", "v"])

    pieces = spread.join(moments, "block").select("block", "x", "info", "sums").mapInArrow(products, "latent long, block int, v array<double>")
    whole = pieces.groupBy("latent").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "v"))), lambda p: p["v"])).alias("v"))
    joined = named.join(used.select("latent", "w_dec"), "latent").join(whole, "latent")
    kind = named.schema[by].dataType.simpleString()

    def energy(rows: pd.DataFrame) -> pd.DataFrame:
        u, v = [np.stack([np.asarray(x, np.float64) for x in rows[c]]) for c in ("w_dec", "v")]
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        return pd.DataFrame({by: [rows[by].iloc[0]], "energy": [float(np.trace(np.linalg.solve(u @ u.T, u @ v.T)))]})

    return joined.groupBy(by).applyInPandas(energy, f"`{by}` {kind}, energy double")

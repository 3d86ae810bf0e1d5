"""Vector code compression: product codes whose codebooks are refined with adaptive distance bounds.

Components become integers floor(1024 x), vectors ``PARTS`` equal consecutive parts. A part
position's codebook starts as that part of the ``ENTRIES`` smallest vec_ids; each round assigns
every part to its nearest entry (ties to the lower index) and replaces an entry by the floored
mean of its parts. Between rounds every part keeps, in a table in the shared folder, an upper
bound on the distance to its entry, its ``b`` next closest entries with ordered lower bounds and
one outer bound on all others (Drake and Hamerly). When entries move, bounds are widened by the
movements; only entries whose bound the upper bound reaches are computed again, all of them only
if it reaches the outer bound. ``b`` follows what the last round needed. Bounds are floating
point and are trusted only beyond a margin; whatever lies within it is decided by exact integer
distances, so the result does not depend on ``b``.

What tasks get is the codebooks and movements, whose size is fixed by ``ENTRIES`` and the
dimension; the driver gets sums per entry, which Spark adds up. The state of the round before is
dropped once the next is written.

Nulls and the like: a row is dropped if its vector is null or holds a null or non-finite
component. Shorter vectors are filled up with zeros to the longest one's length, rounded up to a
multiple of ``PARTS``; empty ones are zeros. With fewer than ``ENTRIES`` kept rows the codebook is as
short. Null vec_ids are kept and come last in the order, rows of one vec_id are ordered by their
integers; null labels are one label. Repeated rows get equal codes. Components beyond 2**20 in
magnitude after scaling raise a ValueError, since sums of squares would no longer be exact.
Further columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerscope.llm.common import Scratch, table

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
FIRST_B = 16
B_CHOICES = (2, 4, 8, 16, 32)
LARGEST = 1 << 20
_MARGIN = 1e-6  # relative; far above the error of 32-bit bounds and 64-bit square roots

_STATE = "vec_id bigint, label int, x binary, entry binary, upper binary, near binary, lower binary, needed binary, error binary"


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x): kept rows with integer components."""
    v = F.col("embedding")
    fine = v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    scaled = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("bigint"), F.col("label").cast("int"), scaled.alias("x"))


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x and entries, as integers in doubles."""
    x, e = x.astype(np.float64), entries.astype(np.float64)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ e.T) + (e * e).sum(axis=1)[None, :]


def _fresh(x: np.ndarray, entries: np.ndarray, b: int):
    """Assignment, distance, the b next closest entries, their distances and the next one's, all exact."""
    key = (_distances(x, entries).astype(np.int64) << 16) + np.arange(len(entries))
    most = min(b + 2, len(entries))
    key = np.sort(np.partition(key, most - 1, axis=1)[:, :most], axis=1)
    index, root = key & 0xFFFF, np.sqrt((key >> 16).astype(np.float64))
    near, lower = np.full((len(x), b), -1, dtype=np.int16), np.full((len(x), b + 1), np.inf)
    near[:, :most - 1] = index[:, 1:b + 1]
    lower[:, :most - 1] = root[:, 1:]
    return index[:, 0], root[:, 0], near, lower


def refined(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, entry, upper, near, lower, b: int):
    """The state of parts after their entries moved by ``moved``; also how many of the near entries each part needed (b + 1: all entries)."""
    upper = upper + moved[entry]
    lower = lower.copy()
    lower[:, :-1] -= np.where(near >= 0, moved[near], moved.max(initial=0))
    lower[:, -1] -= moved.max(initial=0)
    ordered = np.minimum.accumulate(lower[:, ::-1], axis=1)[:, ::-1]
    if near.shape[1] > b:
        near, ordered = near[:, :b], np.concatenate([ordered[:, :b], ordered[:, b:b + 1]], axis=1)
    elif near.shape[1] < b:
        more = b - near.shape[1]
        near = np.concatenate([near, np.full((len(near), more), -1, near.dtype)], axis=1)
        ordered = np.concatenate([ordered, np.repeat(ordered[:, -1:], more, axis=1)], axis=1)
    near, lower, entry = near.copy(), ordered.copy(), entry.copy()
    certain = upper[:, None] * (1 + _MARGIN) + _MARGIN < ordered
    needed = np.where(certain.any(axis=1), certain.argmax(axis=1), b + 1)
    needed[(needed <= b) & ((near < 0) & (np.arange(b) < needed[:, None])).any(axis=1)] = b + 1
    every = np.flatnonzero(needed > b)
    if len(every):
        entry[every], upper[every], near[every], lower[every] = _fresh(x[every], entries, b)
    some = np.flatnonzero((needed > 0) & (needed <= b))
    if len(some):
        listed = np.concatenate([entry[some, None], near[some].astype(np.int64)], axis=1)
        used = np.arange(b + 1) <= needed[some, None]
        gap = entries[np.where(used, listed, 0)] - x[some][:, None, :]
        key = np.where(used, ((gap * gap).sum(axis=2) << 16) + listed, np.iinfo(np.int64).max)
        key.sort(axis=1)
        root = np.sqrt((key >> 16).astype(np.float64))
        entry[some], upper[some] = key[:, 0] & 0xFFFF, root[:, 0]
        near[some] = np.where(used[:, 1:], key[:, 1:] & 0xFFFF, near[some])
        lower[some, :b] = np.where(used[:, 1:], root[:, 1:], lower[some, :b])
    return entry, upper, near, lower, needed


def _stacked(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), PARTS, -1)


def _packed(a: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(a)], pa.binary())


def _assign(books: np.ndarray, moved: np.ndarray | None, b: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if moved is None:
                x = np.zeros((batch.num_rows, PARTS * width), dtype=np.int32)
                rows = batch.column("x")
                sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
                place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                values = rows.flatten().to_numpy(zero_copy_only=False)
                x[np.repeat(np.arange(len(sizes)), sizes), place] = values
                x = x.reshape(-1, PARTS, width)
                old = None
            else:
                x = _stacked(batch.column("x"), np.int32)
                old = [_stacked(batch.column(c), t) for c, t in (("entry", np.int16), ("upper", np.float32), ("near", np.int16), ("lower", np.float32))]
            parts = []
            for p in range(PARTS):
                mine = x[:, p].astype(np.int64)
                if old is None:
                    state = (*_fresh(mine, books[p], b), np.full(len(mine), b + 1))
                else:
                    state = refined(mine, books[p], moved[p], old[0][:, p, 0].astype(np.int64), old[1][:, p, 0].astype(np.float64), old[2][:, p], old[3][:, p].astype(np.float64), b)
                gap = books[p][state[0]] - mine
                parts.append((*state, (gap * gap).sum(axis=1)))
            entry, upper, near, lower, needed, error = (np.stack(c, axis=1) for c in zip(*parts, strict=True))
            up, down = np.nextafter(upper.astype(np.float32), np.float32(np.inf)), np.nextafter(lower.astype(np.float32), np.float32(-np.inf))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), batch.column("label"), _packed(x), _packed(entry.astype(np.int16)), _packed(up), _packed(near.astype(np.int16)), _packed(down),
                _packed(needed.astype(np.int16)), _packed(error.astype(np.int64))], names=["vec_id", "label", "x", "entry", "upper", "near", "lower", "needed", "error"])
    return run


def _partial(entries: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, used = np.zeros((PARTS * entries, width + 1), dtype=np.int64), np.zeros(max(B_CHOICES) + 2, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x, entry = _stacked(batch.column("x"), np.int32), _stacked(batch.column("entry"), np.int16)[:, :, 0]
                at = (entry.astype(np.int64) + np.arange(PARTS) * entries).ravel()
                np.add.at(total, at, np.concatenate([x.reshape(-1, width), np.ones((len(at), 1), np.int32)], axis=1))
                used += np.bincount(_stacked(batch.column("needed"), np.int16).ravel(), minlength=len(used))
        rows = np.flatnonzero(total[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(total[rows].tolist(), pa.list_(pa.int64()))], names=["entry", "sums"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([used.tolist()], pa.list_(pa.int64()))], names=["entry", "sums"])
    return run


def train(vectors: DataFrame, scratch: Scratch, first_b: int = FIRST_B) -> tuple[DataFrame, np.ndarray] | None:
    """(state of the last assignment, codebooks [part, entry, position]) of ``vectors`` (vec_id, label, embedding); None if no row is kept."""
    rows = scratch.keep(integers(vectors))
    size, largest = rows.agg(F.max(F.size("x")), F.max(F.greatest(F.array_max("x"), -F.array_min("x")))).first()
    if size is None:
        return None
    if (largest or 0) > LARGEST:
        raise ValueError(f"a scaled component exceeds {LARGEST}")
    width = max(1, -(-size // PARTS))
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).collect()
    books = np.zeros((len(start), PARTS * width), dtype=np.int64)
    for k, r in enumerate(start):
        books[k, :len(r.x)] = r.x
    books = np.ascontiguousarray(books.reshape(-1, PARTS, width).transpose(1, 0, 2))
    entries, b, moved, state = len(start), first_b, None, rows
    for step in range(ROUNDS + 1):
        before, state = state, scratch.keep(state.mapInArrow(_assign(books, moved, b, width), _STATE))
        scratch.drop(before)
        if step == ROUNDS:
            return state, books
        partial = state.select("x", "entry", "needed").mapInArrow(_partial(entries, width), "entry bigint, sums array<bigint>")
        sums = partial.select("entry", F.posexplode("sums").alias("at", "n")).groupBy("entry", "at").agg(F.sum("n").alias("n")).collect()  # entries x (width + 1) rows at most
        total, used = np.zeros((PARTS * entries, width + 1), dtype=np.int64), np.zeros(max(B_CHOICES) + 2, dtype=np.int64)
        for r in sums:
            (used if r["entry"] < 0 else total[r["entry"]])[r["at"]] = r["n"]
        filled = total[:, -1] > 0
        new = books.reshape(-1, width).copy()
        new[filled] = total[filled, :-1] // total[filled, -1:]
        new = new.reshape(books.shape)
        moved = np.sqrt(((new - books) ** 2).sum(axis=2).astype(np.float64)) * (1 + 1e-12)
        books = new
        if step:  # the least b that would have spared nine in ten parts the computing of all entries
            reach = np.cumsum(used) / used.sum()
            b = next((c for c in B_CHOICES if reach[c] >= 0.9), max(B_CHOICES))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            entry = _stacked(batch.column("entry"), np.int16)[:, :, 0].astype(np.uint8)
            error = _stacked(batch.column("error"), np.int64).sum(axis=(1, 2))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes().hex() for r in entry]), pa.array(error, pa.int64())],
                                             names=["vec_id", "label", "code", "error"])


def compressed(vectors: DataFrame, first_b: int = FIRST_B) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the kept rows of ``vectors``."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "codes")
    ddl = "vec_id bigint, label int, code string, error bigint"
    trained = train(vectors, scratch, first_b)
    codes = spark.createDataFrame([], ddl) if trained is None else trained[0].select("vec_id", "label", "entry", "error").mapInArrow(_codes, ddl)
    sums = scratch.keep(codes.groupBy("label").agg(F.sum("error").alias("label_error")))  # written, so Spark knows its size
    of_label = sums.withColumnRenamed("label", "of")
    joined = codes.join(of_label, codes["label"].eqNullSafe(of_label["of"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit("" if trained is None else digest(trained[1])).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return compressed(table(spark, folder, "embeddings", "vec_id", "embedding", "label"))


QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLES: dict[str, str] = {}

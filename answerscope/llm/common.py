"""What the operators of this subpackage share: tables, scratch tables, hashing of words and bytes.

Words are maximal runs of anything but the ASCII blanks 0x20 and 0x09-0x0D, lower-casing
is that of A-Z only, and texts are handled as UTF-8 bytes; a NULL text has no bytes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20  # text handled at once by the array code of a task; one longer text is handled alone

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SEPARATOR = np.array([not (chr(k).isalnum() or k > 127) for k in range(256)])  # ASCII but letters and digits
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{folder}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores after it as keep it apart from the names ``taken``, whatever their case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def without(frame: DataFrame, *names: str) -> DataFrame:
    """``frame`` without its columns of these names, whatever their case."""
    lower = {n.lower() for n in names}
    return frame.select(*[frame[c] for c in frame.columns if c.lower() not in lower])


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    Only a local session without ``spark.checkpoint.dir`` gets a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="llm-scratch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables that one call of an operator writes to cut lineage; those no longer read can be dropped."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count:04d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(frame._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2**64."""
    if len(_POWERS["up"]) < n:
        size = max(n, 2 * SLICE_BYTES)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """out[i] is the polynomial hash of the first i bytes."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes begin..end; equal strings have equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return mixed((prefix[end] - prefix[begin]) * down[begin])


def byte_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end row, texts as UTF-8) in runs of at most ``limit`` bytes or one text."""
    values = [v or b"" for v in texts.cast(pa.large_binary()).to_pylist()]
    first, held = 0, 0
    for k, v in enumerate(values):
        if k > first and held + len(v) > limit:
            yield first, k, values[first:k]
            first, held = k, 0
        held += len(v)
    if first < len(values):
        yield first, len(values), values[first:]


def word_hashes(values: list[bytes], separator: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words between ``separator`` bytes, and where each text's words begin (one entry more than texts)."""
    data = LOWER[np.frombuffer(b" " + b" ".join(values) + b" ", dtype=np.uint8)]
    blank = separator[data]
    begin = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    hashes = range_hashes(prefix_hashes(data), begin, end)
    starts = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum([len(v) + 1 for v in values], out=starts[1:])
    return hashes, np.searchsorted(begin, starts + 1)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words of one text; a shorter text is one shingle, an empty one none."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    up, _ = powers(width + 1)
    n = len(words) - width + 1
    total = np.full(n, width, dtype=np.uint64)
    for j in range(width):
        total += words[j:j + n] * up[j + 1]
    return mixed(total)

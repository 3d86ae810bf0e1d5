"""Scans and sinks."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed scan; blank lines are skipped, a missing file is an empty table, a malformed line fails the read."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object per line, UTF-8, nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


class Conflict(Exception):
    """Another writer published the version that this one was to become."""


def replace_table(df: DataFrame, path: str, fmt: str = "parquet", expected: int | None = None) -> str:
    """Write a complete new version beside the old one, then point readers at it.

    A version is a folder under a name of its own. Version n is published by the pointer file ``_current_n``,
    which is put in place complete and only where no file of that name stands, so of two writers one gets the
    number. A failed write leaves the old version in use. With ``expected``, the version that ``df`` was
    made from (-1: none), a writer that finds a newer one raises ``Conflict`` and changes nothing; without it the
    content is taken as independent of earlier versions and gets the next free number.
    Returns the path of the new version.
    """
    spark = df.sparkSession
    name = uuid.uuid4().hex
    target = f"{path}/version-{name}"
    df.write.format(fmt).save(target)
    number = _newest(spark, path) + 1 if expected is None else expected + 1
    while not _publish(spark, path, number, name):
        if expected is not None:
            raise Conflict(f"{path} has a version {number} by another writer")
        number += 1
    return target


def update_table(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], fmt: str = "parquet", attempts: int = 10) -> str:
    """Replace the newest version by ``change`` of it; a writer that comes second reads again and starts over."""
    for _ in range(attempts):
        number = _newest(spark, path)
        try:
            return replace_table(change(_read_version(spark, path, number, fmt)), path, fmt, number)
        except Conflict:
            continue
    raise Conflict(f"{path} changed during each of {attempts} attempts")


def _files(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def _newest(spark: SparkSession, path: str) -> int:
    files, root = _files(spark, path)
    if not files.exists(root):
        return -1
    names = [s.getPath().getName() for s in files.listStatus(root)]
    return max((int(n.removeprefix("_current_")) for n in names if n.startswith("_current_")), default=-1)


def _publish(spark: SparkSession, path: str, number: int, name: str) -> bool:
    """Put the pointer in place unless one of that number stands: a hard link on a local disk, elsewhere a rename, which
    must refuse an existing target as that of HDFS does."""
    files, _ = _files(spark, path)
    draft, pointer = [spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}") for n in (f"_next_{name}", f"_current_{number}")]
    out = files.create(draft, False)
    out.write(bytearray(name, "ascii"))
    out.close()
    if files.getScheme() == "file":
        try:
            os.link(draft.toUri().getPath(), pointer.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            files.delete(draft, False)
    done = not files.exists(pointer) and files.rename(draft, pointer)
    if not done:
        files.delete(draft, False)
    return done


def _read_version(spark: SparkSession, path: str, number: int, fmt: str) -> DataFrame:
    if number < 0:
        raise FileNotFoundError(path)
    files, _ = _files(spark, path)
    stream = files.open(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_current_{number}"))
    try:
        name = bytes(stream.readNBytes(64)).decode("ascii")
    finally:
        stream.close()
    return spark.read.format(fmt).load(f"{path}/version-{name}")


def read_current(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The newest published version."""
    return _read_version(spark, path, _newest(spark, path), fmt)


def read_name_cache(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """JSON documents of maps -> tables names(name, qids), entities(...), labels(qid, label, description).

    One document is one record and must fit a task; a large cache is kept as many documents,
    one per line (``multi_line=False``).
    """
    entity = "struct<label: string, desc: string, sitelinks: int, claims: map<string, array<string>>>"
    schema = f"names map<string, array<string>>, ent map<string, {entity}>, lab map<string, array<string>>"
    document = spark.read.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)
    names = document.select(F.explode("names").alias("name", "qids"))
    entities = document.select(F.explode("ent").alias("item", "e")).select(
        "item", F.col("e.label").alias("label"), F.col("e.desc").alias("description"), F.col("e.sitelinks").alias("sitelinks"), F.col("e.claims").alias("claims"))
    labels = document.select(F.explode("lab").alias("qid", "l")).select(
        "qid", F.get("l", F.lit(0)).alias("label"), F.get("l", F.lit(1)).alias("description"))
    return names, entities, labels


def write_states(df: DataFrame, path: str, partitions: Sequence[str] = ("position", "step"), mode: str = "errorifexists") -> None:
    """Columnar tensor table; readers of one position and step touch only its folder."""
    df.write.mode(mode).partitionBy(*partitions).parquet(path)


def new_rows(incoming: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet."""
    return incoming.join(done.select(*keys), list(keys), "left_anti")


def append_new(incoming: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append the missing rows to a parquet table; running it again adds nothing."""
    spark = incoming.sparkSession
    fresh = incoming.dropDuplicates(list(keys))
    try:
        fresh = new_rows(fresh, spark.read.parquet(path), keys)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    fresh.write.mode("append").parquet(path)


def metrics_long(results: dict, config: str = "") -> list[tuple[str, str, float]]:
    """A nested result dictionary as (config, metric, value) rows."""
    rows = []
    for key, value in results.items():
        name = f"{config}.{key}" if config else str(key)
        if isinstance(value, dict):
            rows += metrics_long(value, name)
        elif isinstance(value, int | float):
            rows.append((config, str(key), float(value)))
    return rows


def write_metrics(spark: SparkSession, results: dict, path: str, mode: str = "overwrite") -> None:
    """Nested metrics as one small long table."""
    spark.createDataFrame(metrics_long(results), "config string, metric string, value double").coalesce(1).write.mode(mode).json(path)


def first_rows(df: DataFrame, n: int, row_id: str = "row_id") -> DataFrame:
    """The first ``n`` rows in file order."""
    return df.orderBy(row_id).limit(n)


def first_facts(df: DataFrame, n: int, fact: str = "fact", row_id: str = "row_id") -> DataFrame:
    """All rows of the first ``n`` facts in file order."""
    kept = df.groupBy(fact).agg(F.min(row_id).alias("__first")).orderBy("__first").limit(n)
    return df.join(kept.select(fact), fact, "left_semi")


def config_record(spark: SparkSession, parameters: dict) -> DataFrame:
    """The parameters of a run as one (name, value) table to store beside its output."""
    rows = [(str(k), json.dumps(v, ensure_ascii=False)) for k, v in sorted(parameters.items())]
    return spark.createDataFrame(rows, "name string, value string")


def aligned(left: DataFrame, right: DataFrame, key: str = "row_id") -> DataFrame:
    """Positional alignment as a key join; a row missing on either side stops the job."""
    marked = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), key, "full_outer")
    both: Column = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    check = F.when(both, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("row on one side only: "), F.col(key).cast("string"))).cast("boolean"))
    return marked.where(check).drop("__l", "__r")

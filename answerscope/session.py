"""Session settings the operators rely on, and lineage cutting."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning does the size-checked broadcasts and the splitting of hot
# join keys; forcing the skew-join rule keeps it on under later aggregations.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def build_session(app_name: str = "answerscope", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python path may lack it; once per context."""
    context = spark.sparkContext
    if not getattr(context, "_answerscope_shipped", False):
        root = Path(__file__).resolve().parent
        packed = shutil.make_archive(f"{tempfile.mkdtemp(prefix='answerscope-')}/answerscope", "zip", root.parent, root.name)
        context.addPyFile(packed)
        context._answerscope_shipped = True


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    ship(spark)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder of ``spark.checkpoint.dir``.

    A temporary folder is used only where the setting is unset and the session is
    a local one, since a machine-local folder does not survive a lost executor.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="answerscope-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()

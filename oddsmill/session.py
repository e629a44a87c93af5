"""Session set-up and the one durable-cut helper used by the package."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "oddsmill", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # a static setting: call-site capture walks the stack once per expression, and plans here have thousands
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_runtime(spark: SparkSession) -> None:
    """All timestamps in the package are read as UTC wall time."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@lru_cache(maxsize=1)
def _local_scratch() -> str:
    """One temporary folder per process, for local sessions only; removed when the process ends."""
    root = tempfile.mkdtemp(prefix="oddsmill-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder that every executor can reach: under the cluster's shared ``spark.checkpoint.dir``. Only a local
    session without that setting gets a temporary folder of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{(shared or _local_scratch()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the input: sorted and merged by the executors.

    Spark sizes a stored table by its files, in which codes and repeats take little, and an exploded one by the rows before.
    It would broadcast rows of many times the threshold, and those pass whole through the driver."""
    return df.hint("merge")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    Cuts lineage, survives lost executors, and every later reader sees the same rows with the same values. A
    written table is computed once, where a checkpoint computes its last stage twice.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

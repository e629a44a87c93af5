"""Exact deduplication as a stateful stream: disk-backed keyed state without expiry, full bytes checked on hits."""

from __future__ import annotations

import re
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from oddsmill.session import durable, scratch_path

from .tables import ascii_lower, located, sized, without_rows

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Members of one group that meet one copy of its representative's text in a task.
GROUP_SLICE = 512


def sha256_digest(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


@contextmanager
def _disk_backed(spark: SparkSession):
    """The state store of streams started inside is RocksDB, without room set aside on disk for each small store, and with
    one bound on the memory of all stores of an executor."""
    prefix = "spark.sql.streaming.stateStore."
    wanted = {prefix + "providerClass": ROCKSDB, prefix + "rocksdb.allowFAllocate": "false", prefix + "rocksdb.boundedMemoryUsage": "true", prefix + "rocksdb.maxMemoryUsageMB": "100"}
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _entries(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """digest, body and entry (stable identifier, content locator) of each row; works on streams and on tables alike."""
    body = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    entry = F.struct(F.col(id_col).alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
    return docs.select(entry.alias("entry"), body.alias("body")).withColumn("digest", digest(F.col("body")))


def stream_groups(spark: SparkSession, path: str, schema, state_dir: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_digest, files_per_batch: int = 1000) -> DataFrame:
    """Run the stream over every file under ``path`` that ``state_dir`` has not seen, and return its state, one row per
    digest: ``digest, keep(doc_id, path, row), n``.

    The keyed state holds the digest, the largest identifier and where its content lies; it lives in RocksDB, never
    expires, and is kept under ``state_dir`` on shared storage: a restarted or later run goes on from there. Rows are
    combined before the shuffle, so a group of copies sends one row per task. Each micro-batch overwrites its own
    folder, so a repeated batch changes nothing."""
    source = re.sub(r"(\w)/*$", r"[\1]", path)  # as a pattern: a stream takes a folder or a pattern, and ``path`` may be one file
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    state = _entries(docs, id_col, text_col, digest).groupBy("digest").agg(F.max("entry").alias("keep"), F.count(F.lit(1)).alias("n"))
    out = f"{state_dir}/updates"

    def write(frame: DataFrame, batch: int) -> None:
        frame.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    with _disk_backed(spark):
        run = state.writeStream.outputMode("update").option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    shape = f"digest binary, keep struct<doc_id:{schema[id_col].dataType.simpleString()},path:string,row:bigint>, n bigint, batch bigint"
    return spark.read.schema(shape).parquet(out).groupBy("digest").agg(F.max_by(F.struct("keep", "n"), "batch").alias("last")).select("digest", "last.keep", "last.n")


def deduplicate(spark: SparkSession, path: str, state_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """Decide for every row of the Parquet files under ``path`` which row of its group of equal texts stays.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest identifier
    stays; of rows that share it, the one at the last place; a null identifier is below all others. Returns ``entry`` (identifier, path, row),
    ``keep`` (the same of the row that stays), ``group_size``, ``kept`` and ``digest``, one row per input row. Other
    columns of the input are not read. An empty table gives no rows.

    Digests only propose: the bytes of every row of a group are compared with those at the locator that the state
    holds, in slices of a group so that no task gets a whole one, and rows that differ are grouped again by their full
    text."""
    state_dir = state_dir or scratch_path(spark, "dedup")
    kinds = spark.read.parquet(path).schema
    schema = StructType([kinds[c] for c in dict.fromkeys((id_col, text_col))])  # no other column, whatever its name, is read
    batch = spark.read.schema(schema).parquet(path)
    groups = durable(stream_groups(spark, path, schema, state_dir, id_col, text_col, digest))
    copies = durable(groups.where("n > 1"))
    slices = F.ceil(F.col("n") / GROUP_SLICE).cast("int")
    hits = durable(_entries(batch, id_col, text_col, digest).join(sized(copies), "digest"))
    at = lambda c: F.struct(f"{c}.path", f"{c}.row")
    holders = hits.where(at("entry") == at("keep")).select("digest", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), F.col("body").alias("held"))
    hits = hits.withColumn("slice", F.pmod(F.xxhash64("entry.path", "entry.row"), slices).cast("int"))
    same = F.col("body") == F.col("held")
    checked = durable(hits.join(holders, ["digest", "slice"]).select("digest", "entry", "keep", "n", same.alias("same"), F.when(~same, F.col("body")).alias("body")))
    strays = checked.where(~F.col("same"))
    regrouped = strays.groupBy("body").agg(F.max("entry").alias("keep"), F.count(F.lit(1)).alias("group_size"))
    fewer = sized(durable(strays.groupBy("digest").agg(F.count(F.lit(1)).alias("away"))))  # empty, unless digests collide
    row = ["digest", "entry", "keep", "group_size"]
    parts = [
        groups.where("n = 1").select("digest", F.col("keep").alias("entry"), "keep", F.col("n").alias("group_size")),
        checked.where("same").join(fewer, "digest", "left").select("digest", "entry", "keep", (F.col("n") - F.coalesce("away", F.lit(0))).alias("group_size")),
        strays.drop("keep", "n").join(regrouped, "body").select(row),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("kept", at("entry") == at("keep"))


def kept_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows that ``deduplicate`` drops."""
    path = scratch_path(spark, "docs")
    docs.write.parquet(path)
    dropped = durable(deduplicate(spark, path).where(~F.col("kept")).select(F.struct("entry.path", "entry.row")))
    rows, at = located(spark.read.schema(docs.schema).parquet(path))
    return without_rows(rows, dropped, at)

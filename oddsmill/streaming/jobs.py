"""Incremental twins of the batch operators, as Structured Streaming jobs over file sources.

Every job runs with ``availableNow`` (process what is there, then stop), keeps its checkpoint in the shared
folder, and writes each micro-batch to its own ``batch=<id>`` partition in overwrite mode: a batch that is
retried after a lost executor replaces its own output instead of adding to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from oddsmill.functions import constants as K
from oddsmill.operators.ensemble import hedge_step, initial_weights
from oddsmill.operators.matching import outcome
from oddsmill.operators.snapshots import movement
from oddsmill.session import durable
from oddsmill.sources.files import scratch_path


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", max_files: int = 1000) -> DataFrame:
    """File source. ``max_files`` bounds a micro-batch, and with it what one key can bring into one task."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(path)


def _numbered(table: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return write


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str, checkpoint: str) -> None:
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


def materialise(spark: SparkSession, stream: DataFrame, mode: str, root: str | None = None) -> DataFrame:
    """Run to completion and return the written batches, with their number in ``batch``."""
    root = root or scratch_path(spark, "stream")
    table = f"{root}/out"
    run(stream, _numbered(table), mode, f"{root}/checkpoint")
    return spark.read.option("basePath", table).parquet(table)


# --- idempotent ingest ---------------------------------------------------------------------------------------
@contextmanager
def disk_backed(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, so a batch's cost follows the keys it brings, not all keys stored."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ingest(spark: SparkSession, landing: str, schema: StructType, keys: list[str], root: str, max_files: int = 1000) -> DataFrame:
    """One document per key, however often it lands. The state of a key is its first document: that of the file written first,
    and of several in files of one time the one with the smallest digest. So the choice is defined, and the same for any
    cut into batches. A batch meets the state of its own keys only and never reads the stored table; what it writes again
    under a known key replaces the same row."""
    docs = read_stream(spark, landing, schema, "json", max_files)
    landed = F.struct(F.col("_metadata.file_modification_time").alias("at"), F.sha2(F.to_json(F.struct(*schema.names)), 256).alias("digest"))
    first = docs.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in schema.names if c not in keys]), landed).alias("first"))
    with disk_backed(spark):
        written = materialise(spark, first, "update", root)
    return latest_updates(written, keys).select(*keys, "first.*")


# --- line movement with state ----------------------------------------------------------------------------------
def line_minima(lines: DataFrame) -> DataFrame:
    """Keyed state of the movement job: the lowest line of each key in each snapshot. A minimum does not depend on the
    order of rows, so a snapshot may be spread over micro-batches or arrive late."""
    return lines.groupBy("player_id", "stat_type", "snapshot_id").agg(F.min("line_score").alias("line_score"))


def line_moves(minima: DataFrame, previous: DataFrame) -> DataFrame:
    """Movement of every key against its line in the snapshot before (``previous``: snapshot_id, prev_snapshot_id), from
    the stored state; a key that was not in that snapshot is new."""
    before = minima.select("player_id", "stat_type", F.col("snapshot_id").alias("prev_snapshot_id"), F.col("line_score").alias("prev_line"))
    moved = minima.join(previous, "snapshot_id").join(before, ["player_id", "stat_type", "prev_snapshot_id"], "left")
    return moved.withColumn("movement", movement(F.col("line_score"), F.col("prev_line")))


# --- online weights ------------------------------------------------------------------------------------------
def online_hedge(spark: SparkSession, rows: DataFrame, experts: list[str], time: str = "decision_time", late: str | None = None, root: str | None = None) -> DataFrame:
    """Weights per context updated as outcomes arrive: ``id, ctx, n, p_hedge, w_*`` of each of ``rows(id, ctx, over_label, time, experts)``.

    The step size decays with the context's own update count (the batch replay counts over all contexts). A row is folded
    once the newest time seen is ``late`` ahead of it, and until then kept in a table, so any order of arrival within
    ``late`` gives the same result; without ``late`` rows are folded when the input ends. Each micro-batch writes its own
    folders. A context's rows are sorted by Spark and folded as a stream, an Arrow batch at a time."""
    root = root or scratch_path(spark, "hedge")
    names = [f"w_{e}" for e in experts]
    weights = ", ".join(f"{c} double" for c in names)
    shape = f"id bigint, ctx string, n bigint, p_hedge double, {weights}"
    caps, start, columns = [K.WEIGHT_CAP] * len(experts), initial_weights(experts), [time, "id", "ctx", "over_label", *experts]
    batches: list[int] = []

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a context follow its state, if it has one; its new state (without id) comes behind its rows."""
        ctx, w, n = None, start, 0
        for part in parts:
            out = []
            for row in part.to_pylist():
                if row["ctx"] != ctx:
                    out += [(None, ctx, n, None, *w)] if ctx is not None else []
                    ctx, w, n = row["ctx"], start, 0
                if row["id"] is None:
                    w, n = [row[c] for c in names], row["n"]
                else:
                    n += 1
                    pred, w = hedge_step(w, [row[e] for e in experts], int(row["over_label"]), K.ETA / (1 + K.ETA_DECAY * n), caps)
                    out.append((row["id"], ctx, n, pred, *w))
            yield _table(out)
        yield _table([(None, ctx, n, None, *w)] if ctx is not None else [])

    def _table(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), *[pa.float64()] * (1 + len(names))]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["id", "ctx", "n", "p_hedge", *names])

    def before(batch_id: int, table: str, like: str) -> DataFrame:
        """What the batch before has left (a first batch finds nothing)."""
        return spark.read.schema(like).parquet(f"{root}/{table}/batch={batch_id - 1}") if batch_id else spark.createDataFrame([], like)

    def step(batch: DataFrame, batch_id: int, last: bool) -> None:
        like = batch.select(columns).schema
        waiting = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like)
        here = durable(batch.select(columns).unionByName(before(batch_id, "waiting", waiting)))
        due = F.lit(last)
        if late and not last:
            clock = here.agg(F.max(time)).first()[0]
            clock = max(c for c in (clock, *(spark.read.parquet(f"{root}/clock/batch={batch_id - 1}").first() if batch_id else ())) if c is not None) if batch_id or clock is not None else None
            here.limit(0).agg(F.lit(clock).cast(like[time].dataType).alias("clock")).write.mode("overwrite").parquet(f"{root}/clock/batch={batch_id}")
            due = F.coalesce(F.col(time) <= F.lit(clock).cast(like[time].dataType) - F.expr(f"interval {late}"), F.lit(False))
        here.filter(~due).write.mode("overwrite").parquet(f"{root}/waiting/batch={batch_id}")
        state = before(batch_id, "weights", f"ctx string, n bigint, {weights}")
        known = here.filter(due).unionByName(state, allowMissingColumns=True)
        sorted_rows = known.repartition("ctx").sortWithinPartitions("ctx", F.col("id").isNotNull(), time, "id")
        folded = durable(sorted_rows.mapInArrow(fold, shape))
        folded.filter("id IS NOT NULL").write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")
        folded.filter("id IS NULL").select("ctx", "n", *names).write.mode("overwrite").parquet(f"{root}/weights/batch={batch_id}")
        batches.append(batch_id)

    run(rows, lambda batch, batch_id: step(batch, batch_id, False), "append", f"{root}/checkpoint")
    if batches:
        step(rows_like(spark, rows), max(batches) + 1, True)
    return spark.read.schema(shape).option("basePath", f"{root}/out").parquet(f"{root}/out") if batches else spark.createDataFrame([], shape)


def rows_like(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """An empty table of the stream's columns."""
    return spark.createDataFrame([], stream.schema)


# --- outcomes after decisions ------------------------------------------------------------------------------------
def resolve(spark: SparkSession, decisions: DataFrame, outcomes: DataFrame, lag: str = "3 hours", horizon: str = "21 days", late: str = "36 hours", root: str | None = None) -> DataFrame:
    """Labels of streamed ``decisions(id, key, line_score, pick, decision_time)`` from ``outcomes(key, value, outcome_time)``: one row
    per decision that is settled, ``id, decision_time, outcome_time, actual_value, outcome, over_label, is_correct, forced_push``.

    An outcome counts from ``lag`` to ``horizon`` after the decision and is graded as it arrives; of several the earliest
    stays the label, of equally early ones the smallest, whatever their order of arrival. When the horizon has passed without
    a value, state gives the decision up: it is a push at the line if outcomes without a value show that the game took place,
    else ``unresolved``. Decisions whose horizon is still open are left out. Rows later than ``late`` behind the newest are
    dropped, as in any watermarked join, and state is dropped with the horizon."""
    root = root or scratch_path(spark, "labels")
    inside = (F.col("outcome_time") >= F.col("decision_time") + F.expr(f"interval {lag}")) & (F.col("outcome_time") <= F.col("decision_time") + F.expr(f"interval {horizon}"))
    d = decisions.withWatermark("decision_time", late)
    o = outcomes.withColumnRenamed("key", "_key").withWatermark("outcome_time", late)
    met = (F.col("key") == F.col("_key")) & inside
    settled = d.join(o.filter("value IS NOT NULL"), met, "leftOuter").select("id", "line_score", "pick", "decision_time", "outcome_time", "value")
    played = decisions.select("id", "key", "decision_time").withWatermark("decision_time", late).join(o.filter("value IS NULL"), met).select("id")
    labels = materialise(spark, settled, "append", f"{root}/settled")
    void = materialise(spark, played, "append", f"{root}/played").select("id").distinct().withColumn("_void", F.lit(True))
    first = labels.groupBy("id").agg(F.min(F.when(F.col("value").isNotNull(), F.struct("outcome_time", "value"))).alias("_first"), *[F.max(c).alias(c) for c in ("line_score", "pick", "decision_time")])
    first = first.join(void, "id", "left").withColumn("forced_push", F.col("_first").isNull() & F.coalesce("_void", F.lit(False)) & F.col("line_score").isNotNull())
    actual = F.when(F.col("forced_push"), F.col("line_score")).otherwise(F.col("_first.value"))
    graded = first.select("id", "decision_time", F.col("_first.outcome_time").alias("outcome_time"), "line_score", "pick", "forced_push", actual.alias("actual_value"))
    result = F.when(F.col("forced_push"), "push").otherwise(F.coalesce(outcome(F.col("actual_value"), F.col("line_score")), F.lit("unresolved")))
    side = F.lower("pick")
    return graded.withColumn("outcome", result).select(
        "id", "decision_time", "outcome_time", "actual_value", "outcome", F.when(F.col("outcome") == "over", 1).when(F.col("outcome") == "under", 0).alias("over_label"),
        F.when(F.col("outcome").isin("over", "under") & side.isin("over", "under"), side == F.col("outcome")).alias("is_correct"), "forced_push")


# --- health counters ---------------------------------------------------------------------------------------------
def window_counts(log: DataFrame, width: str = "24 hours", late: str = "24 hours") -> DataFrame:
    e = F.col("event")
    n = lambda kind: F.sum((e == kind).cast("bigint"))
    return log.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "source").agg(
        n("request_end").alias("requests"), n("request_error").alias("errors"), n("cache_hit").alias("cache_hits"), n("cache_miss").alias("cache_misses")
    ).select(F.col("w.start").alias("window_start"), "source", "requests", "errors", "cache_hits", "cache_misses")


def latest_updates(written: DataFrame, keys: list[str]) -> DataFrame:
    """Update mode writes a group again whenever it changes: keep the row of the last batch."""
    rest = [c for c in written.columns if c not in keys and c != "batch"]
    return written.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("m")).select(*keys, *[f"m.{c}" for c in rest])

"""Sinks: what they compute and what they leave on disk."""

from pyspark.sql import functions as F

from oddsmill.plans import q_streaming as Q
from oddsmill.sources import files as FL


def test_rows_of_both_files_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def counted(i):
        seen.add(1)
        return i

    rows = spark.range(20).select(counted("id").alias("id"), F.array(F.lit("a"), F.lit('b"c')).alias("names"))
    jsonl, csv = FL.write_tables(rows, str(tmp_path / "out"))
    assert seen.value == 20
    back = spark.read.option("header", True).option("escape", '"').csv(csv)
    assert sorted((int(r.id), r.names) for r in back.collect()) == [(i, '["a","b\\"c"]') for i in range(20)]
    assert sorted(r.id for r in spark.read.json(jsonl).collect()) == list(range(20))


class Orders:
    def __init__(self, spark):
        self.spark = spark

    def line_snapshots(self):
        return self.spark.range(60).select((F.col("id") % 3 + 100).alias("snapshot_id"), (F.col("id") % 7).alias("player_id"), F.lit("1-URGENT").alias("stat_type"), F.lit(5.0).alias("line_score")).distinct()


def test_documents_land_twice_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "scratch_path", lambda spark, name: str(tmp_path / name))
    got = {r.snapshot_id: r.docs for r in Q.st_snapshot_ingest(Orders(spark)).collect()}
    assert got == {100: 7, 101: 7, 102: 7}
    first, again = (spark.read.json(str(tmp_path / "ingest/landing" / n)) for n in ("first", "again"))
    assert first.count() == again.count() == 21 and first.exceptAll(again).count() == 0
    files = [p.name for p in (tmp_path / "ingest/landing").rglob("part-*")]
    assert files and all(n.endswith(".json.gz") for n in files)

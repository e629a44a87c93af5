import datetime as dt

import pytest
from pyspark.sql import functions as F

from oddsmill.plans import q_reports as Q

SHAPE = "id bigint, decision_time timestamp, p_final double, line_score double, n_eff double, actual_value double"
END = dt.datetime(2024, 6, 30)


def log(spark, per_day, days=60, bad_after=None, first=0):
    """One row per hour slot: right picks, or wrong ones in the last ``bad_after`` days."""
    rows = []
    for d in range(first, days):
        for k in range(per_day):
            wrong = bad_after is not None and d < bad_after
            rows.append((len(rows), END - dt.timedelta(days=d, minutes=k), 0.97 if not wrong else 0.03, 10.0 + k, float(k), 30.0 + k))
    return spark.createDataFrame(rows, SHAPE)


@pytest.mark.parametrize("per_day,days,first,late,mode,status", [
    (20, 60, 0, 0, "time_window", "ok"),
    (20, 60, 0, 3, "time_window", "stale_data"),
    (4, 120, 0, 0, "row_fallback", "ok"),
    (4, 6, 0, 0, "time_window", "invalid_baseline"),
    (0, 60, 0, 0, None, "insufficient_data"),
])
def test_windows_and_status(spark, per_day, days, first, late, mode, status):
    rows = Q.drift_windows(log(spark, per_day, days, first=first))
    now = F.lit(END + dt.timedelta(days=late)).cast("timestamp")
    got = Q.report_status(Q.drift_checks(rows), rows, now).collect()
    assert len(got) == (3 if mode else 2)   # an empty log has no calibration to check
    assert {(r["window_mode"], r["status"]) for r in got} == {(mode, status)}
    if mode == "row_fallback":   # equal halves of the newest rows
        sizes = {r["is_base"]: r["count"] for r in rows.groupBy("is_base").count().collect()}
        assert sizes == {True: 200, False: 200}
        newest = rows.groupBy("is_base").agg(F.min("decision_time").alias("lo"), F.max("decision_time").alias("hi")).collect()
        spans = {r["is_base"]: r for r in newest}
        assert spans[True]["hi"] < spans[False]["lo"]


def test_drift_is_found_and_lone_distribution_drift_is_advisory_in_fallback(spark):
    rows = Q.drift_windows(log(spark, 20, bad_after=8))
    got = {r["check_type"]: r for r in Q.report_status(Q.drift_checks(rows), rows, F.lit(END)).collect()}
    assert got["performance"]["is_drifted"] and got["performance"]["actionable"] and got["performance"]["status"] == "drift_detected"
    moved = log(spark, 4, 120).withColumn("line_score", F.when(F.col("id") < 200, F.col("line_score") - 8).otherwise(F.col("line_score")))
    rows = Q.drift_windows(moved)
    now = Q.drift_checks(rows).filter("check_type <> 'calibration'")
    got = {r["check_type"]: r for r in Q.report_status(now, rows, F.lit(END)).collect()}
    assert got["distribution"]["is_drifted"] and not got["distribution"]["actionable"] and got["distribution"]["window_mode"] == "row_fallback"
    assert got["distribution"]["status"] == "ok"

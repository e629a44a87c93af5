"""Priors as of a slate: what each slate may know, and nothing of what comes after."""

import datetime as dt
import random

from oddsmill.operators import calibration as CAL

SHAPE = "stat_type string, slate date, line_score double, over_label int"
FIT = ["stat_type", "n", "global_prior", "stat_prior", "e1", "e2", "bucket0", "bucket1", "bucket2"]


def lines(seed=4, days=9, rows=900):
    rng = random.Random(seed)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(days))
    return [(rng.choice("aaabc"), day(), rng.choice([None, 4.5, 5.5, 5.5, 7.5, 9.5]), rng.randrange(2)) for _ in range(rows)]


def priors(spark, rows):
    df = spark.createDataFrame(rows, SHAPE)
    return {(r.stat_type, r.slate): r for r in CAL.priors_as_of(df, df).collect()}


def test_each_cut_is_the_fit_on_earlier_days(spark):
    rows = lines()
    got = priors(spark, rows)
    assert len(got) == len({r[:2] for r in rows})
    for cut in sorted({r[1] for r in rows}):
        past = [r for r in rows if r[1] < cut]
        fit = CAL.fit_context_priors(spark.createDataFrame(past, SHAPE)).collect() if past else []
        want = {r.stat_type: r for r in fit}
        for (stat, day), r in got.items():
            if day == cut and stat in want:
                assert [r[c] for c in FIT] == [want[stat][c] for c in FIT], (stat, day)
            elif day == cut:
                assert r.n == 0 and r.e1 is None and r.stat_prior == r.global_prior


def test_future_outcomes_change_no_earlier_slate(spark):
    rows = lines()
    cut = dt.date(2024, 1, 6)
    turned = [(s, d, None if d >= cut and line == 9.5 else line, 1 - y if d >= cut else y) for s, d, line, y in rows]
    a, b = priors(spark, rows), priors(spark, turned)
    early = [k for k in a if k[1] <= cut]
    assert early and all(a[k] == b[k] for k in early) and any(a[k] != b[k] for k in a if k[1] > cut)
    df = spark.createDataFrame(rows, SHAPE)
    out = CAL.context_prior_as_of(df, CAL.priors_as_of(df, df)).collect()
    assert len(out) == len(rows) and all(r.context_prior == 0.5 for r in out if r.slate == dt.date(2024, 1, 1))

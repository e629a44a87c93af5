"""Registry of measures: a normalised name maps to a sum, a difference or a weighted sum of stored columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import c, num

# Measures that are sums of stored columns.
SUMS = {
    "points": ["points"], "rebounds": ["rebounds"], "offensiverebounds": ["oreb"],
    "defensiverebounds": ["dreb"], "assists": ["assists"], "steals": ["steals"], "blocks": ["blocks"],
    "blockedshots": ["blocks"], "turnovers": ["turnovers"], "personalfouls": ["pf"],
    "3ptmade": ["fg3m"], "3pt": ["fg3m"], "fg3m": ["fg3m"], "3ptattempted": ["fg3a"], "fg3a": ["fg3a"],
    "fgmade": ["fgm"], "fgm": ["fgm"], "fgattempted": ["fga"], "fga": ["fga"],
    "freethrowsmade": ["ftm"], "ftm": ["ftm"], "freethrowsattempted": ["fta"], "fta": ["fta"],
    "ptsrebs": ["points", "rebounds"], "ptsasts": ["points", "assists"], "rebsasts": ["rebounds", "assists"],
    "ptsrebsasts": ["points", "rebounds", "assists"], "pra": ["points", "rebounds", "assists"],
    "blkstl": ["blocks", "steals"], "stlblk": ["blocks", "steals"], "blksstls": ["blocks", "steals"],
    "pointscombo": ["points"], "reboundscombo": ["rebounds"], "assistscombo": ["assists"],
    "3ptmadecombo": ["fg3m"], "offensivereboundscombo": ["oreb"], "defensivereboundscombo": ["dreb"],
    "personalfoulscombo": ["pf"], "dunks": ["dunks"],
}
# First column minus second column.
DIFFERENCES = {"twopointersmade": ("fgm", "fg3m"), "twopointersattempted": ("fga", "fg3a")}
# Weighted sum.
WEIGHTED = {
    "fantasyscore": {
        "points": 1.0, "rebounds": 1.2, "assists": 1.5, "steals": 3.0, "blocks": 3.0, "turnovers": -1.0,
    },
}


def measure_key(x) -> Column:
    """Lower case, letters and digits only; empty becomes null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c(x))), "[^a-z0-9]", ""), F.lit(""))


def _recipe(key: str) -> list[tuple[str, float]]:
    if key in DIFFERENCES:
        plus, minus = DIFFERENCES[key]
        return [(plus, 1.0), (minus, -1.0)]
    if key in WEIGHTED:
        return list(WEIGHTED[key].items())
    return [(name, 1.0) for name in SUMS.get(key, [])]


def supported_keys(available: list[str] | None = None) -> list[str]:
    keys = [*SUMS, *DIFFERENCES, *WEIGHTED]
    if available is None:
        return keys
    return [k for k in keys if all(name in available for name, _ in _recipe(k))]


def measure_column(key: str, missing_as_zero: bool = False) -> Column:
    """Value of one measure; null when any part is null unless ``missing_as_zero``."""
    def part(name: str, weight: float) -> Column:
        value = F.col(name).cast("double")
        value = F.coalesce(value, num(0)) if missing_as_zero else value
        return value if weight == 1.0 else value * num(weight)

    return reduce(lambda a, b: a + b, [part(n, w) for n, w in _recipe(key)])


def measure_value(stat, available: list[str], missing_as_zero: bool = False) -> Column:
    """Value of the measure named in a column, over the stored columns that exist."""
    key = measure_key(stat)
    out = F.lit(None).cast("double")
    branches = [(k, measure_column(k, missing_as_zero)) for k in supported_keys(available)]
    if not branches:
        return out
    chain = None
    for k, value in branches:
        chain = F.when(key == k, value) if chain is None else chain.when(key == k, value)
    return chain

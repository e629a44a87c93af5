"""Catalogue of registered queries: a name, a DataFrame plan and, where SQL can say it, the SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .adapters import Tables


@dataclass(frozen=True)
class Entry:
    plan: Callable[[Tables], DataFrame]
    sql: str | None


CATALOGUE: dict[str, Entry] = {}

# Families whose plans read the game log three times or more.
READS_LOG_OFTEN = (
    "win_hist", "win_opp", "win_pace", "fc_", "lab_resolve", "lab_update", "lab_backtest", "cal_gauss", "cal_pit", "cal_dist", "qual_preflight", "join_training",
    "pol_publish", "pol_adaptive", "pol_spread", "pol_diverse", "pol_imbalance", "pol_soft", "pol_score", "ens_lr", "ens_gbt", "ens_oof", "ens_importance",
)


def query(name: str, sql: str | None = None):
    def register(plan: Callable[[Tables], DataFrame]):
        if name in CATALOGUE:
            raise ValueError(f"query {name} is registered twice")
        CATALOGUE[name] = Entry(plan, sql)
        return plan

    return register


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = Tables(spark, sf_dir)
        return CATALOGUE[name].plan(tables.pin_game_log() if name.startswith(READS_LOG_OFTEN) else tables)

    return run

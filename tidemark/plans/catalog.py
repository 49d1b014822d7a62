"""All queries over the time-series operators, by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import adaptive, builds, composites, events, exports, files, filtering, fits, greedy, recordings, repairs, rotations, rules, series, sessions, verification

MODULES = [series, events, repairs, rotations, filtering, greedy, recordings, composites, sessions, adaptive, builds, fits, files, rules, exports, verification]
FLAGSHIP = "flagship_unconfirmed_jumps"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}

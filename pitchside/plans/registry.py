"""Every query of the library proper with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitchside.plans import desk_suite, entity_suite, feed_suite, import_suite, leaders, league_suite, merge_suite, page_suite, reports, suite, sync_suite, text_suite

MODULES = [leaders, suite, reports, league_suite, entity_suite, text_suite, feed_suite, page_suite, merge_suite, sync_suite, import_suite, desk_suite]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}

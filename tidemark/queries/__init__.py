"""Named queries of the library over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.queries import aggregates, bookkeeping, courts, decoding, jobs, joins, labelling, live, motions, points, sequences

_MODULES = (sequences, joins, aggregates, decoding, bookkeeping, jobs, live, motions, points, labelling, courts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}

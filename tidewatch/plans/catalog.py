"""All registered queries of the engine and their SQL twins.

The tables are analogues of the engine's own data: an order is a card, its line items are the evidence and their suppliers
the origins; a document is a candidate (odd id) or a ledger row (even id); an event of type view is a pull, a
purchase is a contribution and its value the engagement; a customer is a roster entry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "q_confidence_score"
_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with its SQL twin if it has one."""

    def add(f):
        _FOUND[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    from tidewatch.plans import archives, audit, cards, feeds, guards, matching, ranking, runs, trees, yields  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}

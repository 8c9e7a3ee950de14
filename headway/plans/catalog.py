"""Registry of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from headway.plans.stand_ins import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COMMON: dict[str, tuple[tuple[str, ...], str]] = {}


def common(name: str, sql: str, *needs: str) -> None:
    """Register a named WITH entry for the SQL side."""
    COMMON[name] = (needs, sql)


def _with(names, seen: list[str]) -> list[str]:
    for n in names:
        if n not in seen:
            _with(COMMON[n][0], seen)
            seen.append(n)
    return seen


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Register a query over :class:`Tables`; ``sql`` may use the WITH entries in ``needs``, put where it says {entries}."""
    def add(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            entries = ",\n".join(f"{n} AS ({COMMON[n][1]})" for n in _with(needs, []))
            SQL[name] = sql.replace("{entries}", f"{entries},") if "{entries}" in sql else (f"WITH {entries}\n" if entries else "") + sql
        return fn
    return add


def load() -> None:
    from headway.plans import catalog_archive, catalog_contacts, catalog_grants, catalog_images  # noqa: F401
    from headway.plans import catalog_mart, catalog_posts, catalog_review, catalog_usage  # noqa: F401

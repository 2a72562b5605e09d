"""Every query of the library by name, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import delivered, driver  # noqa: F401: adds its queries to those of driver


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(driver.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(driver.SQL)

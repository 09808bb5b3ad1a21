"""All registered queries of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lintlake.plans import blocks, filters, findings, history, packages, reports, scans, search, streams  # noqa: F401  they fill the register
from lintlake.plans.base import REGISTER, Source


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Source(spark, sf_dir))) for name, (f, _) in REGISTER.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTER.items() if sql}

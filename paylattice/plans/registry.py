"""Query registry: name -> (DataFrame job over the test tables, SQL for the check)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import Tables, with_views

JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register a job ``Tables -> DataFrame``; ``sql`` may use the named views."""

    def add(job: Callable[[Tables], DataFrame]):
        if name in JOBS:
            raise ValueError(f"{name} is registered twice")
        JOBS[name] = lambda spark, sf_dir: job(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_views(views, sql)
        return job

    return add

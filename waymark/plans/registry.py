"""Registry of the runnable queries and, where SQL can express them, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymark.sources import sample

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The sample tables of one folder, read on first use: ``t.locations``, ``t.clusters`` ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = sample.load(self.spark, self.sf_dir, name)
        setattr(self, name, df)
        return df


def register(name: str, sql: str | None = None, views: str = "", extra: str = "", recursive: bool = False):
    """Register a job. ``views`` names the sample views its SQL reads, ``extra`` adds more ``WITH`` parts."""

    def wrap(job: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: job(Tables(spark, sf_dir))
        if sql is not None:
            parts = ", ".join(p for p in (sample.with_views(*views.split()), extra) if p)
            SQL[name] = (f"with {'recursive ' if recursive else ''}{parts} " if parts else "") + sql
        return job

    return wrap

"""Collects the registered queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .views import view, with_views

QueryFn = Callable[[SparkSession, str], DataFrame]


class Views:
    """Lazy access to the derived views: ``v.service`` is ``v_service``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = view(self.spark, self.sf_dir, f"v_{name}")
        return self._made[name]


@dataclass
class Registry:
    queries: dict[str, QueryFn] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, key: str, views: str = "", sql: str | None = None):
        """Register the decorated ``fn(Views) -> DataFrame`` with its optional SQL."""

        def wrap(fn):
            if key in self.queries:
                raise ValueError(f"duplicate key {key}")
            self.queries[key] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
            if sql is not None:
                self.sql[key] = with_views(views, sql)
            return fn

        return wrap

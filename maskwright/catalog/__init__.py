"""Registry of named queries: a Spark function and, where SQL can say it, the SQL of the check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession, functions as F

from maskwright.plans.fixtures import Tables, with_ctes


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    doubles: str

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Tables(spark, sf_dir))
        for c in self.doubles.split():
            df = df.withColumn(c, F.round(F.col(c), 9) + F.lit(0.0))
        return df


REGISTRY: dict[str, Query] = {}
MODULES = ("masks", "matching", "rules", "scores", "data", "reviewing", "images", "skies", "files")


def query(name: str, sql: str | None = None, doubles: str = "", ctes: dict[str, str] | None = None):
    """Register a query. ``doubles`` names columns rounded to nine digits on both sides."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        text = with_ctes(sql, doubles, ctes) if sql else None
        REGISTRY[name] = Query(name, build, text, doubles)
        return build

    return add


def load() -> dict[str, Query]:
    for m in MODULES:
        import_module(f"maskwright.catalog.{m}")
    return REGISTRY

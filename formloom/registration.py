"""How a query enters the catalogue, and the driver's tables it reads."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


CATALOGUE: dict[str, Query] = {}


def query(oracle: str | None = None):
    """Registers a function of (spark, sf_dir) under its own name."""

    def register(build):
        CATALOGUE[build.__name__] = Query(build, oracle)
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Where files are and how a session reads tables; no secrets."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Folders of a run; each may come from a variable ``TICKLOOM_<NAME>``."""

    save_folder: str = "data"
    query_folder: str = "queries"
    model_folder: str = "models"

    @staticmethod
    def from_environment(environment=os.environ) -> Settings:
        found = {f.name: environment.get(f"TICKLOOM_{f.name.upper()}") for f in fields(Settings)}
        return Settings(**{n: v for n, v in found.items() if v})


def with_catalog(builder: SparkSession.Builder, name: str, implementation: str, warehouse: str, **options: str) -> SparkSession.Builder:
    """The builder with a catalog: its class, warehouse and further options (such as its type or file IO)."""
    builder = builder.config(f"spark.sql.catalog.{name}", implementation).config(f"spark.sql.catalog.{name}.warehouse", warehouse)
    for key, value in options.items():
        builder = builder.config(f"spark.sql.catalog.{name}.{key.replace('_', '-')}", value)
    return builder


def scan(spark: SparkSession, table: str):
    """A table of a catalog by name, or a Parquet folder by path."""
    return spark.read.parquet(table) if "/" in table else spark.table(table)

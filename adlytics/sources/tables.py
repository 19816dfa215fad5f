"""Access to the parquet tables of one data directory.

Tables are read lazily with ``spark.read.parquet``; Catalyst prunes columns
and pushes filters into the scan, so a view that needs two columns of
``lineitem`` reads two columns.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return os.path.join(self.sf_dir, f"{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLE_NAMES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(self.path(name))
        return self._cache[name]

    def register(self) -> None:
        """Expose every table as a temp view for ``spark.sql``."""
        for n in TABLE_NAMES:
            if os.path.exists(self.path(n)):
                getattr(self, n).createOrReplaceTempView(n)


def load_tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)

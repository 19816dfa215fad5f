"""Registry of queries: Spark builder + DuckDB oracle + float rounding.

Every registered query is a function ``(spark, sf_dir) -> DataFrame``.  Float
columns listed in ``floats`` are rounded on both sides before comparison, since
the last bits of a floating sum depend on the summation order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlytics.oracle.views import rounded
from adlytics.sources.views import Views

_VIEWS: dict[tuple[str, str], Views] = {}


def views_for(spark: SparkSession, sf_dir: str) -> Views:
    # views of a session that has stopped must not come back
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _VIEWS:
        _VIEWS[key] = Views(spark, sf_dir)
    return _VIEWS[key]


def round_half_away(c, d: int):
    """round(x * 10^d) / 10^d on the scaled double (ties away from zero),
    identical in Spark and DuckDB; negative zero becomes zero."""
    scale = float(10 ** d)
    return F.round(c.cast("double") * F.lit(scale), 0) / F.lit(scale) + F.lit(0.0)


@dataclass
class Query:
    name: str
    build: Callable[[Views], DataFrame]
    oracle: str | None = None
    floats: dict[str, int] = field(default_factory=dict)
    note: str = ""

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(views_for(spark, sf_dir))
        if self.floats:
            df = df.withColumns({c: round_half_away(F.col(c), d) for c, d in self.floats.items()})
        return df

    def oracle_sql(self) -> str | None:
        if self.oracle is None:
            return None
        return rounded(self.oracle, self.floats)


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None = None, floats: dict[str, int] | None = None,
             note: str = ""):
    def deco(fn: Callable[[Views], DataFrame]):
        REGISTRY[name] = Query(name, fn, oracle, dict(floats or {}), note)
        return fn
    return deco


def all_queries() -> dict[str, Query]:
    # Import the plan modules so that their @register calls run.
    from adlytics.plans import (  # noqa: F401
        experiment, delay, feed, bidding, cpc, installs, cases, revenue, keywords, bayes_ab,
        resampling, fits, forecast,
    )
    return REGISTRY

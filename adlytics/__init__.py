"""adlytics — marketing, A/B-test and revenue analytics on Spark.

Layout
------
sources/    table loading, stand-in views, delimited-text readers/writers
functions/  Column-level helpers (SQL dialect differences, special functions,
            hash-based random draws)
operators/  reusable DataFrame operators (windows, reshape, statistics,
            resampling, regression, curve fitting, Bayesian A/B, forecasting)
plans/      the end-to-end analyses, one function per query
oracle/     independent DuckDB SQL for the same queries (correctness gate)
llm/        training-data operators (optional; nothing else imports them)
"""

from adlytics.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]

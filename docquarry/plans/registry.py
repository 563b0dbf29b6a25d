"""All queries of the engine by name, with the training-data operators only where their folder is present."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
ROOT = str(Path(__file__).resolve().parents[2])


def shipped(query: Query) -> Query:
    """``query`` with this package on the import path of the Python workers."""

    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
        if ROOT not in paths:
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, *paths]))
        return query(spark, folder)

    return run

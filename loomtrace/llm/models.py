"""Fitted models kept between sessions.

``fitted`` fits a model, or loads it where an earlier session stored it. The folder is the session's setting
``spark.loomtrace.models``, a place all of the cluster can see; without that setting every call fits anew. A stored
model is used for any later input, so the same text gets the same result however large the table around it is.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

from pyspark.sql import SparkSession

FOLDER = "spark.loomtrace.models"


def save(spark: SparkSession, path: str, model: object) -> None:
    """Store a model as a table of one row; a stored one is replaced."""
    spark.createDataFrame([(bytearray(pickle.dumps(model)),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> object | None:
    """The model stored at a path, or None where there is none."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.parquet(path).first()
    except AnalysisException:
        return None
    return pickle.loads(bytes(row.model)) if row is not None else None


def fitted(spark: SparkSession, name: str, fit: Callable[[], object]) -> object:
    folder = spark.conf.get(FOLDER, None)
    if not folder:
        return fit()
    path = f"{folder.rstrip('/')}/{name}"
    model = load(spark, path)
    if model is None:
        model = fit()
        save(spark, path, model)
    return model

"""The package itself, for executors that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors' Python, once for an application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    top = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="linkloom-"), "linkloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(path)
    _sent.add(context.applicationId)


def shipped(f: Callable) -> Callable:
    """f(spark, ...) after the package has been sent."""

    @wraps(f)
    def run(spark: SparkSession, *args, **kwargs):  # noqa: ANN002, ANN003, ANN202
        ship(spark)
        return f(spark, *args, **kwargs)

    return run

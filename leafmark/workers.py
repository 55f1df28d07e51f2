"""Python workers import this package from where the driver has it."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def find_us(spark: SparkSession) -> None:
    """Add the package's folder to the workers' path, unless it is there. On a cluster the
    package is installed, or its folder shared."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)

"""How Python workers find the library."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

TOP = str(Path(__file__).resolve().parents[1])


def reach(spark: SparkSession) -> None:
    """Lets workers import the library from where the driver has it, whatever folder either runs in.

    Where executors do not have that path, ship the package with ``--py-files``.
    """
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if TOP not in known:
        env["PYTHONPATH"] = os.pathsep.join([TOP, *known])

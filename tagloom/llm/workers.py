"""Let Python workers of a local session import this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def reach(spark: SparkSession) -> None:
    """Put the repository on the path of a local session's workers.

    On a cluster the package is installed or given with ``--py-files`` or
    ``PYTHONPATH``, as for any other job; nothing is changed there.
    """
    context = spark.sparkContext
    paths = context.environment.get("PYTHONPATH", "").split(os.pathsep)
    if context.master.startswith("local") and ROOT not in paths:
        context.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])

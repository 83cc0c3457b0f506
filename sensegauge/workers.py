"""Python workers find this package where the driver found it, if it is there; else ship it with --py-files."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark import SparkContext


def reach() -> None:
    """Puts the package's place on the workers' path. To be called before a function that Python workers run is made."""
    environment, root = SparkContext._active_spark_context.environment, str(Path(__file__).resolve().parents[1])
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])

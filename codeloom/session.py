"""Makes the package importable on executors that do not have it on their path."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors once per application.

    Executors on this machine share PYTHONPATH and the working folder with the driver, so one of these that has the package
    will do; those of a cluster share neither.
    """
    root = Path(__file__).resolve().parent.parent
    reachable = [Path(p).resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    context = spark.sparkContext
    here = context.master.startswith("local") and root in reachable
    if here or context.applicationId in _shipped or not (root / "codeloom").is_dir():
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='package-')}/codeloom", "zip", root, "codeloom")
    context.addPyFile(archive)
    _shipped.add(context.applicationId)

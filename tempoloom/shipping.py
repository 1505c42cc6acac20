"""Sends the package to Python workers that couldn't import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Once for each context; nothing where PYTHONPATH or the working folder, which workers inherit, has the package."""
    sc = spark.sparkContext
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if getattr(sc, "_tempoloom_shipped", False) or str(ROOT) in {os.path.realpath(p) for p in known if p}:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tempoloom-"), "tempoloom.zip")  # on the driver, which serves it to all
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((ROOT / "tempoloom").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(path)
    sc._tempoloom_shipped = True

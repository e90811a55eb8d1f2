"""What a Spark session needs for this library's Python functions to run on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ensure_importable(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once a context, unless they find it by themselves."""
    sc = spark.sparkContext
    if getattr(sc, "_eventloom_sent", False):
        return spark
    sc._eventloom_sent = True
    paths = [os.path.abspath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)] if os.environ.get("PYTHONPATH") else []
    if str(ROOT) not in [*paths, os.getcwd()]:
        folder = tempfile.mkdtemp(prefix="eventloom-package-")
        name = os.path.join(folder, "eventloom_package.zip")
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted((ROOT / "eventloom").rglob("*.py")):
                z.write(f, f.relative_to(ROOT))
        sc.addPyFile(name)
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path that Spark reads."""
    return ensure_importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")

"""Sends the package to Python workers that would not find it by themselves."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session's Python files, once, unless workers have the package on their path."""
    sc = spark.sparkContext
    paths = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if getattr(sc, "_runnel_shipped", False) or any(p and Path(p).resolve() == _ROOT for p in paths):
        return
    folder = tempfile.mkdtemp(prefix="runnel-zip-")
    shutil.copytree(_ROOT / "runnel", f"{folder}/src/runnel", ignore=shutil.ignore_patterns("__pycache__"))
    for extra in _ROOT.glob("*_pipeline.py"):
        shutil.copy(extra, f"{folder}/src")
    sc.addPyFile(shutil.make_archive(f"{folder}/runnel_package", "zip", f"{folder}/src"))
    sc._runnel_shipped = True


def shipped(fn: Callable) -> Callable:
    @functools.wraps(fn)
    def run(spark: SparkSession, *args, **kwargs):
        ship(spark)
        return fn(spark, *args, **kwargs)

    return run

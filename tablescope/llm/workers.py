"""Lets Python workers import this package; gives memory back."""

from __future__ import annotations

import ctypes
import os

import pyarrow as pa
from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> SparkSession:
    """Names the package's folder to the workers; where executors lack it, ship the package with ``--py-files``."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, env.get("PYTHONPATH")]))
    return spark


def give_back() -> None:
    """Returns freed memory that Arrow and the C library keep to the system.

    A fit in the driver otherwise leaves its process some 200 MB larger for the rest of the application.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)

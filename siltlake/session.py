"""Session helpers."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ensure_importable(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import this package. Clusters get it by
    their own means (an installed package or --py-files)."""
    here, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if here not in known.split(":"):
        env["PYTHONPATH"] = f"{here}:{known}" if known else here
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Where
    the session names none, a local master gets a temporary one; a cluster must
    name its own, as executors do not see the driver's folders."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="siltlake-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")

"""Session helpers: packages on workers, checkpoints, checked broadcasts."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers of this machine import this package (a cluster ships it with --py-files), and sets the session's checkpoint folder; a temporary one only for local masters."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="reachway-"))
    return spark


def bounded(df: DataFrame, rows: int) -> list | None:
    """The rows of df if there are at most so many, or None. No more than that bound reaches the driver."""
    got = df.limit(rows + 1).collect()
    return got if len(got) <= rows else None

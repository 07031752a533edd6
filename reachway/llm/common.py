"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Ids up to this number (8 bytes each) are broadcast.
BROADCAST_IDS = 1_000_000
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, and sets a checkpoint folder where the session names none."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder that was set by hand. Where the session names neither, local masters (tests)
    get a temporary one; on a cluster that raises, since executors wouldn't see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="reachway-")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this session's own, on whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def without(docs: DataFrame, gone: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """docs less the rows whose doc_id is in gone (one column `gone`, distinct; null is an id like others). The ids are counted: up to broadcast_ids of them go to all executors, so that
    texts don't move; more are joined by a shuffle."""
    gone = gone.checkpoint()
    if gone.count() <= broadcast_ids:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone"]), "left_anti")


def carried(docs: DataFrame) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """docs as doc_id, text and one struct of its other columns, so that nothing that an operator adds or replaces can clash with them; and the way back, with some columns set anew."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    whole = docs.select("doc_id", "text", F.struct(*(others or [F.lit(0).alias("none")])).alias("carried_row"))

    def back(out: DataFrame, **columns: Column) -> DataFrame:
        return out.select(*[columns.get(c, F.col(c if c in ("doc_id", "text") else f"carried_row.`{c}`")).alias(c) for c in docs.columns])

    return whole, back


def replaced(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns at its end; columns of df whose names clash, in any case, are replaced."""
    taken = {c.lower() for c in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in columns.items()])


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def row_key(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of these columns: equal rows share them, others don't (128 bits)."""
    return F.xxhash64(*cols), F.xxhash64(F.lit("second"), *[F.coalesce(c.cast("string"), F.lit("\x00null")) for c in cols])

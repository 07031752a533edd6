"""Several tables that change together: each set is a folder of its own, and one small manifest names the set that counts.

Tables of a new set are written first, where no reader looks; then the manifest is replaced in one move. A writer that stops before that leaves the old set as it was, whatever it has written, and
readers never see tables of two sets. Sets before the last two go when a new one counts: readers that have just begun still find what they opened.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from reachway.sources.paths import delete, read_bytes, replace_bytes

_MANIFEST = "_current.json"


def manifest(path: str) -> dict | None:
    """set, before (the set before it) and tables of the set that counts; None where there is none."""
    data = read_bytes(f"{path}/{_MANIFEST}")
    return None if data is None else json.loads(data)


def write_set(tables: Mapping[str, DataFrame], path: str) -> None:
    """Writes all these tables as one new set under path."""
    old, name = manifest(path), f"set-{uuid.uuid4().hex}"
    try:
        for table, df in tables.items():
            df.write.parquet(f"{path}/{name}/{table}")
    except BaseException:
        delete(f"{path}/{name}")
        raise
    replace_bytes(f"{path}/{_MANIFEST}", json.dumps({"set": name, "before": old and old["set"], "tables": list(tables)}).encode())
    if old and old.get("before"):
        delete(f"{path}/{old['before']}")


def read_set(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The tables of the set that counts, by name; None where no set was ever finished."""
    found = manifest(path)
    return None if found is None else {t: spark.read.parquet(f"{path}/{found['set']}/{t}") for t in found["tables"]}

"""The quality rules as a streaming gate: points arrive in micro-batches, and clean ones go on.

Row rules (coordinates, text) need no state. Repeated ids are dropped within a watermark of the time column, first come first served.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachway.operators.quality import reencoded, with_status


def gate(points: DataFrame, text_cols: Sequence[str] = (), id_col: str | None = None, time_col: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The points that pass, corrected; for streaming and batch frames alike. With id_col, repeated ids go: within the delay of time_col on a stream."""
    status = with_status(points)
    kept = reencoded(status.filter(~F.col("q_missing") & ~F.col("q_outside")).drop("q_missing", "q_outside", "q_swapped"), text_cols).drop("q_cells")
    if id_col is None:
        return kept
    if points.isStreaming and time_col is not None:
        return kept.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])
    return kept.dropDuplicates([id_col])


def rejected(points: DataFrame) -> DataFrame:
    """The points that fail, with the rule that they fail."""
    status = with_status(points)
    rule = F.when(F.col("q_missing"), "coordenadas_nulas_o_cero").when(F.col("q_outside"), "fuera_de_bbox_peru")
    return status.withColumn("regla", rule).filter(F.col("regla").isNotNull()).drop("q_missing", "q_outside", "q_swapped")

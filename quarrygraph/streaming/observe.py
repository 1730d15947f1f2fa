"""Observation of operations: phases, stages, progress and recovery as event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.operators.incremental import recovery_counts, stage_durations


def monotonic_progress(marks: DataFrame) -> DataFrame:
    """Progress of an operation's phase never falls: the running maximum."""
    w = Window.partitionBy("operation", "phase").orderBy("ts", "mark_id").rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumn("progress", F.max("done").over(w))


def ignored_late(marks: DataFrame) -> DataFrame:
    """Marks that came after their operation's end."""
    end = marks.where("stage = 'end'").groupBy("operation").agg(F.min("ts").alias("ended"))
    return marks.join(end, "operation").where("ts > ended").drop("ended")


__all__ = ["ignored_late", "monotonic_progress", "recovery_counts", "stage_durations"]

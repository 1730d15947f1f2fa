"""File events as a stream: an event clock, dirty-path state, barriers and generations.

Micro-batches are folded by the same aggregates as batch input and merged into versioned Parquet state, so a
replayed batch finds its version written and is skipped.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.operators.incremental import carried_over, coalesced_journal, dirty_paths, due_paths, event_clock

EVENT = "event_id long, ts timestamp, path string, old_path string, kind string, cold boolean, is_directory boolean"
JOURNAL_KEYS = 4096


@dataclass(frozen=True)
class Generation:
    """Counters of a session: events seen, events indexed, state published; each at least the next and none ever falls."""

    session: str
    event: int = 0
    indexed: int = 0
    published: int = 0

    def __post_init__(self) -> None:
        if not self.event >= self.indexed >= self.published >= 0:
            raise ValueError("generations must be ordered event >= indexed >= published")

    def advance(self, event: int | None = None, indexed: int | None = None, published: int | None = None) -> Generation:
        new = Generation(self.session, *(a if b is None else b for a, b in ((self.event, event), (self.indexed, indexed), (self.published, published))))
        if new.event < self.event or new.indexed < self.indexed or new.published < self.published:
            raise ValueError("a generation cannot fall")
        return new

    def reached(self, session: str, target: int) -> bool:
        if session != self.session:
            raise ValueError("a target belongs to its own session")
        return self.published >= target


class DirtyState:
    """Dirty paths and the clock, as versions below one folder; the pointer file names the current one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        Path(self.root).mkdir(parents=True, exist_ok=True)

    @property
    def pointer(self) -> dict:
        p = Path(self.root) / "current.json"
        return json.loads(p.read_text()) if p.exists() else {"version": -1, "batch": -1, "clock": 0, "trusted": True}

    def paths(self) -> DataFrame:
        v = self.pointer["version"]
        if v < 0:
            return self.spark.createDataFrame([], "path string, first_generation long, last_generation long, cold boolean")
        return self.spark.read.parquet(f"{self.root}/v{v}")

    def _swap(self, paths: DataFrame, **pointer: object) -> None:
        now = self.pointer
        version = now["version"] + 1
        paths.write.mode("overwrite").parquet(f"{self.root}/v{version}")
        temp = Path(self.root) / ".current.json.tmp"
        temp.write_text(json.dumps(now | {"version": version} | pointer))
        os.replace(temp, Path(self.root) / "current.json")

    def add(self, events: DataFrame, batch: int) -> None:
        """Fold one micro-batch in; a batch seen before changes nothing."""
        now = self.pointer
        if batch <= now["batch"]:
            return
        clocked = event_clock(events).withColumn("clock", F.col("clock") + now["clock"])
        new = dirty_paths(clocked)
        both = self.paths().unionByName(new)
        merged = both.groupBy("path").agg(F.min("first_generation").alias("first_generation"), F.max("last_generation").alias("last_generation"), F.bool_or("cold").alias("cold"))
        self._swap(merged, batch=batch, clock=now["clock"] + events.count())

    def barrier(self, target: int) -> DataFrame:
        """Paths a reader at ``target`` must see processed; later events stay dirty."""
        return due_paths(self.paths(), target)

    def processed(self, target: int) -> None:
        self._swap(carried_over(self.paths(), target))

    def distrust(self) -> None:
        """Events were lost: everything is cold until the next full scan."""
        self._swap(self.paths().withColumn("cold", F.lit(True)), trusted=False)

    def rescanned(self) -> None:
        self._swap(self.paths().limit(0), trusted=True)


def watch(spark: SparkSession, source: str, state: DirtyState, checkpoint: str, files_per_trigger: int = 4):
    """Start the stream over a folder of event files (Parquet); bounded intake a trigger, one writer of the state."""

    def add(df: DataFrame, i: int) -> None:
        df = df.persist()
        try:
            state.add(df, i)
        finally:
            df.unpersist()

    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def admitted(events: DataFrame, epoch: int) -> DataFrame:
    """Events captured under an older epoch are delivered cold."""
    return events.withColumn("cold", F.col("cold") | (F.col("epoch") < epoch))


def replay(journal: DataFrame, most: int = JOURNAL_KEYS) -> tuple[DataFrame, bool]:
    """The journal's coalesced events for a new policy, and whether it overflowed (then nothing in it can be trusted)."""
    folded = coalesced_journal(journal)
    return folded, folded.limit(most + 1).count() > most


def unconsumed(changes: DataFrame, baseline: DataFrame) -> DataFrame:
    """Changes whose content the baseline has not seen (path, sha)."""
    return changes.join(baseline.select("path", "sha"), ["path", "sha"], "left_anti")


def path_decision(paths: DataFrame, sources: DataFrame) -> DataFrame:
    """warm for a plain edit of a known source, cold for all else."""
    known = sources.select("path", F.lit(True).alias("known"))
    return paths.join(known, "path", "left").withColumn("decision", F.when(F.col("known") & ~F.col("cold"), "warm").otherwise("cold")).drop("known")

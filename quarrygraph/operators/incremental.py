"""Change detection: inventories, fingerprints, dirty projects and what depends on them."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.lineage import cut

#: Results of a comparison from worst to best.
DIFFERENT, METADATA, CONTENT = "different", "metadata_match", "content_match"
#: Precedence of event kinds; the strongest of a path wins.
KIND_RANK = {"changed": 0, "created": 1, "renamed": 2, "deleted": 3}


def inventory_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change): created, deleted or changed files of two inventories."""
    p = previous.select("path", F.col("length").alias("l0"), F.col("sha").alias("s0"))
    c = current.select("path", F.col("length").alias("l1"), F.col("sha").alias("s1"))
    change = F.when(F.col("l0").isNull(), "created").when(F.col("l1").isNull(), "deleted").when((F.col("l0") != F.col("l1")) | (F.col("s0") != F.col("s1")), "changed")
    return p.join(c, "path", "full").select("path", change.alias("change")).where("change is not null")


def file_comparison(l0: Column, l1: Column, m0: Column, m1: Column, s0: Column, s1: Column) -> Column:
    """One file: equal metadata matches without looking at content, equal hashes match as content, else different."""
    return F.when((l0 == l1) & (m0 == m1), METADATA).when(s0.isNotNull() & (s0 == s1), CONTENT).otherwise(DIFFERENT)


def project_digests(files: DataFrame) -> DataFrame:
    """(project, files, digest): hash over a project's files in path order."""
    entry = F.concat_ws("\x1d", "path", F.col("length").cast("string"), "sha")
    return files.groupBy("project").agg(F.count("*").alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\x1e"), 256).alias("digest"))


def fingerprint_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(project, state): new, removed, changed or clean by digest."""
    j = previous.select("project", F.col("digest").alias("d0")).join(current.select("project", F.col("digest").alias("d1")), "project", "full")
    return j.select("project", F.when(F.col("d0").isNull(), "new").when(F.col("d1").isNull(), "removed").when(F.col("d0") != F.col("d1"), "changed").otherwise("clean").alias("state"))


def combined_comparison(files: DataFrame) -> DataFrame:
    """(project, comparison): the worst of a project's files; incomplete discovery on either side is different."""
    rank = F.when(F.col("comparison") == DIFFERENT, 0).when(F.col("comparison") == METADATA, 1).otherwise(2)
    return files.groupBy("project").agg(F.min(F.when(~F.col("complete"), 0).otherwise(rank)).alias("rank")).select("project", F.element_at(F.array(F.lit(DIFFERENT), F.lit(METADATA), F.lit(CONTENT)), F.col("rank") + 1).alias("comparison"))


def reverse_closure(dirty: DataFrame, references: DataFrame) -> DataFrame:
    """(project): dirty projects and all that refer to them, directly or not; removed projects dirty theirs as well.

    Rounds join the newest projects only; a cycle ends when a round finds nothing new.
    """
    known = cut(dirty.select("project").distinct())
    frontier = known
    refs = references.select(F.col("refers_to").alias("project"), F.col("project").alias("dependent")).distinct()
    refs = cut(refs)
    for depth in count():
        new = frontier.join(refs, "project").select(F.col("dependent").alias("project")).distinct().join(known, "project", "left_anti")
        new = cut(new)
        if new.isEmpty():
            break
        known, frontier = known.union(new), new
        known = cut(known) if depth % 16 == 15 else known
    return known


def contributions_to_reuse(previous: DataFrame, dirty: DataFrame) -> DataFrame:
    return previous.join(dirty, "project", "left_anti")


def event_clock(events: DataFrame) -> DataFrame:
    """Events with a clock without gaps in (ts, event_id) order.

    Ranks come from range partitions: rows are sorted by range, each partition counts its own, and the few counts give first
    ranks, so no single task sees all events.
    """
    ranged = events.repartitionByRange("ts", "event_id").sortWithinPartitions("ts", "event_id").withColumn("__part", F.spark_partition_id()).withColumn("__local", F.monotonically_increasing_id() - (F.col("__part").cast("long") * F.lit(1 << 33)))
    ranged = ranged.persist()
    counts = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    first = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "base")
    return ranged.join(F.broadcast(first), "__part").withColumn("clock", F.col("base") + F.col("__local") + 1).drop("__part", "__local", "base")


def coalesced_journal(events: DataFrame) -> DataFrame:
    """One row for each (path, old_path): strongest kind, cold if ever cold, and the ordered fold of the entry type.

    The fold keeps a known type, forgets it on contradiction and learns it again: true, false is null, then true is true. Runs of
    equal types longer than two, and events without one, do not change it, so only the first two events of each run are gathered.
    """
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in KIND_RANK.items() for x in kv)), F.col("kind"))
    w = Window.partitionBy("path", "old_path").orderBy("clock")
    known = F.col("is_directory").isNotNull()
    last = F.last(F.col("is_directory"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    turn = known & (last.isNull() | (last != F.col("is_directory")))
    # A run's second event matters too: after a contradiction it is the one that is learned.
    e = events.withColumns({"rank": rank, "turn": turn}).withColumn("run", F.sum(F.col("turn").cast("int")).over(w))
    nth = F.sum(known.cast("int")).over(Window.partitionBy("path", "old_path", "run").orderBy("clock"))
    e = e.withColumn("matters", known & (nth <= 2))
    ordered = F.array_sort(F.collect_list(F.when(F.col("matters"), F.struct("clock", "is_directory"))))
    first = F.get("seen", F.lit(0))["is_directory"]
    fold = F.aggregate(F.slice("seen", F.lit(2), F.greatest(F.size("seen") - 1, F.lit(0))), first, lambda a, x: F.when(a.isNull(), x["is_directory"]).when(x["is_directory"].isNull() | (a == x["is_directory"]), a).otherwise(F.lit(None).cast("boolean")))
    g = e.groupBy("path", "old_path").agg(F.max("rank").alias("rank"), F.bool_or("cold").alias("cold"), F.count("*").alias("events"), F.min("clock").alias("first_clock"), F.max("clock").alias("last_clock"), ordered.alias("seen"))
    kinds = F.array(*(F.lit(k) for k in KIND_RANK))
    return g.withColumns({"kind": F.element_at(kinds, F.col("rank") + 1), "is_directory": fold}).drop("rank", "seen")


def dirty_paths(events: DataFrame) -> DataFrame:
    """(path, first_generation, last_generation, cold): both ends of a rename are dirty."""
    ends = events.select("path", "clock", "cold").unionAll(events.where("old_path is not null").select(F.col("old_path").alias("path"), "clock", "cold"))
    return ends.groupBy("path").agg(F.min("clock").alias("first_generation"), F.max("clock").alias("last_generation"), F.bool_or("cold").alias("cold"))


def due_paths(dirty: DataFrame, target: int) -> DataFrame:
    """What a barrier at ``target`` processes; a path touched later stays dirty from there on."""
    return dirty.where(F.col("first_generation") <= target).withColumn("stays", F.col("last_generation") > target)


def carried_over(dirty: DataFrame, target: int) -> DataFrame:
    later = dirty.where(F.col("last_generation") > target)
    return later.withColumn("first_generation", F.when(F.col("first_generation") <= target, F.col("last_generation")).otherwise(F.col("first_generation")))


def dirty_projects(paths: DataFrame, owners: DataFrame) -> DataFrame:
    """Projects that own a dirty path (owners: path, projects array)."""
    return paths.join(owners, "path").select(F.explode("projects").alias("project")).distinct()


def recent(events: DataFrame, keep: int = 32) -> DataFrame:
    """The last events by clock: a top-k report, with how many were left out."""
    total = events.agg(F.count("*").alias("total"))
    return events.orderBy(F.desc("clock")).limit(keep).crossJoin(F.broadcast(total)).withColumn("omitted", F.greatest(F.col("total") - keep, F.lit(0))).drop("total")


def stage_durations(marks: DataFrame) -> DataFrame:
    """(operation, stage, millis): time from each mark to the next of its operation, summed by stage."""
    spent = F.expr("timestampdiff(MILLISECOND, ts, lead(ts) over (partition by operation order by ts, mark_id))")
    return marks.withColumn("spent", spent).where("spent is not null").groupBy("operation", "stage").agg(F.sum("spent").alias("millis"))


def recovery_counts(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("watcher").agg(F.count("*").alias("attempts"), F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"), F.max_by("outcome", F.struct("ts", "attempt_id")).alias("last_outcome"))


def distinct_diagnostics(rows: DataFrame, most: int = 100, chars: int = 4096) -> DataFrame:
    """Trimmed, non-blank, distinct diagnostics in order; the first ``most`` (a report's cap), each cut at ``chars``."""
    clean = rows.select(F.trim("diagnostic").alias("diagnostic")).where("diagnostic <> ''").distinct()
    return clean.orderBy("diagnostic").limit(most).select(F.substring("diagnostic", 1, chars).alias("diagnostic"), (F.length("diagnostic") > chars).alias("truncated"))


def nested_roots(roots: DataFrame) -> DataFrame:
    """Roots not below another root: a root's ancestors are looked up by equality instead of a prefix join."""
    up = roots.select("path", F.explode(F.expr("transform(sequence(1, greatest(size(split(path, '/')) - 1, 1)), i -> array_join(slice(split(path, '/'), 1, i), '/'))")).alias("ancestor")).where("ancestor <> path")
    covered = up.join(roots.select(F.col("path").alias("ancestor")), "ancestor").select("path").distinct()
    return roots.select("path").distinct().join(covered, "path", "left_anti")


def same_members(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Whether two sets of keys are equal: no key without its like in the other."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").isEmpty() and right.join(left, key, "left_anti").isEmpty()


def scan_events(previous: DataFrame, current: DataFrame) -> DataFrame:
    """A backup scan's differences as cold file events."""
    return inventory_diff(previous, current).select("path", F.lit(None).cast("string").alias("old_path"), F.col("change").alias("kind"), F.lit(True).alias("cold"), F.lit(False).alias("is_directory"))

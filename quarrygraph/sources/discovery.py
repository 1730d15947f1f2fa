"""What belongs to a project's inputs: roots, rules, output folders, configuration candidates, inventories."""

from __future__ import annotations

from itertools import count
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrygraph.functions.identity import ancestors
from quarrygraph.lineage import cut
from quarrygraph.operators.incremental import nested_roots
from quarrygraph.plans.request import QueryError

#: Configuration files looked for in every folder above a project.
CONFIGURATION = ("global.json", ".editorconfig", "Directory.Build.props", "Directory.Build.targets", "Directory.Build.rsp", "Directory.Solution.props", "Directory.Solution.targets", "MSBuild.rsp", "Directory.Packages.props", "packages.lock.json", "NuGet.Config")
SOLUTIONS, PROJECTS = (".sln", ".slnx"), (".csproj",)


def tree_keys(trees: DataFrame) -> DataFrame:
    """Work keys of syntax trees: the path, with a numbered suffix for its second and later occurrences."""
    n = F.row_number().over(Window.partitionBy("path").orderBy("ordinal")) - 1
    return trees.withColumn("n", n).withColumn("key", F.when(F.col("n") == 0, F.col("path")).otherwise(F.concat("path", F.lit("\x1f"), F.lpad(F.col("n").cast("string"), 8, "0")))).drop("n")


def scan_inventory(spark: SparkSession, root: str, glob: str = "*", hashed: bool = True) -> DataFrame:
    """(path, length, mtime, sha) of files below a folder, read by Spark's binary file source."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    sha = F.sha2("content", 256) if hashed else F.lit(None).cast("string")
    return files.select("path", "length", F.col("modificationTime").alias("mtime"), sha.alias("sha"))


def configuration_candidates(projects: DataFrame) -> DataFrame:
    """Every configuration file name in every folder above a project, whether it is there or not."""
    names = F.array(*map(F.lit, CONFIGURATION))
    folder = projects.select(F.explode(ancestors(F.col("path"))).alias("folder")).distinct()
    return folder.select("folder", F.explode(names).alias("name")).select(F.concat("folder", F.lit("/"), "name").alias("candidate"))


def infrastructure(paths: DataFrame, sources: DataFrame, explicit: DataFrame) -> DataFrame:
    """Infrastructure paths that are neither sources nor named explicitly."""
    return paths.select("path").distinct().join(sources.select("path").union(explicit.select("path")).distinct(), "path", "left_anti")


def watch_roots(roots: DataFrame) -> DataFrame:
    """(path, recursive): roots not covered by a recursive root above them, recursive if any of the same path is."""
    one = roots.groupBy("path").agg(F.bool_or("recursive").alias("recursive"))
    up = one.select("path", F.explode(ancestors(F.col("path"))).alias("above")).where("above <> path")
    covered = up.join(one.where("recursive").select(F.col("path").alias("above")), "above").select("path").distinct()
    return one.join(covered, "path", "left_anti")


def output_roots(candidates: DataFrame, kept: DataFrame) -> DataFrame:
    """Output folders to prune: distinct, none of them a file system's root, a kept folder (project, repository) or above one."""
    protected = kept.select("path").union(kept.select(F.explode(ancestors(F.col("path"))))).distinct()
    return candidates.select(F.explode(F.split("folders", ";")).alias("path")).select(F.rtrim(F.trim("path"), F.lit("/")).alias("path")).where("path <> ''").distinct().join(protected, "path", "left_anti")


def restore_metadata(assets: Column, extensions: Column) -> Column:
    """(path, complete): the assets file, else one derived from the extensions folder, which is not complete."""
    return F.struct(F.coalesce(assets, F.concat(F.rtrim(extensions, F.lit("/")), F.lit("/project.assets.json"))).alias("path"), assets.isNotNull().alias("complete"))


def candidate_rules(rules: DataFrame, forwards: DataFrame) -> DataFrame:
    """(item, glob, excludes): wildcard rules an item type has, directly or by forwarding other item types.

    rules: item, glob, excludes array; forwards: item, upstream, excludes array. Each hop adds its exclusions; an item type is not
    entered twice on one way, which ends self-forwarding and cycles.
    """
    known = rules.select("item", "glob", "excludes", F.array("item").alias("way"))
    step = known
    for hop in count(1):
        step = step.withColumnRenamed("item", "upstream").join(forwards.withColumnRenamed("excludes", "more"), "upstream").where(~F.array_contains("way", F.col("item")))
        step = step.select("item", "glob", F.array_sort(F.array_distinct(F.concat("excludes", "more"))).alias("excludes"), F.concat("way", F.array("item")).alias("way"))
        step = cut(step)
        if step.isEmpty():
            break
        known = known.unionByName(step)
        known = cut(known) if hop % 16 == 0 else known
    return known.select("item", "glob", "excludes").distinct()


def resolve_input(folder: str) -> str:
    """The one solution of a folder, else its one project; none or several are errors."""
    files = sorted(p for p in Path(folder).iterdir() if p.is_file())
    for suffixes in (SOLUTIONS, PROJECTS):
        found = [p for p in files if p.suffix.lower() in suffixes]
        if len(found) == 1:
            return str(found[0])
        if found:
            raise QueryError("invalid_arguments", "several inputs: " + ", ".join(p.name for p in found))
    raise QueryError("invalid_arguments", "no input found")


def native_events(events: DataFrame) -> DataFrame:
    """Watcher callbacks as file events; an overflow is a loss of trust, not an event."""
    kind = F.lower("change")
    entry = F.expr("case entry when 'directory' then true when 'file' then false end")
    return events.where("change <> 'Overflow'").select(kind.alias("kind"), "path", F.when(kind == "renamed", F.col("old_path")).alias("old_path"), entry.alias("is_directory"))


__all__ = ["nested_roots"]

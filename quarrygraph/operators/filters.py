"""Predicates of the query vocabulary and of watched paths."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph.functions.identity import ancestors, canonical_text, glob_regex, under

# The kinds a query may name.
KINDS = (
    "namespace", "class", "interface", "struct", "enum", "delegate", "record", "record_struct", "method", "constructor", "static_constructor", "destructor", "operator", "conversion", "userdefinedoperator", "localfunction", "property", "indexer", "field", "enum_member", "event", "parameter", "local", "local_constant", "range_variable", "type_parameter", "label", "alias", "union",
)
#: Names and extensions of files that always matter to a project.
PROJECT_EXTENSIONS = ("cs", "csproj", "sln", "slnx", "props", "targets")
PROJECT_FILES = ("global.json", ".editorconfig", "directory.build.props", "directory.build.targets", "directory.build.rsp", "directory.solution.props", "directory.solution.targets", "msbuild.rsp", "directory.packages.props", "packages.lock.json", "project.assets.json", "nuget.config")


def symbol_kind() -> Column:
    """The kind a query sees: any method that is none of the special ones is a plain method."""
    raw, node = F.lower("raw_kind"), F.col("node_kind")
    named = F.when(raw == "ordinary", "method").when(raw == "staticconstructor", "static_constructor").when(raw == "userdefinedoperator", "operator")
    return named.when(node.isin("method", "constructor"), node).otherwise(raw)


@dataclass(frozen=True)
class Filters:
    """Scope of a query; None is no restriction, an empty namespace is the global one.

    Paths of tables are relative to ``root`` and in normal form, so only the filters' own paths are brought into it, and conditions stay plain
    comparisons that reach the scan.
    """

    search: str | None = None
    namespace: str | None = None
    project: str | None = None
    path: str | None = None
    kind: str | None = None
    root: str | None = None

    def _path(self, text: str) -> str:
        full = canonical_text(text, self.root)
        return posixpath.relpath(full, self.root) if self.root and (full == self.root or full.startswith(self.root.rstrip("/") + "/")) else full

    def document_condition(self) -> Column:
        """The part of the scope that documents have: project and path of a row's ``file``."""
        out = F.lit(True)
        if self.project is not None:
            out &= F.col("project") == self._path(self.project)
        if self.path is not None:
            out &= F.coalesce(under(F.col("file"), F.lit(self._path(self.path))), F.lit(False))
        return out

    def condition(self, places: bool = False) -> Column:
        """``places``: rows have an array ``locations``, any of which may be on the path."""
        out = F.lit(True)
        if self.search is not None:
            out &= F.contains(F.lower("label"), F.lit(self.search.lower()))
        if self.namespace is not None:
            ns = F.coalesce("namespace", F.lit(""))
            out &= (ns == "") if self.namespace == "" else (ns == self.namespace) | F.startswith(ns, F.lit(f"{self.namespace}."))
        if places:
            if self.path is not None:
                out &= F.coalesce(F.exists("locations", lambda at: under(at["file"], F.lit(self._path(self.path)))), F.lit(False))
            if self.project is not None:
                out &= F.col("project") == self._path(self.project)
        else:
            out &= self.document_condition()
        if self.kind is not None:
            out &= symbol_kind() == ("operator" if self.kind == "userdefinedoperator" else self.kind)
        return out

    def apply(self, decl: DataFrame) -> DataFrame:
        return decl.where(self.condition("locations" in decl.columns))


def conventional_file(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return name.isin(*PROJECT_FILES) | F.regexp_like(name, F.lit(rf"\.({'|'.join(PROJECT_EXTENSIONS)})$"))


def temporary_of(path: Column, target: Column) -> Column:
    """Whether a path is an atomic write's temporary file beside ``target``: .{name}.*.tmp in the same folder."""
    folder = F.regexp_extract(target, "^(.*/)?", 0)
    name = F.element_at(F.split(target, "/"), -1)
    return F.startswith(path, F.concat(folder, F.lit("."), name, F.lit("."))) & F.endswith(path, F.lit(".tmp")) & ~F.contains(F.substr(path, F.length(folder) + 1), F.lit("/"))


def glob(path: Column, patterns: list[str], excluded: list[str] | None = None) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit |= F.regexp_like(path, F.lit(glob_regex(p)))
    for p in excluded or []:
        hit &= ~F.regexp_like(path, F.lit(glob_regex(p)))
    return hit


def excludes_folder(folder: Column, excluded: list[str]) -> Column:
    """Only an exclusion that ends in /** or /**/* takes a whole folder out."""
    out = F.lit(False)
    for p in excluded:
        for tail in ("/**/*", "/**"):
            if p.endswith(tail):
                out |= F.regexp_like(folder, F.lit(glob_regex(p.removesuffix(tail)))) | F.regexp_like(folder, F.lit(glob_regex(f"{p.removesuffix(tail)}/**")))
                break
    return out


def inventory_scope(entries: DataFrame, inputs: DataFrame, patterns: list[str], excluded: list[str], tools: list[str], complete: bool = True, bootstrap: bool = False) -> DataFrame:
    """Entries (path, is_directory) that a scan keeps: files it lists and folders it walks into.

    Nothing below a tool's folder counts. A known input and the folders above it always do; before evaluation (bootstrap) nothing else does. Then
    patterns decide; until inputs are completely known, conventional files and all folders count too.
    """
    tool = F.lit(False)
    for t in tools:
        tool |= under(F.col("path"), F.lit(t))
    known = inputs.select("path").distinct().withColumn("known", F.lit(True))
    above = inputs.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct().withColumn("above", F.lit(True))
    each = entries.where(~tool).join(known, "path", "left").join(above, "path", "left")
    here, over = F.coalesce("known", F.lit(False)), F.coalesce("above", F.lit(False))
    if bootstrap:
        files, folders = here, here | over
    else:
        files = here | glob(F.col("path"), patterns, excluded) | (F.lit(not complete) & conventional_file(F.col("path")))
        reach = F.lit(False)
        for p in patterns:
            fixed = p.split("*")[0].split("?")[0].rpartition("/")[0]
            reach |= (under(F.col("path"), F.lit(fixed)) | under(F.lit(fixed), F.col("path"))) if fixed else F.lit(True)
        folders = over | F.lit(not complete) | (reach & ~excludes_folder(F.col("path"), excluded))
    return each.where(F.when(F.col("is_directory"), folders).otherwise(files)).select("path", "is_directory")


def classify_events(events: DataFrame, inputs: DataFrame, outputs: list[str], patterns: list[str]) -> DataFrame:
    """(accepted, needs_cold) of each event.

    Ends of an event below an output folder or in a temporary file do not count. A known input (inputs: path, is_source) is accepted,
    warm only for a plain change of sources that was not captured cold. A folder above an input, or an end that an input pattern
    matches, is accepted cold. The rest is not accepted. Ends are joined by equality with inputs and with inputs' folders.
    """
    key = ["path", "old_path", "kind", "cold", "is_directory", "event_id"]
    ends = events.select(*key, F.explode(F.array_distinct(F.array_compact(F.array("path", "old_path")))).alias("end"))
    tool = F.endswith("end", F.lit(".tmp"))
    for o in outputs:
        tool |= under(F.col("end"), F.lit(o))
    known = inputs.groupBy(F.col("path").alias("end")).agg(F.bool_and("is_source").alias("is_source"))
    folders = inputs.select(F.explode(ancestors(F.col("path"))).alias("end")).distinct().withColumn("above", F.lit(True))
    each = ends.where(~tool).join(known, "end", "left").join(folders, "end", "left")
    hit = glob(F.col("end"), patterns) & ~F.coalesce("is_directory", F.lit(False))
    found = each.groupBy("event_id").agg(F.bool_or(F.col("is_source").isNotNull()).alias("exact"), F.bool_and(F.coalesce("is_source", F.lit(False))).alias("sources"), F.bool_or(F.coalesce("above", F.lit(False))).alias("above"), F.bool_or(hit).alias("hit"))
    out = events.join(found, "event_id", "left")
    for c in ("exact", "sources", "above", "hit"):
        out = out.withColumn(c, F.coalesce(c, F.lit(False)))
    accepted = F.col("exact") | F.col("above") | F.col("hit")
    warm = F.col("exact") & (F.col("kind") == "changed") & F.col("sources") & ~F.col("cold")
    return out.select("event_id", "path", "kind", accepted.alias("accepted"), (accepted & ~warm).alias("needs_cold"))

"""Sessions over evidence: cache with integrity checks, leases, refresh, and running requests."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.functions.identity import SEPARATOR, canonical_text
from quarrygraph.lineage import cut
from quarrygraph.operators import verbs
from quarrygraph.operators.filters import Filters
from quarrygraph.operators.incremental import contributions_to_reuse, reverse_closure
from quarrygraph.operators.merge import merged_edges
from quarrygraph.plans.export import write_document
from quarrygraph.plans.paging import View, envelope, read_cursor, respond
from quarrygraph.plans.request import QueryError, Spec, parse

CACHE_VERSION = "cache/v1"


def atomic_write(path: str, text: str) -> None:
    target = Path(path)
    fd, temp = tempfile.mkstemp(prefix=f".{target.name}.", suffix=".tmp", dir=target.parent)
    with os.fdopen(fd, "w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, target)


class Lease:
    """An exclusive lock on a destination, held while in context."""

    def __init__(self, path: str):
        self.path = f"{path}.lock"

    def __enter__(self) -> Lease:
        self.file = open(self.path, "w")  # noqa: SIM115
        try:
            fcntl.flock(self.file, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            self.file.close()
            raise QueryError("output_conflict", "another writer holds the destination") from e
        return self

    def __exit__(self, *_: object) -> None:
        fcntl.flock(self.file, fcntl.LOCK_UN)
        self.file.close()


class Cache:
    """Contributions of projects as Parquet partitions below versions; a manifest names the current version and its digests."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def load(self) -> tuple[str, DataFrame | None, dict]:
        """(status, contributions, manifest); status is loaded, missing, incompatible, corrupt or unavailable."""
        file = Path(self.root) / "manifest.json"
        try:
            if not file.exists():
                return "missing", None, {}
            manifest = json.loads(file.read_text())
        except OSError:
            return "unavailable", None, {}
        except ValueError:
            return "corrupt", None, {}
        if not isinstance(manifest, dict) or manifest.get("version") != CACHE_VERSION:
            return "incompatible", None, {}
        try:
            df = self.spark.read.parquet(f"{self.root}/{manifest['data']}")
            held = {r["project"]: r["digest"] for r in df.select("project", "digest").distinct().collect()}  # one row a project
        except (PySparkException, KeyError):
            return "corrupt", None, {}
        return ("loaded", df, manifest) if held == manifest.get("projects") else ("corrupt", None, {})

    def save(self, contributions: DataFrame) -> None:
        """Write a new version whole, then swap the manifest."""
        _, _, old = self.load()
        data = f"data-{int(old.get('number', 0)) + 1}"
        contributions.write.mode("overwrite").partitionBy("project").parquet(f"{self.root}/{data}")
        written = self.spark.read.parquet(f"{self.root}/{data}")
        projects = {r["project"]: r["digest"] for r in written.select("project", "digest").distinct().collect()}
        atomic_write(f"{self.root}/manifest.json", json.dumps({"version": CACHE_VERSION, "number": int(old.get("number", 0)) + 1, "data": data, "projects": projects}, sort_keys=True))


def integrity_problems(manifest: DataFrame, contributions: DataFrame) -> DataFrame:
    """(project, problem): projects listed without contributions, the other way round, twice, or with another digest."""
    m = manifest.groupBy("project").agg(F.count("*").alias("n"), F.max("digest").alias("d0"))
    c = contributions.groupBy("project").agg(F.count_distinct("digest").alias("k"), F.max("digest").alias("d1"))
    problem = F.when(F.col("n") > 1, "listed twice").when(F.col("d1").isNull(), "no contribution").when(F.col("d0").isNull(), "not listed").when((F.col("k") > 1) | (F.col("d0") != F.col("d1")), "other digest")
    return m.join(c, "project", "full").select("project", problem.alias("problem")).where("problem is not null")


def refresh(cache: Cache, fingerprints: DataFrame, references: DataFrame, extract: Callable[[DataFrame], DataFrame], rebuild: bool = False) -> dict[str, int]:
    """Bring the cache up to ``fingerprints`` (project, digest): re-extract changed projects and all that refer to them, reuse the rest.

    ``extract`` turns dirty projects (project, digest) into contributions with those columns. A clean refresh extracts nothing.
    """
    status, old, _ = cache.load()
    if rebuild or status != "loaded":
        new, reused = extract(fingerprints), 0
    else:
        before = old.select("project", F.col("digest").alias("was")).distinct()
        joined = before.join(fingerprints, "project", "full")
        changed = joined.where("was is null or digest is null or was <> digest").select("project")
        dirty = cut(reverse_closure(changed, references))
        if dirty.isEmpty():
            return {"extracted_projects": 0, "reused_projects": before.count()}
        keep = contributions_to_reuse(old, dirty)
        reused = keep.select("project").distinct().count()
        new = keep.unionByName(extract(fingerprints.join(dirty, "project", "left_semi")), allowMissingColumns=True)
    cache.save(new)
    return {"extracted_projects": fingerprints.count() - reused, "reused_projects": reused}


def cached_refresher(cache: Cache, fingerprints: Callable[[], DataFrame], references: Callable[[], DataFrame], extract: Callable[[DataFrame], DataFrame], tables: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> Callable[[bool], tuple[DataFrame, DataFrame, dict[str, int]]]:
    """A session's refresher over a cache: what ``refresh`` leaves there, as (declarations, observations) by ``tables``."""

    def run(rebuild: bool) -> tuple[DataFrame, DataFrame, dict[str, int]]:
        counts = refresh(cache, fingerprints(), references(), extract, rebuild)
        status, held, _ = cache.load()
        if held is None:
            raise QueryError("io_error", f"the cache is {status} after a refresh")
        return (*tables(held), counts)

    return run


def sidecar(path: str, kind: str) -> str:
    """Where an output's manifest or lock stands: a manifest by the hash of the canonical path, a lock by the file's own name, as the file system spells it."""
    full = os.path.abspath(path)
    folder, name = os.path.split(full)
    if not name:
        raise QueryError("invalid_arguments", "the output needs a file name")
    file = f"manifest-{hashlib.sha256(canonical_text(full).encode()).hexdigest()}.json" if kind == "manifest" else f"output-{name}.lock"
    return os.path.join(folder, ".quarrygraph", file)


@dataclass
class Session:
    """Evidence tables with a view; runs requests and always answers with an envelope."""

    declarations: DataFrame
    observations: DataFrame
    arguments: DataFrame | None = None
    view: View = field(default_factory=View)
    #: Facts for full signatures.
    signatures: DataFrame | None = None
    #: (rebuild) -> new declarations and observations, and how many projects were extracted and reused.
    refresher: Callable[[bool], tuple[DataFrame, DataFrame, dict[str, int]]] | None = None
    #: The folder that paths of tables are relative to.
    root: str | None = None
    _index: DataFrame | None = field(default=None, repr=False)

    def edges(self) -> DataFrame:
        """The evidence index: observations folded once for each state of the evidence, sorted by target in range partitions, and kept for later requests."""
        if self._index is None:
            order = ["target_id", "source_id", "relation", "evidence"]
            self._index = cut(merged_edges(self.observations).repartitionByRange(*order).sortWithinPartitions(*order))
        return self._index

    def publish(self, declarations: DataFrame, observations: DataFrame) -> None:
        self.declarations, self.observations, self._index = declarations, observations, None
        self.view.revision += 1

    def run(self, spec: Spec) -> dict[str, Any]:
        try:
            return self._run(spec.validate())
        except QueryError as e:
            return envelope(self.view, spec, error=e)

    def run_json(self, raw: bytes | str) -> dict[str, Any]:
        try:
            spec, _, session = parse(raw)
            if session is not None and session != self.view.session:
                raise QueryError("session_mismatch", "the request is for another session")
        except QueryError as e:
            return envelope(self.view, Spec("symbols"), error=e)
        return self.run(spec)

    def _declared(self, symbol: str | None) -> dict[str, Any]:
        row = self.declarations.where(F.col("id") == symbol).limit(1).collect()
        if not row:
            raise QueryError("symbol_not_found", f"no symbol {symbol}")
        return row[0].asDict()

    def _run(self, spec: Spec) -> dict[str, Any]:
        decl, filters = self.declarations, Filters(search=spec.search, root=self.root, **spec.filters)
        if spec.command == "symbols":
            return respond(verbs.symbols(decl, filters), "sort_key", self.view, spec)
        if spec.command == "usage-summary":
            out = verbs.usage_summary(self.observations, decl, spec.group_by, filters)
            # Nulls first, then text order within a target.
            key = F.concat_ws(SEPARATOR, "target_id", *(F.when(F.col(c).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(c).cast("string"))) for c in out.columns[2:] if c in ("project", "namespace", "target_framework", "is_external_root")))
            return respond(out.withColumn("sort_key", key), "sort_key", self.view, spec)
        if spec.command == "export":
            nodes = decl.select("id", "label", "node_kind", F.col("id").alias("symbol_key"), F.create_map().cast("map<string,string>").alias("properties"), F.when(F.col("file").isNotNull(), F.array(F.struct("file", "line", "column"))).otherwise(F.array()).alias("locations"))
            with Lease(spec.output_path):
                digest = write_document(nodes, self.edges(), spec.output_path, self.view.diagnostics)
            return envelope(self.view, spec) | {"export": {"path": spec.output_path, "sha256": digest}}
        if spec.command == "refresh":
            counts = {"extracted_projects": 0, "reused_projects": 0}
            if self.refresher is None:
                self.view.revision += 1
            else:
                declared, observed, counts = self.refresher(spec.rebuild)
                self.publish(declared, observed)
            return envelope(self.view, spec) | {"refresh": {"rebuild": spec.rebuild, **counts}}
        symbol = self._declared(spec.symbol_id)
        if spec.command == "signature" and self.signatures is not None:
            return respond(verbs.signature_items(self.signatures, decl, spec.symbol_id), "sort_key", self.view, spec)
        if spec.command == "signature":
            return respond(verbs.signature(decl, spec.symbol_id).withColumn("sort_key", F.col("id")), "sort_key", self.view, spec)
        if spec.command == "arguments":
            raw = (symbol["raw_kind"] or "").lower()
            if symbol["node_kind"] not in ("method", "constructor") or raw not in ("ordinary", "method", "constructor", "staticconstructor") or self.arguments is None:
                raise QueryError("unsupported_symbol", "only ordinary methods and constructors have arguments")
            if "caller_id" in self.arguments.columns:
                return respond(verbs.argument_items(self.arguments, self.view.snapshot_id, spec.symbol_id, filters, read_cursor(self.view, spec) if self.view.warm else None), "sort_key", self.view, spec)
            if filters.path is not None or filters.project is not None:
                raise QueryError("unsupported_capability", "these arguments have no documents to filter by")
            sites = verbs.arguments(self.arguments.where(F.col("callee_id") == spec.symbol_id))
            return respond(sites.withColumn("sort_key", verbs.argument_key(sites)), "sort_key", self.view, spec)
        edges = self.edges()
        if spec.command == "hierarchy":
            near = verbs.hierarchy(edges, decl, spec.symbol_id, spec.direction or "all", filters)
            key = F.concat_ws(SEPARATOR, "relation", "direction", "neighbour_id", "evidence")
            return respond(near.withColumn("sort_key", key), "sort_key", self.view, spec)
        find = verbs.callers if spec.command == "callers" else verbs.usages
        return respond(find(edges, decl, spec.symbol_id, filters), "sort_key", self.view, spec)

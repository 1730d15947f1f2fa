"""Export of a graph as one JSON document, equal bytes for equal graphs."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.functions.identity import location_text, snake_case
from quarrygraph.operators.merge import endpoint_violations
from quarrygraph.schema import EVIDENCE, RELATIONS, ordinal

SCHEMA_VERSION = "csharp/v1"


def export_nodes(nodes: DataFrame) -> DataFrame:
    """(id, label, node_kind, symbol_key, properties, locations) as exported; own properties come after, and so replace, the two built-in ones."""
    first = F.get("locations", F.lit(0))
    built = F.create_map(F.lit("node_kind"), snake_case(F.col("node_kind")), F.lit("symbol_key"), F.col("symbol_key"))
    keys = F.map_keys(F.coalesce("properties", F.create_map().cast("map<string,string>")))
    own = F.map_filter(built, lambda k, _: ~F.array_contains(keys, k))
    merged = F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(own, F.coalesce("properties", F.create_map().cast("map<string,string>"))))))
    return nodes.select("id", "label", F.lit("code").alias("file_type"), F.coalesce(first["file"], F.lit("")).alias("source_file"), F.when(first.isNotNull(), location_text(first["line"], first["column"])).alias("source_location"), F.when(F.size("locations") > 0, F.col("locations")).alias("source_locations"), merged.alias("properties"))


def export_edges(edges: DataFrame) -> DataFrame:
    """Edges as exported, by all their ``locations`` or, without ``source_locations``, by the ``first`` of them alone."""
    whole = "locations" in edges.columns
    first = F.get("locations", F.lit(0)) if whole else F.col("first")
    places = [F.when(F.size("locations") > 0, F.col("locations")).alias("source_locations")] if whole else []
    return edges.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), snake_case(F.col("relation")).alias("relation"), F.upper("evidence").alias("confidence"), F.col("confidence").alias("confidence_score"), F.coalesce(first["file"], F.lit("")).alias("source_file"), F.when(first.isNotNull(), location_text(first["line"], first["column"])).alias("source_location"), *places, F.lit(1.0).alias("weight"))


def validate(nodes: DataFrame, edges: DataFrame) -> list[str]:
    """What keeps a graph from being exported: ids that occur twice, ends that are not nodes."""
    out = [f"duplicate node {r['id']}" for r in nodes.groupBy("id").count().where("count > 1").orderBy("id").limit(10).collect()]
    return out + [f"{r['side']} {r['id']} is no node" for r in endpoint_violations(edges, nodes).orderBy("side", "id").limit(10).collect()]


def _rows(df: DataFrame) -> Iterable[str]:
    """Rows as JSON in order, a partition at a time."""
    cols = df.columns
    for r in df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
        d = json.loads(r["j"])
        yield json.dumps({k: v for k, v in d.items() if v is not None or k == "source_location"}, sort_keys=False)


def write_document(nodes: DataFrame, edges: DataFrame, path: str, diagnostics: Iterable[str] = (), metadata_key: str = "metadata") -> str:
    """Write the document atomically beside its place and return its sha256. The graph must be valid."""
    problems = validate(nodes, edges)
    if problems:
        raise ValueError("; ".join(problems))
    n = export_nodes(nodes.orderBy("id"))
    e = export_edges(edges.orderBy("source_id", "target_id", ordinal(F.col("relation"), RELATIONS), ordinal(F.col("evidence"), EVIDENCE)))
    tail = {"hyperedges": [], "input_tokens": 0, "output_tokens": 0, metadata_key: {"schema_version": SCHEMA_VERSION, "diagnostics": sorted({d.strip() for d in diagnostics if d.strip()})}}
    target = Path(path)
    digest = hashlib.sha256()
    fd, temp = tempfile.mkstemp(prefix=f".{target.name}.", suffix=".tmp", dir=target.parent)
    try:
        with os.fdopen(fd, "wb") as f:

            def put(text: str) -> None:
                digest.update(text.encode())
                f.write(text.encode())

            put('{\n  "directed": true,\n  "multigraph": true')
            for name, df in (("nodes", n), ("edges", e)):
                put(f',\n  "{name}": [')
                for i, row in enumerate(_rows(df)):
                    put((",\n    " if i else "\n    ") + row)
                put("\n  ]")
            for k, v in tail.items():
                put(f',\n  "{k}": {json.dumps(v)}')
            put("\n}\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, target)
    except BaseException:
        Path(temp).unlink(missing_ok=True)
        raise
    return digest.hexdigest()


def conflict(path: str, inputs: Iterable[str], state_dirs: Iterable[str]) -> str | None:
    """Why a destination cannot be written: it is an input, an alias of one, or inside a state folder."""
    real = os.path.realpath(path)
    if any(os.path.realpath(i) == real for i in inputs):
        return "the destination is an input"
    if any(os.path.commonpath([real, os.path.realpath(d)]) == os.path.realpath(d) for d in state_dirs):
        return "the destination is inside a state folder"
    return None

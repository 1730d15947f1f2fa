"""Folding observations into one row for each edge or node, and checks of the result.

Locations are made distinct by a first, map-side combined aggregate on (edge, location), so the second
one handles each location once and an edge seen a billion times at one place is no hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.functions.identity import location_key
from quarrygraph.schema import RELATIONS, ordinal

EDGE = ["source_id", "target_id", "relation", "evidence"]


def place() -> Column:
    """Where an observation is, null where it has no file."""
    return F.when(F.col("file").isNotNull(), F.struct("file", "line", "column"))


def distinct_locations(obs: DataFrame) -> DataFrame:
    return obs.groupBy(*EDGE, "file", "line", "column").agg(F.max("confidence").alias("confidence"))


def edge_counts(obs: DataFrame) -> DataFrame:
    """Edges with confidence and number of distinct places, without the places themselves."""
    return distinct_locations(obs).groupBy(*EDGE).agg(F.max("confidence").alias("confidence"), F.count("file").alias("n_locations"))


def merged_edges(obs: DataFrame) -> DataFrame:
    """Edges with confidence and their distinct places in (file, line, column) order.

    One shuffle: sets of places are combined map-side, so here too a place seen very often travels once a task.
    """
    return obs.groupBy(*EDGE).agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set(place())).alias("locations"))


def first_places(obs: DataFrame) -> DataFrame:
    """Edges with confidence and the ``first`` of their places, null where there is none: one shuffle, and nothing is gathered."""
    return obs.groupBy(*EDGE).agg(F.max("confidence").alias("confidence"), F.min(place()).alias("first"))


def with_location_text(edges: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("locations", location_key), ";")
    return edges.withColumns({"n_locations": F.size("locations").cast("long"), "location_text": text}).drop("locations")


def merged_nodes(decl: DataFrame) -> DataFrame:
    """One row an id; ``agrees`` tells whether all its rows have one kind and label."""
    return decl.groupBy("id").agg(F.min("node_kind").alias("node_kind"), F.min("label").alias("label"), ((F.min("node_kind") == F.max("node_kind")) & (F.min("label") == F.max("label"))).alias("agrees"), F.array_sort(F.collect_set(place())).alias("locations"))


def checked_nodes(decl: DataFrame) -> DataFrame:
    """``merged_nodes``, or an error where the rows of an id disagree."""
    nodes = merged_nodes(decl)
    same = F.when(F.col("agrees"), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("declarations disagree about "), "id")).cast("string"))
    return nodes.withColumn("id", same).drop("agrees")


def merged_properties(props: DataFrame) -> DataFrame:
    """(id, properties map) of (id, key, value) rows; a key with two values in one node is an error."""
    one = props.groupBy("id", "key").agg(F.min("value").alias("value"), F.max("value").alias("other"))
    value = F.when(F.col("value") == F.col("other"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("conflicting property "), "key")).cast("string"))
    return one.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", value.alias("value"))))).alias("properties"))


def endpoint_violations(edges: DataFrame, decl: DataFrame) -> DataFrame:
    """(side, id, edges): ends of edges that nothing declares."""
    ends = edges.select(F.lit("source").alias("side"), F.col("source_id").alias("id")).unionAll(edges.select(F.lit("target").alias("side"), F.col("target_id").alias("id")))
    return ends.groupBy("side", "id").agg(F.count("*").alias("edges")).join(decl.select("id"), "id", "left_anti").select("side", "id", "edges")


def identity_collisions(decl: DataFrame, key: str) -> DataFrame:
    """Keys that more than one declaration has."""
    return decl.groupBy(key).agg(F.count("*").alias("n"), F.min("id").alias("kept_id")).where("n > 1")


def first_declarations(decl: DataFrame, key: str) -> DataFrame:
    """The first declaration of each key in project order."""
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last("project"), "id")
    return decl.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def snapshot_order(edges: DataFrame) -> DataFrame:
    return edges.orderBy("source_id", "target_id", ordinal(F.col("relation"), RELATIONS), "evidence")

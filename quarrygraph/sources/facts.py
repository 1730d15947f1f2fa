"""Reading fact tables and exported documents. Compiling sources is somebody else's work: facts come in as tables."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrygraph.plans.request import QueryError
from quarrygraph.schema import DECLARATION, OBSERVATION

SCHEMAS = {"declarations": DECLARATION, "observations": OBSERVATION}
_PLACE = T.ArrayType(T.StructType([T.StructField("file", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType())]))
_DOCUMENT = T.StructType(
    [
        T.StructField("nodes", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("source_locations", _PLACE), T.StructField("properties", T.MapType(T.StringType(), T.StringType()))]))),
        T.StructField("edges", T.ArrayType(T.StructType([T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("relation", T.StringType()), T.StructField("confidence", T.StringType()), T.StructField("confidence_score", T.DoubleType()), T.StructField("source_locations", _PLACE)]))),
    ]
)


def read_facts(spark: SparkSession, path: str, table: str, fmt: str = "parquet") -> DataFrame:
    """A fact table with its declared schema, never an inferred one; what cannot be loaded is ``solution_load_failed``."""
    try:
        df = spark.read.schema(SCHEMAS[table]).format(fmt).load(f"{path}/{table}")
        df.limit(0).collect()
    except (PySparkException, KeyError) as e:
        raise QueryError("solution_load_failed", f"cannot load {table}: {type(e).__name__}") from e
    return df


def read_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, observations) of an exported document; each place of an edge is an observation of it."""
    doc = spark.read.schema(_DOCUMENT).json(path, multiLine=True)
    node = doc.select(F.explode("nodes").alias("n")).select("n.*")
    nodes = node.select("id", "label", F.col("properties")["node_kind"].alias("node_kind"), F.col("properties")["symbol_key"].alias("symbol_key"), F.map_filter("properties", lambda k, _: ~k.isin("node_kind", "symbol_key")).alias("properties"), F.coalesce("source_locations", F.array()).alias("locations"))
    edge = doc.select(F.explode("edges").alias("e")).select("e.*")
    at = edge.withColumn("at", F.explode_outer("source_locations"))
    return nodes, at.select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), "relation", F.lower("confidence").alias("evidence"), F.col("confidence_score").alias("confidence"), "at.file", "at.line", "at.column")


def projects(rows: DataFrame) -> DataFrame:
    """Distinct projects by key; those of other languages are skipped, none at all is an error of the caller."""
    return rows.where("language = 'C#'").groupBy("project_key").agg(F.min("path").alias("path"))


def target_framework(requested: Column, evaluated: Column, single: Column) -> Column:
    """The requested framework, else the only evaluated one, else the single property, else unknown; several evaluated ones are an error."""
    clean = F.filter(F.transform(F.split(F.coalesce(evaluated, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    asked = F.nullif(F.trim(F.coalesce(requested, F.lit(""))), F.lit(""))
    many = F.raise_error(F.lit("the project has several target frameworks; name one")).cast("string")
    return F.when(asked.isNotNull(), asked).when(F.size(clean) > 1, many).otherwise(F.coalesce(F.get(clean, F.lit(0)), F.nullif(F.trim(F.coalesce(single, F.lit(""))), F.lit("")), F.lit("unknown")))


def mapped_location(mapped: Column, physical: Column, line: Column, column: Column) -> Column:
    """A place by its mapped path where there is one, else the physical path; null without any path."""
    file = F.coalesce(F.nullif(mapped, F.lit("")), physical)
    return F.when(file.isNotNull(), F.struct(file.alias("file"), line.alias("line"), column.alias("column")))


def source_discriminator(path: Column, start: Column, length: Column, syntax: Column) -> Column:
    """What tells apart symbols of one signature: their place, or the path of a generated syntax."""
    return F.when(path.isNotNull(), F.concat(F.lit("source="), path, F.lit("@"), start.cast("string"), F.lit(":"), length.cast("string"))).otherwise(F.concat(F.lit("@syntax="), F.array_join(syntax, ".")))


def definition_id(own: Column, definition: Column) -> Column:
    """Parts of one symbol go by their definition's id."""
    return F.coalesce(definition, own)

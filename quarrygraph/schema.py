"""Types of the evidence tables and the fixed vocabularies behind their ordinals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOCATION = T.StructType([T.StructField("file", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType())])
DECLARATION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "label", "node_kind", "raw_kind", "namespace", "project", "tfm")]
    + [T.StructField("locations", T.ArrayType(LOCATION)), T.StructField("is_entry_point", T.BooleanType())]
)
OBSERVATION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("source_id", "target_id", "relation", "evidence")]
    + [T.StructField("confidence", T.DoubleType()), T.StructField("file", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType())]
)

# Vocabularies in their sort order.
NODE_KINDS = ("project", "namespace", "type", "method", "constructor", "property", "field", "event", "parameter", "local", "range_variable", "type_parameter", "label", "alias", "external_root")
RELATIONS = ("calls", "references", "inherits", "implements", "overrides", "dispatches_to")
EVIDENCE = ("extracted", "inferred", "ambiguous")
#: Relations whose edges and occurrences a summary counts.
COUNTED = RELATIONS[:5]


def ordinal(col: Column, vocabulary: tuple[str, ...]) -> Column:
    """Position of a word in its vocabulary; null for an unknown word."""
    return F.nullif(F.array_position(F.array(*map(F.lit, vocabulary)), col), F.lit(0)) - 1


def checked_confidence(col: Column) -> Column:
    """``col``, or an error where it is not a finite number in [0, 1]."""
    ok = col.isNotNull() & ~F.isnan(col) & (col >= 0) & (col <= 1)
    return F.when(ok, col).otherwise(F.raise_error(F.lit("confidence must be a finite number from 0 to 1")).cast("double"))

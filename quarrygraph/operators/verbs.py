"""The seven queries over declarations and edges, each one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.functions.identity import SEPARATOR, call_site_id, call_site_text, json_scalar, preview
from quarrygraph.operators.filters import Filters, symbol_kind
from quarrygraph.operators.merge import EDGE, distinct_locations
from quarrygraph.schema import COUNTED

#: Relations as sort keys spell them, and as queries show them.
SORT_NAMES = {"calls": "Calls", "references": "References", "inherits": "Inherits", "implements": "Implements", "overrides": "Overrides", "dispatches_to": "DispatchesTo"}
DIRECTIONS = {"base": ("inherits",), "derived": ("inherits",), "contracts": ("implements", "overrides"), "implementations": ("implements", "overrides")}
OUTGOING = ("base", "contracts")


def shown_relation(col: Column) -> Column:
    return F.replace(col, F.lit("_"), F.lit(""))


def sort_relation(col: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in SORT_NAMES.items() for x in kv))[col]


def symbols(decl: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Q symbols: items in (label, id) order; external roots are no symbols."""
    found = filters.apply(decl.where("node_kind <> 'external_root'"))
    return found.select("id", "label", symbol_kind().alias("kind"), "namespace", "project", "tfm", "file", "line", "column", "is_entry_point", F.concat_ws(SEPARATOR, "label", "id").alias("sort_key"))


def signature(decl: DataFrame, symbol_id: str) -> DataFrame:
    """Q signature: the declaration of one id with its modifiers in their fixed order."""
    one = decl.where(F.col("id") == symbol_id)
    kind = symbol_kind()
    modifiers = F.array_compact(F.array(F.when(kind == "static_constructor", "static"), F.when(kind == "operator", "static"), F.when(F.col("is_entry_point"), "entry")))
    return one.select("id", "label", kind.alias("kind"), F.when(F.col("namespace").isNull(), "internal").otherwise("public").alias("accessibility"), F.array_join(modifiers, " ").alias("modifiers"), "namespace", "project", "tfm")


#: What a signature says of a parameter and of a generic parameter.
PARAMETER = ("ordinal", "name", "type", "ref_kind", "is_params", "is_optional", "has_default", "default", "nullable_annotation")
GENERIC = ("ordinal", "name", "reference_type_constraint", "value_type_constraint", "not_null_constraint", "unmanaged_type_constraint", "constructor_constraint", "constraint_types")
CLASSES = ("method", "property", "field", "event", "type")


def signature_items(facts: DataFrame, decl: DataFrame, symbol_id: str | None = None) -> DataFrame:
    """Q signature in full, of one id or of all: (symbol, accessibility, modifiers, containing, type, return_type, parameters, generic_parameters,
    nullable_annotation).

    ``facts`` has a row an id with symbol_class, accessibility, flags (a map of modifiers), containing, type (of a type: itself, of a value: its own),
    returns, is_constructor, parameters, generic_parameters and nullable. What a class of symbol does not have is null or empty.
    """
    if symbol_id is not None:
        facts, decl = facts.where(F.col("id") == symbol_id), decl.where(F.col("id") == symbol_id)
    of, is_type = F.col("symbol_class"), F.col("symbol_class") == "type"
    words = F.coalesce(*(F.when(of == c, modifiers_of(c, {m: F.coalesce(F.col("flags")[m], F.lit(False)) for m in ORDER[c]})) for c in CLASSES), F.array().cast("array<string>"))
    returns = F.when((of == "method") & ~F.col("is_constructor"), F.col("returns")).when(of.isin("property", "field", "event"), F.col("type"))
    parameters = F.transform("parameters", lambda p: F.struct(*(p[c].alias(c) for c in PARAMETER)))
    generics = F.transform("generic_parameters", lambda p: F.struct(*((F.array_sort(p[c]) if c == "constraint_types" else p[c]).alias(c) for c in GENERIC)))
    row = facts.select(
        "id", "accessibility", words.alias("modifiers"), "containing", F.when(is_type, F.col("type")).alias("type"), returns.alias("return_type"),
        F.when(of.isin("method", "property"), parameters).otherwise(F.filter(parameters, lambda _: F.lit(False))).alias("parameters"),
        F.when(of.isin("method", "type"), generics).otherwise(F.filter(generics, lambda _: F.lit(False))).alias("generic_parameters"),
        F.when(is_type, F.col("nullable")).otherwise("none").alias("nullable_annotation"),
    )
    return symbols(decl).withColumnRenamed("sort_key", "symbol_key").join(row, "id").withColumn("sort_key", F.col("id"))


#: Modifiers of each class of symbol, in order.
ORDER = {
    "method": ("static", "abstract", "virtual", "override", "sealed", "async", "extern", "readonly"),
    "property": ("static", "abstract", "virtual", "override", "sealed", "readonly"),
    "field": ("static", "readonly", "const", "volatile"),
    "event": ("static", "abstract", "virtual", "override", "sealed"),
    "type": ("static", "abstract", "sealed"),
}


def modifiers_of(symbol_class: str, flags: dict[str, Column]) -> Column:
    """A symbol's modifiers in the order of its class."""
    return F.array_compact(F.array(*(F.when(flags[m], m) for m in ORDER[symbol_class] if m in flags)))


def usages(edges: DataFrame, decl: DataFrame, targets: DataFrame | str, filters: Filters = Filters(), relations: tuple[str, ...] | None = None) -> DataFrame:
    """Q usages: a row for each place of each inbound edge whose origin is declared and in scope; an edge without places has one row.

    ``targets`` is an id or a table of ids (column ``target_id``).
    """
    hit = edges.where(F.col("target_id") == targets) if isinstance(targets, str) else edges.join(targets, "target_id", "left_semi")
    if relations:
        hit = hit.where(F.col("relation").isin(*relations))
    origin = filters.apply(decl).select(F.col("id").alias("source_id"), F.col("label").alias("origin_label"))
    return usage_items(hit.select(*EDGE, "confidence", F.explode_outer("locations").alias("at")).select(*EDGE, "confidence", "at.*").join(origin, "source_id"))


def usage_items(each: DataFrame) -> DataFrame:
    """Places of edges (file, line, column), with their origin's label, as a usage query shows them."""
    place = F.when(F.col("file").isNotNull(), F.concat_ws(":", "file", F.col("line").cast("string"), F.col("column").cast("string"))).otherwise(F.lit(""))
    key = F.concat_ws(SEPARATOR, "source_id", sort_relation(F.col("relation")), F.initcap("evidence"), place)
    return each.select("target_id", F.col("source_id").alias("origin_id"), "origin_label", shown_relation(F.col("relation")).alias("relation"), "evidence", "confidence", "file", "line", "column", key.alias("sort_key"))


def observed_usages(obs: DataFrame, decl: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Q usages of every target, from observations: what ``usages`` makes of their merged edges, without gathering places and taking them apart again.

    Places are distinct after the first fold; one shuffle by origin then serves the edges' windows and the join.
    """
    w = Window.partitionBy(*EDGE)
    named = obs.where("target_id is not null").withColumns({c: F.when(F.col("file").isNotNull(), F.col(c)) for c in ("line", "column")})
    each = distinct_locations(named).repartition("source_id").withColumns({"confidence": F.max("confidence").over(w), "places": F.count("file").over(w)})
    # An edge without places has one row; beside places it has none for observations that name no file.
    each = each.where("file is not null or places = 0")
    origin = filters.apply(decl).select(F.col("id").alias("source_id"), F.col("label").alias("origin_label"))
    return usage_items(each.join(origin, "source_id"))


def callers(edges: DataFrame, decl: DataFrame, targets: DataFrame | str, filters: Filters = Filters()) -> DataFrame:
    return usages(edges, decl, targets, filters, ("calls",))


def hierarchy(edges: DataFrame, decl: DataFrame, symbol_id: str | None, direction: str, filters: Filters = Filters()) -> DataFrame:
    """Q hierarchy: declared neighbours in scope by inheritance and contracts; ``all`` is the union of the four directions."""
    if direction == "all":
        return reduce(DataFrame.unionByName, (hierarchy(edges, decl, symbol_id, d, filters) for d in DIRECTIONS))
    own, other = ("source_id", "target_id") if direction in OUTGOING else ("target_id", "source_id")
    hit = edges.where(F.col("relation").isin(*DIRECTIONS[direction]))
    if symbol_id is not None:
        hit = hit.where(F.col(own) == symbol_id)
    near = hit.select(F.col(own).alias("symbol_id"), F.col(other).alias("neighbour_id"), "relation", "evidence", "confidence", F.array_min("locations").alias("at"))
    first = near.groupBy("symbol_id", "relation", "neighbour_id", "evidence").agg(F.max("confidence").alias("confidence"), F.min("at").alias("at"))
    named = filters.apply(decl).select(F.col("id").alias("neighbour_id"), F.col("label").alias("neighbour_label"), symbol_kind().alias("neighbour_kind"))
    return first.join(named, "neighbour_id").select("symbol_id", F.lit(direction).alias("direction"), shown_relation(F.col("relation")).alias("relation"), "evidence", "neighbour_id", "neighbour_label", "neighbour_kind", "confidence", F.col("at.file").alias("file"), F.col("at.line").alias("line"))


def usage_summary(obs: DataFrame, decl: DataFrame, group_by: tuple[str, ...] = (), filters: Filters = Filters()) -> DataFrame:
    """Q usage-summary: edges and distinct places by relation for each target in scope, used or not.

    Grouped, a target has a row for each (project, namespace, framework) of its origins; undeclared origins are one group of
    external roots. Ungrouped, all origins count alike. Targets are declared symbols other than external roots.
    """
    if not set(group_by) <= {"project", "namespace"} or len(set(group_by)) != len(group_by):
        raise ValueError("group by project, namespace or both")
    targets = filters.apply(decl.where("node_kind <> 'external_root'")).select(F.col("id").alias("target_id"), F.col("label").alias("target_label"))
    counted = obs.where(F.col("relation").isin(*COUNTED))
    if filters != Filters():  # a scope is narrower than all declarations, so it goes before the fold
        counted = counted.join(targets.select("target_id"), "target_id", "left_semi")
    # Distinct places travel once, to their origin, and are sorted there once: for the edges, the pairs of ends and the join with the origin's group.
    ends = ["source_id", "target_id"]
    pair, edge = Window.partitionBy(*ends).orderBy("relation", "evidence"), Window.partitionBy(*EDGE).orderBy("relation", "evidence")
    places = distinct_locations(counted).select(*EDGE, F.col("file").isNotNull().cast("long").alias("occurrences")).repartition("source_id")
    places = places.withColumns({"edges": (F.row_number().over(edge) == 1).cast("long"), "origins": ((F.row_number().over(pair) == 1) & F.col("source_id").isNotNull()).cast("long")})
    places = places.select(*ends, "relation", "edges", "occurrences", "origins")
    if group_by:
        own = [*group_by, "target_framework"]
        # An origin declared several times in one group counts once as an origin, its edges as often as it is declared.
        origin = decl.select(F.col("id").alias("source_id"), *group_by, F.col("tfm").alias("target_framework")).repartition("source_id").groupBy("source_id", *own).agg(F.count("*").alias("copies"))
        places = places.join(origin, "source_id", "left").withColumns({"is_external_root": F.col("copies").isNull(), **{n: F.col(n) * F.coalesce("copies", F.lit(1)) for n in ("edges", "occurrences")}})
        keys = [*own, "is_external_root"]
    else:
        places, keys = places.withColumn("is_external_root", F.lit(False)), ["is_external_root"]
    names = [f"{r}_{x}" for r in COUNTED for x in ("edges", "occurrences")]
    total = places.groupBy("target_id", *keys).agg(*(F.sum(F.when(F.col("relation") == r, F.col(x)).otherwise(0)).alias(f"{r}_{x}") for r in COUNTED for x in ("edges", "occurrences")), F.sum("origins").alias("origins"))
    out = targets.join(total, "target_id", "left")
    zeros = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in (*names, "origins")]
    return out.select("target_id", "target_label", *(k for k in keys if k != "is_external_root"), F.coalesce("is_external_root", F.lit(False)).alias("is_external_root"), *zeros)


def arguments(sites: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Q arguments: each argument of each site with the running index among those bound to its formal; several for one formal are an expansion."""
    if edges is not None:
        sites = sites.join(edges.select("callee_id").distinct(), "callee_id", "left_semi")
    w = Window.partitionBy("site", "formal_ordinal")
    order = w.orderBy("expression_start", "expression_length", "price", "callee_id")
    many = F.count("*").over(w) > 1
    return sites.withColumns({"expansion_index": F.row_number().over(order) - 1, "argument_kind": F.when(many, "params_expansion").otherwise(F.col("argument_kind"))})


def argument_key(sites: DataFrame) -> Column:
    """Zero-padded parts, so that text order is number order; a missing formal (-1) sorts by its sign."""

    def pad(c: str, n: int) -> Column:
        return F.when(F.col(c) < 0, F.concat(F.lit("-"), F.lpad((-F.col(c)).cast("string"), n, "0"))).otherwise(F.lpad(F.col(c).cast("string"), n, "0"))

    return F.concat_ws(SEPARATOR, pad("site", 10), pad("formal_ordinal", 5), pad("expansion_index", 5), pad("expression_start", 10))


def argument_items(sites: DataFrame, snapshot: str, callee_id: str | None = None, filters: Filters = Filters(), after: str | None = None, expression: Column | None = None) -> DataFrame:
    """Q arguments in full: the 17 fields of each argument, and the sort key of eight parts.

    ``sites`` has a row an argument: caller_id, callee_id, project_key, project, file, line, column, tree_path, invocation_start, invocation_length,
    formal_id, formal_ordinal, formal_name, argument_kind, is_implicit, expression_start, expression_length, expression, expression_type,
    converted_type, constant, constant_kind, has_constant. ``after`` is the key a page begins behind: whole documents before it are skipped
    by their project and file, without a look at their arguments. ``expression`` tells how the text is made, if ``sites`` does not hold it: that
    is done behind the shuffle, and a text is sorted only where arguments of one formal have one span.
    """
    expression = F.col("expression") if expression is None else expression
    hit = sites.where(filters.document_condition())
    if callee_id is not None:
        hit = hit.where(F.col("callee_id") == callee_id)
    if after is not None:
        project, file = [*after.split(SEPARATOR), ""][:2]
        hit = hit.where((F.col("project_key") > project) | (F.col("project_key") == project) & (F.col("file") >= file))
    parts = (F.lit(snapshot), F.col("project_key"), F.col("tree_path"), F.col("invocation_start"), F.col("invocation_length"))
    hit = hit.withColumn("site", call_site_text(*parts)).withColumn("formal", F.coalesce("formal_id", "formal_name", F.lit("")))
    w, span = Window.partitionBy("site", "caller_id", "callee_id", "formal"), ["expression_start", "expression_length"]
    by_span = w.orderBy(*span)
    hit = hit.withColumns({"before": F.rank().over(by_span), "alike": F.count("*").over(by_span.rangeBetween(Window.currentRow, Window.currentRow))})
    hit = hit.withColumn("tie", F.when(F.col("alike") > 1, expression))
    nth = F.row_number().over(Window.partitionBy("site", "caller_id", "callee_id", "formal", *span).orderBy("tie"))
    hit = hit.withColumn("expansion_index", F.col("before") + nth - 2)
    hit = hit.withColumns({"head": F.substring(expression, 1, 513), "call_site_id": call_site_id(*parts)})  # all that a preview needs

    def pad(c: str, n: int) -> Column:
        v = F.coalesce(F.col(c), F.lit(-1))
        return F.when(v < 0, F.concat(F.lit("-"), F.lpad((-v).cast("string"), n, "0"))).otherwise(F.lpad(v.cast("string"), n, "0"))

    key = F.concat_ws(SEPARATOR, "project_key", "file", "tree_path", pad("invocation_start", 10), pad("invocation_length", 10), pad("formal_ordinal", 5), pad("expansion_index", 5), pad("expression_start", 10))
    span = F.when(F.col("expression_start").isNotNull(), F.struct(F.col("expression_start").alias("start"), F.col("expression_length").alias("length")))
    return hit.select(
        "caller_id", "callee_id", "call_site_id", F.struct(F.col("invocation_start").alias("start"), F.col("invocation_length").alias("length")).alias("invocation_span"),
        F.col("formal_id").alias("formal_parameter_id"), F.col("formal_ordinal").alias("formal_parameter_ordinal"), F.col("formal_name").alias("formal_parameter_name"),
        "argument_kind", "is_implicit", "expansion_index", span.alias("expression_span"), preview(F.col("head")).alias("expression_preview"), (F.length("head") > 512).alias("expression_truncated"),
        "expression_type", "converted_type", F.when(F.col("has_constant"), json_scalar(F.col("constant"), F.col("constant_kind"))).alias("constant_value"),
        F.struct("file", "line", "column").alias("location"), key.alias("sort_key"),
    )


def argument_gaps(call_edges: DataFrame, sites: DataFrame) -> DataFrame:
    """Call sites that are evidence but have no argument details."""
    return call_edges.join(sites.select("site").distinct(), "site", "left_anti")



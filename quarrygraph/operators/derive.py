"""Rules that turn symbol tables and bound operations into edges."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.lineage import cut

#: Relations that an operation of each kind yields, with the role of the member they point to.
RULES: dict[str, tuple[tuple[str, str], ...]] = {
    "invocation": (("calls", "method"), ("references", "constrained_type")),
    "object_creation": (("calls", "method"),),
    "collection_expression": (("calls", "method"),),
    "with_clone": (("calls", "method"),),
    "compound_assignment": (("calls", "operator"), ("references", "constrained_type")),
    "increment_decrement": (("calls", "operator"), ("references", "constrained_type")),
    "binary": (("calls", "operator"), ("references", "constrained_type")),
    "unary": (("calls", "operator"), ("references", "constrained_type")),
    "conversion": (("calls", "operator"), ("references", "constrained_type")),
    "range": (("calls", "method"),),
    "property_reference": (("references", "member"), ("calls", "getter"), ("calls", "setter")),
    "field_reference": (("references", "member"),),
    "event_reference": (("references", "member"),),
    "local_reference": (("references", "member"),),
    "parameter_reference": (("references", "member"),),
    "method_group": (("references", "member"),),
    "event_assignment": (("calls", "add"), ("calls", "remove")),
    "branch": (("references", "member"),),
    "case_label": (("references", "member"),),
    "typeof": (("references", "member"),),
    "sizeof": (("references", "member"),),
    "is_type": (("references", "member"),),
    "implicit_indexer": (("references", "length"), ("calls", "indexer")),
    "list_pattern": (("references", "length"), ("calls", "indexer"), ("calls", "slice")),
    "recursive_pattern": (("calls", "deconstruct"), ("references", "member")),
    "function_pointer": (("calls", "method"),),
    "interpolated_handler": (("calls", "method"),),
    "foreach": (("calls", "get_enumerator"), ("calls", "move_next"), ("references", "current"), ("calls", "dispose")),
    "foreach_async": (("calls", "get_enumerator"), ("calls", "move_next"), ("references", "current"), ("calls", "dispose"), ("calls", "get_awaiter"), ("references", "is_completed"), ("calls", "get_result"), ("calls", "on_completed")),
    "await": (("calls", "get_awaiter"), ("references", "is_completed"), ("calls", "get_result"), ("calls", "on_completed")),
    "using": (("calls", "dispose"),),
    "using_async": (("calls", "dispose"), ("calls", "get_awaiter"), ("references", "is_completed"), ("calls", "get_result"), ("calls", "on_completed")),
    "fixed": (("calls", "get_pinnable_reference"),),
    "deconstruction": (("calls", "deconstruct"),),
    "name_syntax": (("references", "member"),),
    "alias_use": (("references", "alias"),),
}


def accessor_use(parent: Column, is_target: Column) -> Column:
    """How a property is used, by the operation around it."""
    return F.when(parent.isin("increment_decrement", "compound_assignment"), "read_write").when((parent == "assignment") & is_target, "write").otherwise("read")


def rules_of(op_kind: Column) -> Column:
    """What ``RULES`` says of a kind, an array of (relation, role): an expression, so that rows no rule asks for end before any join."""
    return F.create_map(*(x for k, v in RULES.items() for x in (F.lit(k), F.array(*(F.struct(F.lit(r).alias("relation"), F.lit(role).alias("role")) for r, role in v)))))[op_kind]


def operation_edges(ops: DataFrame, declared: DataFrame) -> DataFrame:
    """Edges of bound operations: rows (op_kind, caller_id, role, member_id, use, is_declaration, adds, file, line, column), one a member.

    Instead of role and member_id a row may have ``members``, an array of (member_id, roles): one row an operation then, whose caller is looked up
    before its members are taken apart.

    A rule fires for a role of its kind; getters fire on reads, setters on writes, add and remove by the assignment's direction, locals
    only where they are not declared. Caller, target and place are all required. Every edge is extracted with confidence 1.
    """
    ids = declared.select("id")
    caller, member = (ids.withColumnRenamed("id", c) for c in ("caller_id", "member_id"))
    nested = "members" in ops.columns
    if nested:
        ops = ops.join(caller, "caller_id", "left_semi")
    hit = ops.withColumn("rule", F.explode(rules_of(F.col("op_kind"))))
    role = F.col("rule.role")
    fires = F.when(role == "getter", F.col("use").isin("read", "read_write")).when(role == "setter", F.col("use").isin("write", "read_write")).when(role == "add", F.col("adds")).when(role == "remove", ~F.col("adds")).when(F.col("op_kind") == "local_reference", ~F.col("is_declaration")).otherwise(F.lit(True))
    hit = hit.where(fires & F.col("file").isNotNull())
    if nested:
        hit = hit.withColumn("member_id", F.explode(F.filter("members", lambda m: F.array_contains(m["roles"], role))["member_id"]))
    else:
        hit = hit.where(F.col("role") == role)
    hit = hit.select("caller_id", "member_id", "rule.relation", "file", "line", "column")
    hit = (hit if nested else hit.join(caller, "caller_id", "left_semi")).join(member, "member_id", "left_semi")
    return hit.select(F.col("caller_id").alias("source_id"), F.col("member_id").alias("target_id"), "relation", F.lit("extracted").alias("evidence"), F.lit(1.0).alias("confidence"), "file", "line", "column")


def unique_matches(references: DataFrame, decl: DataFrame, key: str) -> DataFrame:
    """References resolved by a key that exactly one declaration has; two candidates are no match."""
    one = decl.groupBy(key).agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")
    return references.join(one, key)


def resolve(references: DataFrame, steps: list[tuple[DataFrame, str]]) -> DataFrame:
    """``id`` of the first step (unique table, key) that matches a reference; references no step matches keep null."""
    out = references.withColumn("id", F.lit(None).cast("string"))
    for i, (decl, key) in enumerate(steps):
        one = decl.groupBy(key).agg(F.count("*").alias("n"), F.min("id").alias(f"__{i}")).where("n = 1").drop("n")
        out = out.join(one, key, "left").withColumn("id", F.coalesce("id", f"__{i}")).drop(f"__{i}")
    return out


def innermost(positions: DataFrame, symbols: DataFrame, bucket: int = 64) -> DataFrame:
    """The innermost symbol [start, end) of the same file around each position.

    A range join made an equi-join: a symbol is entered in each bucket of positions it reaches into, a position looks up its own.
    """
    spread = symbols.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket)))).withColumnRenamed("id", "symbol_id")
    at = positions.withColumn("bucket", F.floor(F.col("position") / bucket))
    inside = at.join(spread, ["file", "bucket"]).where("start <= position and position < end")
    best = F.min_by(F.struct("symbol_id", "start", "end"), F.struct(F.col("end") - F.col("start"), "symbol_id"))
    return inside.groupBy(*positions.columns).agg(best.alias("b")).select(*positions.columns, "b.symbol_id")


def closure(edges: DataFrame) -> DataFrame:
    """(start, reached, depth): everything reachable from each start, least depth; cycles end where nothing new is found."""
    frontier = cut(edges.selectExpr("source_id as start", "target_id as reached", "1 as depth").distinct())
    known = frontier
    step = cut(edges.selectExpr("source_id as reached", "target_id as next").distinct())
    for depth in count(2):
        new = frontier.join(step, "reached").selectExpr("start", "next as reached", f"{depth} as depth").distinct().join(known.select("start", "reached"), ["start", "reached"], "left_anti")
        new = cut(new)
        if new.isEmpty():
            break
        known, frontier = known.unionByName(new.select("start", "reached", "depth")), new
        known = cut(known) if depth % 16 == 0 else known
    return known


def interface_edges(types: DataFrame) -> DataFrame:
    """implements: transitive over all interfaces (rows kind = 'interface'); inherits: the direct base only."""
    i = types.where("kind = 'interface'")
    reach = closure(i)
    base = types.where("kind = 'base'").selectExpr("source_id", "target_id", "'inherits' as relation")
    return reach.selectExpr("start as source_id", "reached as target_id", "'implements' as relation").unionByName(base).distinct()


def implemented_members(reach: DataFrame, members: DataFrame) -> DataFrame:
    """A type's member implements the members of one signature of every interface it reaches."""
    own = members.select(F.col("type_id").alias("start"), "signature", F.col("id").alias("source_id"))
    other = members.select(F.col("type_id").alias("reached"), "signature", F.col("id").alias("target_id"))
    return reach.join(own, "start").join(other, ["reached", "signature"]).selectExpr("source_id", "target_id", "'implements' as relation")


def lookup_member(reach: DataFrame, members: DataFrame) -> DataFrame:
    """For each (type, name): the member found first, own type before bases by depth, then by rank and label."""
    scope = reach.select("start", "reached", "depth").unionByName(members.selectExpr("type_id as start", "type_id as reached", "0 as depth").distinct())
    found = scope.join(members.withColumnRenamed("type_id", "reached"), "reached")
    best = F.min_by("id", F.struct("depth", "rank", "label"))
    return found.groupBy("start", "name").agg(best.alias("member_id"), F.min("depth").alias("depth"))


def split_recoverable(rows: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, diagnostics): a row whose problem text is not null becomes a diagnostic and the rest is kept."""
    marked = rows.withColumn("problem", problem)
    return marked.where("problem is null").drop("problem"), marked.where("problem is not null").select(F.col("problem").alias("diagnostic"))


def declaration_kind(kind: Column, type_kind: Column) -> Column:
    return F.when(kind == "namedtype", F.lower(type_kind)).otherwise(kind)


def declaration_flags(closed: Column, entry_point: Column) -> Column:
    """The flags of a declaration that hold, as properties."""
    flags = F.array(F.struct(F.lit("is_closed").alias("key"), closed.alias("on")), F.struct(F.lit("is_entry_point").alias("key"), entry_point.alias("on")))
    held = F.filter(flags, lambda f: F.coalesce(f["on"], F.lit(False)))
    return F.map_from_entries(F.transform(held, lambda f: F.struct(f["key"], F.lit("true").alias("value"))))


def source_symbols(rows: DataFrame, sources: DataFrame, implicit: bool = False) -> DataFrame:
    """Symbols (name, file, is_implicit, is_generated) that sources (path) declare: named ones, none that the compiler made up."""
    named = rows.where((F.trim("name") != "") & ~F.col("is_generated"))
    named = named if implicit else named.where(~F.col("is_implicit"))
    return named.join(sources.select(F.col("path").alias("file")).distinct(), "file", "left_semi")


def member_edges(members: DataFrame) -> DataFrame:
    """What a member (id, overridden_id, interface_members array) overrides and explicitly implements."""
    over = members.where("overridden_id is not null").selectExpr("id as source_id", "overridden_id as target_id", "'overrides' as relation")
    explicit = members.select(F.col("id").alias("source_id"), F.explode("interface_members").alias("target_id")).withColumn("relation", F.lit("implements"))
    return over.unionByName(explicit).distinct()


def union_cases(types: DataFrame) -> DataFrame:
    """References of union types (id, cases array) to their cases."""
    return types.select(F.col("id").alias("source_id"), F.explode("cases").alias("target_id")).withColumn("relation", F.lit("references")).distinct()


def unpacked_arguments(sites: DataFrame) -> DataFrame:
    """A row an argument of each call site (arguments array); a site without arguments has a ``no_arguments`` marker."""
    a = sites.select("*", F.posexplode_outer("arguments").alias("argument_position", "argument")).drop("arguments")
    kind = F.when(F.col("argument").isNull(), "no_arguments").when(F.col("extension") & (F.col("argument_position") == 0), "extension_receiver").otherwise("explicit")
    return a.withColumn("argument_kind", kind)


def window_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def name_references(names: DataFrame, invoked: DataFrame) -> DataFrame:
    """References of names (name_id, caller_id, target_id, alias_id): not those that are the name of an invoked method; a use of an alias also refers to it."""
    plain = names.join(invoked.select("name_id").distinct(), "name_id", "left_anti").where("target_id is not null")
    alias = names.where("alias_id is not null")
    return plain.selectExpr("caller_id as source_id", "target_id", "'references' as relation").unionByName(alias.selectExpr("caller_id as source_id", "alias_id as target_id", "'references' as relation"))


def operation_roots(operations: DataFrame) -> DataFrame:
    """Operations (tree, path) with no other operation above them in their tree, each once."""
    above = F.expr("transform(sequence(1, greatest(size(split(path, '/')) - 1, 1)), i -> array_join(slice(split(path, '/'), 1, i), '/'))")
    once = operations.select("tree", "path").distinct()
    covered = once.select("tree", "path", F.explode(above).alias("up")).where("up <> path").join(once.select("tree", F.col("path").alias("up")), ["tree", "up"]).select("tree", "path").distinct()
    return once.join(covered, ["tree", "path"], "left_anti")


def constraint_edges(parameters: DataFrame, aliases: DataFrame) -> DataFrame:
    """References of type parameters (id, constraints array) to their constraints and of aliases (id, target_id) to their targets."""
    bound = parameters.select(F.col("id").alias("source_id"), F.explode("constraints").alias("target_id"))
    return bound.unionByName(aliases.select(F.col("id").alias("source_id"), "target_id")).withColumn("relation", F.lit("references")).distinct()


def event_accessor(adds: Column, add_id: Column, remove_id: Column) -> Column:
    return F.when(adds, add_id).otherwise(remove_id)


def first_method(methods: DataFrame) -> DataFrame:
    """The first method below each function pointer's target (pointer_id, method_id, position)."""
    return methods.groupBy("pointer_id").agg(F.min_by("method_id", F.struct("position", "method_id")).alias("method_id"))


def dispose_target(direct: Column, by_interface: Column) -> Column:
    """What a using statement calls: the type's own Dispose, else its interface's."""
    return F.coalesce(direct, by_interface)

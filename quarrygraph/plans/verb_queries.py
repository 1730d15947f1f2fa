"""More registered queries: full items of the verbs, filters, evidence by each rule, and identities, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.functions import identity as I
from quarrygraph.operators import derive, filters, merge, verbs
from quarrygraph.operators.filters import Filters
from quarrygraph.plans import oracle as o
from quarrygraph.plans.registry import CUSTOMER, NATION, _hierarchy, _near, query
from quarrygraph.schema import RELATIONS
from quarrygraph.sources import facts, star

SNAPSHOT = "s:1"

# Verbs


@query(o.sql([o.DECL, o.OBS], f"select * from ({_near('implementations', NATION)}) where neighbour_kind = 'operator' and neighbour_id in (select id from decl where file = 'customer' or starts_with(file, 'customer/'))"))
def hierarchy_filtered(spark: SparkSession, d: str) -> DataFrame:
    obs = star.observations(spark, d, ("hierarchy",))
    return verbs.hierarchy(merge.merged_edges(obs), star.declarations(spark, d), NATION, "implementations", Filters(kind="operator", path="./customer/", root="/r"))


_MODIFIERS = "concat_ws(' ', {})"
_SIGNATURES = """sig as (
  select 'supplier:' || s_suppkey as id, if(s_suppkey % 2 = 0, 'internal', 'public') as accessibility, concat_ws(' ', if(s_suppkey % 3 = 0, 'static', null), if(s_suppkey % 5 = 0, 'abstract', null), if(s_suppkey % 7 = 0, 'sealed', null)) as modifiers, 'N' as containing, s_name as type, null as return_type, '' as parameters, if(s_suppkey % 4 = 0, '0:T:IA,IB', '') as generics, if(s_suppkey % 2 = 0, 'annotated', 'notannotated') as nullable_annotation from supplier
  union all select 'customer:' || c_custkey, 'public', concat_ws(' ', if(c_custkey % 2 = 0, 'static', null), if(c_custkey % 3 = 0, 'override', null), if(c_custkey % 4 = 0, 'readonly', null)), 'T' || c_nationkey, null, if(c_custkey % 4 = 1, null, c_mktsegment), if(c_custkey % 3 = 0, '', '0:a:int:none:;1:b:string:ref:"x"'), '', 'none' from customer
  union all select 'part:' || p_partkey, 'private', concat_ws(' ', if(p_size % 3 = 0, 'static', null), if(p_size % 2 = 0, 'virtual', null)), p_brand, null, p_type, '', '', 'none' from part)"""


def _signature(df: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("parameters", lambda p: F.concat_ws(":", p["ordinal"].cast("string"), p["name"], p["type"], p["ref_kind"], F.coalesce(p["default"], F.lit("")))), ";")
    generic = F.array_join(F.transform("generic_parameters", lambda p: F.concat_ws(":", p["ordinal"].cast("string"), p["name"], F.array_join(p["constraint_types"], ","))), ";")
    return df.select("id", "label", "kind", "accessibility", F.array_join("modifiers", " ").alias("modifiers"), "containing", "type", "return_type", text.alias("parameters"), generic.alias("generics"), "nullable_annotation")


@query(o.sql([o.DECL, _SIGNATURES], "select id, label, kind, sig.* exclude (id) from sig join kinds using (id)"))
def signature_items(spark: SparkSession, d: str) -> DataFrame:
    return _signature(verbs.signature_items(star.signature_facts(spark, d), star.declarations(spark, d)))


@query(o.sql([o.DECL, _SIGNATURES], f"select id, label, kind, sig.* exclude (id) from sig join kinds using (id) where id = '{CUSTOMER}'"))
def signature_item(spark: SparkSession, d: str) -> DataFrame:
    return _signature(verbs.signature_items(star.signature_facts(spark, d), star.declarations(spark, d), CUSTOMER))


_ARGUMENTS = f"""a as (select *, 'customer:' || o_custkey as caller_id, 'part:' || l_partkey as callee_id, 'project=src/p' || (l_orderkey % 5) as project_key, 'src/p' || (l_orderkey % 5) || '.csproj' as project, 'orders/' || (l_orderkey % 500) || '.cs' as file, cast(l_quantity as bigint) as len, l_partkey * 100 + l_suppkey as es, repeat('x' || l_suppkey, cast(l_quantity as int) * 10) as ex from lineitem join orders on l_orderkey = o_orderkey),
b as (select *, 'call-' || sha256(concat_ws(chr(31), '{SNAPSHOT}', project_key, 'gen/' || file, l_orderkey, len)) as call_site_id, if(l_linenumber = 1, -1, l_linenumber - 1) as fo from a),
c as (select *, row_number() over (partition by call_site_id, caller_id, callee_id, l_linenumber order by es, l_linenumber, ex)::int - 1 as expansion_index from b),
items as (select caller_id, callee_id, call_site_id, l_orderkey as invocation_start, len as invocation_length, if(fo < 0, null, 'formal:' || l_linenumber) as formal_parameter_id, if(fo < 0, null, fo)::int as formal_parameter_ordinal, if(fo < 0, null, 'p' || l_linenumber) as formal_parameter_name, if(fo < 0, 'extension_receiver', 'explicit') as argument_kind, l_linestatus = 'O' as is_implicit, expansion_index, es as expression_start, l_linenumber::bigint as expression_length, if(length(ex) > 512, ex[1:512] || '…', ex) as expression_preview, length(ex) > 512 as expression_truncated, 'int' as expression_type, if(fo < 0, null, 'long') as converted_type, case when l_linenumber % 2 = 0 then case l_returnflag when 'A' then l_suppkey::varchar when 'N' then '"say \\""' else 'null' end end as constant_value, file, l_linenumber::int as line, 1 as "column", project,
  concat_ws(chr(31), project_key, file, 'gen/' || file, lpad(l_orderkey::varchar, 10, '0'), lpad(len::varchar, 10, '0'), if(fo < 0, '-00001', lpad(fo::varchar, 5, '0')), lpad(expansion_index::varchar, 5, '0'), lpad(es::varchar, 10, '0')) as sort_key from c)"""


def _arguments(df: DataFrame) -> DataFrame:
    flat = df.withColumns({"invocation_start": F.col("invocation_span.start"), "invocation_length": F.col("invocation_span.length"), "expression_start": F.col("expression_span.start"), "expression_length": F.col("expression_span.length"), "file": F.col("location.file"), "line": F.col("location.line"), "column": F.col("location.column")})
    return flat.drop("invocation_span", "expression_span", "location")


@query(o.sql([_ARGUMENTS], "select * exclude (project) from items"))
def argument_items(spark: SparkSession, d: str) -> DataFrame:
    return _arguments(verbs.argument_items(star.argument_facts(spark, d), SNAPSHOT, expression=star.argument_text()))


@query(o.sql([_ARGUMENTS], "select * exclude (project) from items where project = 'src/p3.csproj' and (file = 'orders/13.cs' or starts_with(file, 'orders/13.cs/'))"))
def argument_items_in_document(spark: SparkSession, d: str) -> DataFrame:
    return _arguments(verbs.argument_items(star.argument_facts(spark, d), SNAPSHOT, expression=star.argument_text(), filters=Filters(project="/r/src/p3.csproj", path="/r/x/../orders/13.cs", root="/r")))


@query(o.sql([_ARGUMENTS], "select * exclude (project) from items where sort_key > 'project=src/p3' || chr(31) || 'orders/13.cs' order by sort_key limit 50"))
def argument_page(spark: SparkSession, d: str) -> DataFrame:
    from quarrygraph.plans.paging import page

    after = I.SEPARATOR.join(["project=src/p3", "orders/13.cs"])
    return _arguments(page(verbs.argument_items(star.argument_facts(spark, d), SNAPSHOT, expression=star.argument_text(), after=after), "sort_key", after, 50))


@query(o.sql([o.DECL], "select id, label, kind, namespace, project, tfm, file, line, \"column\", is_entry_point, label || chr(31) || id as sort_key from kinds where node_kind <> 'external_root' and (file = 'supplier' or starts_with(file, 'supplier/') or starts_with(id, 'customer:') and ends_with(id, '7'))"))
def symbols_by_any_place(spark: SparkSession, d: str) -> DataFrame:
    """A path that any place of a symbol may be on: partial types have several."""
    second = F.when(F.col("id").startswith("customer:") & F.col("id").endswith("7"), F.struct(F.lit("supplier/part.cs").alias("file"), F.lit(1).alias("line"), F.lit(1).alias("column")))
    decl = star.declarations(spark, d).withColumn("locations", F.array_compact(F.array(F.struct("file", "line", "column"), second)))
    return verbs.symbols(decl, Filters(path="supplier"))


@query(o.sql([o.OBS], "select row_number() over (order by source_id, target_id, list_position(['calls', 'references', 'inherits', 'implements', 'overrides', 'dispatches_to'], relation), evidence) as place, source_id, target_id, relation, evidence from edges order by place limit 1000"))
def edges_ordered(spark: SparkSession, d: str) -> DataFrame:
    """The first edges in a snapshot's order, as a report."""
    from pyspark.sql import Window

    first = merge.snapshot_order(merge.edge_counts(star.observations(spark, d))).limit(1000)
    w = Window.orderBy("source_id", "target_id", merge.ordinal(F.col("relation"), RELATIONS), "evidence")  # 1000 rows
    return first.select(F.row_number().over(w).cast("long").alias("place"), "source_id", "target_id", "relation", "evidence")


# Evidence by rule

#: The operations of each rule, and the members an operation of each kind has edges to, as the rules are stated.
EVIDENCE: dict[str, dict[str, str]] = {
    "creations": {"object_creation": "calls method", "collection_expression": "calls method", "with_clone": "calls method"},
    "operators": {k: "calls operator, references constrained_type" for k in ("compound_assignment", "increment_decrement", "binary", "unary", "conversion")},
    "ranges": {"range": "calls method"},
    "references": {"field_reference": "references member", "event_reference": "references member", "local_reference": "references member", "parameter_reference": "references member", "method_group": "references member"},
    "properties": {"property_reference": "references member, calls getter, calls setter"},
    "event_accessors": {"event_assignment": "calls add, calls remove"},
    "targets": {k: "references member" for k in ("branch", "case_label", "typeof", "sizeof", "is_type")},
    "patterns": {"implicit_indexer": "references length, calls indexer", "list_pattern": "references length, calls indexer, calls slice", "recursive_pattern": "calls deconstruct, references member"},
    "function_pointers": {"function_pointer": "calls method"},
    "interpolations": {"interpolated_handler": "calls method"},
    "loops": {"foreach": "calls get_enumerator, calls move_next, references current, calls dispose", "foreach_async": "calls get_enumerator, calls move_next, references current, calls dispose, calls get_awaiter, references is_completed, calls get_result, calls on_completed"},
    "awaits": {"await": "calls get_awaiter, references is_completed, calls get_result, calls on_completed"},
    "disposals": {"using": "calls dispose", "using_async": "calls dispose, calls get_awaiter, references is_completed, calls get_result, calls on_completed"},
    "fixed_and_deconstruction": {"fixed": "calls get_pinnable_reference", "deconstruction": "calls deconstruct"},
    "invocations": {"invocation": "calls method, references constrained_type"},
}
_ROLES = ["method", "constrained_type", "operator", "member", "getter", "setter", "add", "remove", "length", "indexer", "slice", "deconstruct", "get_enumerator", "move_next", "current", "dispose", "get_awaiter", "is_completed", "get_result", "on_completed", "get_pinnable_reference", "alias"]


def _evidence(rules: dict[str, str]) -> str:
    kinds = list(rules)
    rows = ", ".join(f"({kinds.index(k)}, '{k}', '{rel}', '{role}', {_ROLES.index(role) % 2})" for k, v in rules.items() for rel, role in (x.split() for x in v.split(", ")))
    return f"""with r(n, kind, relation, role, odd) as (values {rows}),
ops as (select * from lineitem join orders on l_orderkey = o_orderkey join r on r.n = (l_orderkey + l_linenumber) % {len(kinds)} where o_orderstatus <> 'P' and l_returnflag <> 'R')
select 'customer:' || o_custkey as source_id, if(odd = 1, 'supplier:' || l_suppkey, 'part:' || l_partkey) as target_id, relation, 'extracted' as evidence, 1.0::double as confidence, 'orders/' || l_orderkey || '.cs' as file, l_linenumber::int as line, 1 as "column"
from ops where case role when 'getter' then l_linenumber % 3 <> 1 when 'setter' then l_linenumber % 3 <> 0 when 'add' then l_linestatus = 'O' when 'remove' then l_linestatus <> 'O' else kind <> 'local_reference' or l_linenumber % 2 = 1 end"""


def _add_evidence(name: str, rules: dict[str, str]) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return derive.operation_edges(star.operations(spark, d, tuple(rules)), star.declarations(spark, d))

    f.__name__ = f"evidence_{name}"
    query(_evidence(rules))(f)


for _name, _rules in EVIDENCE.items():
    _add_evidence(_name, _rules)


@query("select l_orderkey as pointer_id, l_partkey as method_id from lineitem qualify row_number() over (partition by l_orderkey order by l_suppkey, l_partkey) = 1")
def first_methods(spark: SparkSession, d: str) -> DataFrame:
    l = star.table(spark, d, "lineitem")
    return derive.first_method(l.select(F.col("l_orderkey").alias("pointer_id"), F.col("l_partkey").alias("method_id"), F.col("l_suppkey").alias("position")))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, if(l_linestatus = 'O', 'add' || l_partkey, 'remove' || l_partkey) as accessor, coalesce(if(l_returnflag = 'A', 'own' || l_suppkey, null), 'interface' || l_suppkey) as dispose from lineitem")
def accessors_and_disposal(spark: SparkSession, d: str) -> DataFrame:
    key = lambda word, c: F.concat(F.lit(word), F.col(c).cast("string"))
    accessor = derive.event_accessor(F.col("l_linestatus") == "O", key("add", "l_partkey"), key("remove", "l_partkey"))
    dispose = derive.dispose_target(F.when(F.col("l_returnflag") == "A", key("own", "l_suppkey")), key("interface", "l_suppkey"))
    return star.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", accessor.alias("accessor"), dispose.alias("dispose"))


@query("select 'customer:' || c_custkey as source_id, 'customer:' || (c_custkey // 2) as target_id, 'overrides' as relation from customer where c_custkey % 2 = 0 union select 'customer:' || c_custkey, 'nation:' || (c_nationkey + i), 'implements' from customer, range(0, 2) t(i)")
def member_edges(spark: SparkSession, d: str) -> DataFrame:
    c = star.table(spark, d, "customer")
    over = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("customer:"), F.floor(F.col("c_custkey") / 2).cast("string")))
    two = F.array(*(F.concat(F.lit("nation:"), (F.col("c_nationkey") + i).cast("string")) for i in (0, 1)))
    return derive.member_edges(c.select(star.ident("customer", "c_custkey").alias("id"), over.alias("overridden_id"), two.alias("interface_members")))


@query("select distinct 'supplier:' || s_suppkey as source_id, 'nation:' || n as target_id, 'references' as relation from supplier, (select unnest([0, 1]) as i) t, lateral (select (s_nationkey + i) % 25 as n)")
def union_cases(spark: SparkSession, d: str) -> DataFrame:
    two = F.array(*(F.concat(F.lit("nation:"), ((F.col("s_nationkey") + i) % 25).cast("string")) for i in (0, 1)))
    return derive.union_cases(star.table(spark, d, "supplier").select(star.ident("supplier", "s_suppkey").alias("id"), two.alias("cases")))


@query("with a as (select l_orderkey as site, list(l_partkey order by l_linenumber, l_partkey, l_suppkey) as xs from lineitem group by 1), s as (select o_orderkey as site, coalesce(xs, []) as xs, o_orderstatus = 'O' as extension from orders left join a on site = o_orderkey), e as (select site, extension, unnest(xs) as argument, generate_subscripts(xs, 1)::int - 1 as argument_position from s union all select site, extension, null, null from s where len(xs) = 0) select site, argument_position, argument, case when argument is null then 'no_arguments' when extension and argument_position = 0 then 'extension_receiver' else 'explicit' end as argument_kind from e")
def argument_unpacking(spark: SparkSession, d: str) -> DataFrame:
    l = star.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x["l_partkey"]).alias("xs"))
    s = star.table(spark, d, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    sites = s.select(F.col("o_orderkey").alias("site"), F.coalesce("xs", F.array().cast("array<bigint>")).alias("arguments"), (F.col("o_orderstatus") == "O").alias("extension"))
    return derive.unpacked_arguments(sites).select("site", "argument_position", "argument", "argument_kind")


@query("select p_partkey, if(p_size % 3 = 0, ['class', 'struct', 'enum'][p_size % 3 + 1], ['method', 'property'][p_size % 2 + 1]) as kind, concat_ws(',', if(p_size % 5 = 0, 'is_closed=true', null), if(p_size % 7 = 0, 'is_entry_point=true', null)) as flags from part")
def declaration_kinds(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    kind = F.when(size % 3 == 0, "namedtype").otherwise(F.element_at(F.array(F.lit("method"), F.lit("property")), (size % 2 + 1).cast("int")))
    type_kind = F.element_at(F.array(F.lit("Class"), F.lit("Struct"), F.lit("Enum")), (size % 3 + 1).cast("int"))
    flags = F.map_entries(derive.declaration_flags(size % 5 == 0, size % 7 == 0))
    return star.table(spark, d, "part").select("p_partkey", derive.declaration_kind(kind, type_kind).alias("kind"), F.array_join(F.transform(F.array_sort(flags), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("flags"))


@query("select doc_id from documents where source in ('src1', 'src2') and doc_id % 3 <> 0 and doc_id % 5 <> 0 and doc_id % 7 <> 0")
def source_symbols(spark: SparkSession, d: str) -> DataFrame:
    docs = star.table(spark, d, "documents")
    i = F.col("doc_id")
    rows = docs.select("doc_id", F.when(i % 3 == 0, " ").otherwise("n").alias("name"), F.col("source").alias("file"), (i % 5 == 0).alias("is_implicit"), (i % 7 == 0).alias("is_generated"))
    return derive.source_symbols(rows, docs.select(F.col("source").alias("path")).where("source in ('src1', 'src2')")).select("doc_id")


@query("select user_id as operation, event_id as mark_id from events e where event_type <> 'error' and exists (select 1 from events f where f.user_id = e.user_id and f.event_type = 'error' and f.ts < e.ts) or event_type = 'error' and exists (select 1 from events f where f.user_id = e.user_id and f.event_type = 'error' and f.ts < e.ts)")
def late_marks(spark: SparkSession, d: str) -> DataFrame:
    from quarrygraph.streaming.observe import ignored_late

    e = star.table(spark, d, "events").select(F.col("user_id").alias("operation"), F.col("event_id").alias("mark_id"), "ts", F.when(F.col("event_type") == "error", "end").otherwise("go").alias("stage"))
    return ignored_late(e).select("operation", "mark_id")


# Identities and paths


@query("select c_custkey, if(c_custkey % 2 = 0, '/', '') || case c_custkey % 4 when 0 then 'a/' || c_nationkey || '/c.cs' when 1 then '../' || c_nationkey when 2 then c_mktsegment || '/d' else 'b' end as path from customer")
def canonical_paths(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("c_custkey") % 4, F.col("c_nationkey").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("/a/./x/../"), n, F.lit("//c.cs"))).when(k == 1, F.concat(F.lit("./q/../../"), n)).when(k == 2, F.concat(F.lit("/\\u\\..\\"), "c_mktsegment", F.lit("/d/"))).otherwise("a/../b/./")
    return star.table(spark, d, "customer").select("c_custkey", I.canonical_path(raw).alias("path"))


@query("select p_partkey, 'Ordinary:' || p_name || '`' || (p_size % 3) || '(int,ref:' || replace(p_type, ' ', '') || '):' || replace(p_brand, ' ', '') as method, 'Constructor:.ctor`0():' as constructor, 'property:' || p_name || '(int):' || replace(p_type, ' ', '') as property, 'event:' || p_name || ':' || p_brand as event, 'extension:' || p_brand as extension from part")
def signature_texts(spark: SparkSession, d: str) -> DataFrame:
    param = lambda t, m: I.parameter_text(F.struct(t.alias("type"), F.lit(m).alias("modifier")))
    both = F.array(param(F.lit("int"), "none"), param(F.col("p_type"), "ref"))
    none = F.array().cast("array<string>")
    return star.table(spark, d, "part").select(
        "p_partkey", I.method_signature(F.lit("Ordinary"), F.col("p_name"), F.col("p_size") % 3, both, F.col("p_brand")).alias("method"), I.method_signature(F.lit("Constructor"), F.lit(".ctor"), F.lit(0), none, F.col("p_brand")).alias("constructor"),
        I.property_signature(F.col("p_name"), F.array(param(F.lit("int"), "none")), F.col("p_type")).alias("property"), I.typed_signature("event", F.col("p_name"), F.col("p_brand")).alias("event"), I.extension_signature(F.col("p_brand")).alias("extension"),
    )


@query("select o_orderkey, if(o_custkey % 2 = 0, 'mapped/' || o_custkey || '.cs', if(o_custkey % 3 = 0, null, 'p.cs')) as file, if(o_custkey % 2 = 0 or o_custkey % 3 <> 0, 7, null)::int as line, if(o_custkey % 3 = 0, '@syntax=a.b', 'source=p.cs@' || o_orderkey || ':5') as discriminator, coalesce(if(o_custkey % 5 = 0, 'def' || o_custkey, null), 'own' || o_orderkey) as definition, concat_ws(chr(31), 'method', o_orderpriority, 'f.cs', o_orderkey, 5) as position_key from orders")
def source_identities(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_custkey")
    path = F.when(k % 3 != 0, F.lit("p.cs"))
    place = facts.mapped_location(F.when(k % 2 == 0, F.concat(F.lit("mapped/"), k.cast("string"), F.lit(".cs"))).otherwise(""), path, F.lit(7), F.lit(1))
    start = F.col("o_orderkey")
    return star.table(spark, d, "orders").withColumn("at", place).select(
        "o_orderkey", "at.file", "at.line", facts.source_discriminator(path, start, F.lit(5), F.array(F.lit("a"), F.lit("b"))).alias("discriminator"),
        facts.definition_id(F.concat(F.lit("own"), start.cast("string")), F.when(k % 5 == 0, F.concat(F.lit("def"), k.cast("string")))).alias("definition"), I.source_symbol_key(F.lit("method"), F.col("o_orderpriority"), F.lit("f.cs"), start, F.lit(5)).alias("position_key"),
    )


@query("select s_suppkey, 'a=' || hex(encode(s_name)) || chr(31) || 'b=' || hex(encode('é' || s_nationkey)) as options, case when s_suppkey % 4 = 0 then 'null' when s_suppkey % 4 = 1 then 'true' when s_suppkey % 4 = 2 then s_nationkey::varchar else '\"' || s_name || '\\n\"' end as constant from supplier")
def options_and_constants(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("s_suppkey") % 4, F.col("s_nationkey").cast("string")
    options = F.create_map(F.lit("b"), F.concat(F.lit("é"), n), F.lit("a"), F.col("s_name"))
    value = F.when(k == 1, "True").when(k == 2, n).when(k == 3, F.concat("s_name", F.lit("\n")))
    kind = F.when(k == 1, "bool").when(k == 2, "number").otherwise("string")
    return star.table(spark, d, "supplier").select("s_suppkey", I.options_key(options).alias("options"), I.json_scalar(value, kind).alias("constant"))


@query("with f as (select 'd' || doc_id || ['.cs', '.CSPROJ', '.txt', '/global.json', '/Directory.Build.props', '.props'][doc_id % 6 + 1] as path from documents) select path, doc_id % 6 <> 2 as conventional from f join documents on starts_with(path, 'd' || doc_id || '.') or starts_with(path, 'd' || doc_id || '/')")
def conventional_files(spark: SparkSession, d: str) -> DataFrame:
    tail = F.element_at(F.array(*map(F.lit, (".cs", ".CSPROJ", ".txt", "/global.json", "/Directory.Build.props", ".props"))), (F.col("doc_id") % 6 + 1).cast("int"))
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), tail)
    return star.table(spark, d, "documents").select(path.alias("path"), filters.conventional_file(path).alias("conventional"))


@query(o.sql([o.INVENTORY], "select path, false as is_directory from cur where project <> 'src4' and (regexp_matches(path, '^src1/[^/]*\\.txt$') and not regexp_matches(path, '^src1/2[^/]*\\.txt$') or ends_with(path, '7.txt')) union all select distinct project, true from cur where project <> 'src4' and (project = 'src1' or project in (select project from cur where ends_with(path, '7.txt')))"))
def inventory_scope(spark: SparkSession, d: str) -> DataFrame:
    cur = star.inventory(spark, d, "current")
    entries = cur.select("path", F.lit(False).alias("is_directory")).unionByName(cur.select(F.col("project").alias("path"), F.lit(True).alias("is_directory")).distinct())
    return filters.inventory_scope(entries, cur.where("endswith(path, '7.txt')").select("path"), ["src1/*.txt"], ["src1/2*.txt"], ["src4"])


@query("with recursive x as (select 1::bigint as project union select c_custkey::bigint from customer join x on c_custkey - 1 = project where c_custkey <= 70) select project from x")
def dirty_closure_deep(spark: SparkSession, d: str) -> DataFrame:
    """A chain of 70 projects, each of which refers to the one before it."""
    from quarrygraph.operators.incremental import reverse_closure

    c = star.table(spark, d, "customer").where("c_custkey <= 70").select(F.col("c_custkey").cast("long").alias("project"), (F.col("c_custkey") - 1).cast("long").alias("refers_to"))
    return reverse_closure(c.where("project = 1").select("project"), c)

"""The engine's registered queries over the star schema's evidence, each with the same query in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.functions import identity as I
from quarrygraph.operators import derive, incremental, merge, verbs
from quarrygraph.operators.filters import Filters, classify_events, glob, symbol_kind
from quarrygraph.plans import oracle as o
from quarrygraph.plans.batches import batch_plan
from quarrygraph.plans.paging import page
from quarrygraph.schema import COUNTED
from quarrygraph.sources import discovery, facts, star

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The part whose uses the queries on one symbol ask for, and the type, method and namespace of the hierarchy queries.
PART, SUPPLIER, CUSTOMER, NATION = "part:7", "supplier:3", "customer:207", "nation:5"
BARRIER = 5000
GLOBS, EXCLUDED = ["**/*1?.txt", "src1/**", "src2/*.txt"], ["src1/2*.txt"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Declarations and symbols

ITEM = "id, label, kind, namespace, project, tfm, file, line, \"column\", is_entry_point, label || chr(31) || id as sort_key"


@query(o.sql([o.DECL], "select * from decl"))
def declarations(spark: SparkSession, d: str) -> DataFrame:
    return star.declarations(spark, d)


def _symbols(where: str) -> str:
    return o.sql([o.DECL], f"select {ITEM} from kinds where node_kind <> 'external_root' and {where}")


@query(_symbols("true"))
def symbol_items(spark: SparkSession, d: str) -> DataFrame:
    return verbs.symbols(star.declarations(spark, d))


@query(_symbols("contains(lower(label), 'ring')"))
def symbols_search(spark: SparkSession, d: str) -> DataFrame:
    return verbs.symbols(star.declarations(spark, d), Filters(search="RING"))


@query(_symbols("(namespace = 'NATION_1' or starts_with(namespace, 'NATION_1.'))"))
def symbols_by_namespace(spark: SparkSession, d: str) -> DataFrame:
    return verbs.symbols(star.declarations(spark, d), Filters(namespace="NATION_1"))


@query(_symbols("project = 'src/ASIA.csproj'"))
def symbols_by_project(spark: SparkSession, d: str) -> DataFrame:
    return verbs.symbols(star.declarations(spark, d), Filters(project="src/ASIA.csproj"))


@query(_symbols("(file = 'supplier' or starts_with(file, 'supplier/'))"))
def symbols_by_path(spark: SparkSession, d: str) -> DataFrame:
    return verbs.symbols(star.declarations(spark, d), Filters(path="supplier"))


@query(_symbols("kind = 'operator'"))
def symbols_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return verbs.symbols(star.declarations(spark, d), Filters(kind="userdefinedoperator"))


@query(o.sql([o.DECL], f"select id, label, kind, if(namespace is null, 'internal', 'public') as accessibility, concat_ws(' ', if(kind in ('static_constructor', 'operator'), 'static', null), if(is_entry_point, 'entry', null)) as modifiers, namespace, project, tfm from kinds where id = '{CUSTOMER}'"))
def signature_lookup(spark: SparkSession, d: str) -> DataFrame:
    return verbs.signature(star.declarations(spark, d), CUSTOMER)


@query(o.sql([o.DECL], "select label, count(*)::bigint as n, min(id) as kept_id from decl group by label having count(*) > 1"))
def identity_collisions(spark: SparkSession, d: str) -> DataFrame:
    return merge.identity_collisions(star.declarations(spark, d), "label")


@query(o.sql([o.DECL], "select id, label, project, namespace from decl qualify row_number() over (partition by label order by project nulls last, id) = 1"))
def first_declarations(spark: SparkSession, d: str) -> DataFrame:
    return merge.first_declarations(star.declarations(spark, d), "label").select("id", "label", "project", "namespace")


# Edges


@query(o.sql([o.OBS], "select * from edges"))
def edges_merged(spark: SparkSession, d: str) -> DataFrame:
    return merge.with_location_text(merge.merged_edges(star.observations(spark, d)))


@query(o.sql([o.DECL], "select id, min(node_kind) as node_kind, min(label) as label, true as agrees, count(distinct file)::bigint as n_locations from (select * from decl union all select * from decl where node_kind = 'type') group by id"))
def nodes_merged(spark: SparkSession, d: str) -> DataFrame:
    decl = star.declarations(spark, d)
    return merge.merged_nodes(decl.unionByName(decl.where("node_kind = 'type'"))).withColumn("n_locations", F.size("locations").cast("long")).drop("locations")


@query(o.sql([o.DECL, o.OBS], "select side, id, count(*)::bigint as edges from (select 'source' as side, source_id as id from edges union all select 'target', target_id from edges) x where not exists (select 1 from decl where decl.id = x.id) group by all"))
def edge_endpoint_violations(spark: SparkSession, d: str) -> DataFrame:
    return merge.endpoint_violations(merge.edge_counts(star.observations(spark, d)), star.declarations(spark, d))


def _usage(where: str) -> str:
    return o.sql(
        [o.DECL, o.OBS],
        f"""select l.target_id, l.source_id as origin_id, d.label as origin_label, replace(relation, '_', '') as relation, evidence, e.confidence, l.file, l.line, l.col as "column",
  l.source_id || chr(31) || upper(relation[1]) || relation[2:] || chr(31) || upper(evidence[1]) || evidence[2:] || chr(31) || coalesce(l.file || ':' || l.line || ':' || l.col, '') as sort_key
from (select source_id, target_id, relation, evidence, file, line, col from locs l0 where file is not null or not exists (select 1 from locs l1 where l1.file is not null and (l1.source_id, l1.target_id, l1.relation, l1.evidence) = (l0.source_id, l0.target_id, l0.relation, l0.evidence))) l
join edges e using (source_id, target_id, relation, evidence) join decl d on d.id = l.source_id where {where}""",
    )


@query(_usage(f"l.target_id = '{PART}'"))
def usages(spark: SparkSession, d: str) -> DataFrame:
    obs = star.observations(spark, d).where(F.col("target_id") == PART)
    return verbs.usages(merge.merged_edges(obs), star.declarations(spark, d), PART)


@query(_usage(f"l.target_id = '{SUPPLIER}' and relation = 'calls'"))
def callers(spark: SparkSession, d: str) -> DataFrame:
    obs = star.observations(spark, d).where(F.col("target_id") == SUPPLIER)
    return verbs.callers(merge.merged_edges(obs), star.declarations(spark, d), SUPPLIER)


@query(_usage(f"l.target_id = '{PART}' and project = 'src/ASIA.csproj'"))
def usages_in_project(spark: SparkSession, d: str) -> DataFrame:
    obs = star.observations(spark, d).where(F.col("target_id") == PART)
    return verbs.usages(merge.merged_edges(obs), star.declarations(spark, d), PART, Filters(project="src/ASIA.csproj"))


@query(_usage("true"))
def usages_all(spark: SparkSession, d: str) -> DataFrame:
    return verbs.observed_usages(star.observations(spark, d), star.declarations(spark, d))


def _near(direction: str, symbol: str | None) -> str:
    own, other = ("source_id", "target_id") if direction in verbs.OUTGOING else ("target_id", "source_id")
    rel = ", ".join(f"'{r}'" for r in verbs.DIRECTIONS[direction])
    only = f"and {own} = '{symbol}'" if symbol else ""
    return f"""select {own} as symbol_id, '{direction}' as direction, relation, evidence, {other} as neighbour_id, label as neighbour_label, kind as neighbour_kind, confidence, null::varchar as file, null::int as line
from edges join kinds on id = {other} where relation in ({rel}) {only}"""


def _hierarchy(direction: str, symbol: str | None) -> Query:
    def f(spark: SparkSession, d: str) -> DataFrame:
        obs = star.observations(spark, d, ("hierarchy",))
        return verbs.hierarchy(merge.merged_edges(obs), star.declarations(spark, d), symbol, direction)

    f.__name__ = f"hierarchy_{direction}"
    return f


for _direction, _symbol in (("base", "supplier:33"), ("derived", SUPPLIER), ("contracts", CUSTOMER), ("implementations", NATION)):
    query(o.sql([o.DECL, o.OBS], _near(_direction, _symbol)))(_hierarchy(_direction, _symbol))
query(o.sql([o.DECL, o.OBS], " union all ".join(_near(x, None) for x in verbs.DIRECTIONS)))(_hierarchy("all", None))


def _summary(group: tuple[str, ...], where: str = "true") -> str:
    keys = [*group, "tfm as target_framework"] if group else []
    outs = [*group, "target_framework"] if group else []
    counts = ", ".join(f"count_if(relation = '{r}') as {r}_edges, coalesce(sum(n_locations) filter (where relation = '{r}'), 0)::bigint as {r}_occurrences" for r in COUNTED)
    zeros = ", ".join(f"coalesce({n}, 0)::bigint as {n}" for n in [*(f"{r}_{x}" for r in COUNTED for x in ("edges", "occurrences")), "origins"])
    # Ungrouped, every origin counts alike.
    external = "d.id is null" if group else "false"
    joined = f"joined as (select e.*, {external} as is_external_root {''.join(', ' + k for k in keys)} from edges e left join decl d on d.id = e.source_id where relation <> 'dispatches_to')"
    total = f"total as (select target_id, is_external_root {''.join(', ' + k for k in outs)}, {counts}, count(distinct source_id) as origins from joined group by all)"
    return o.sql([o.DECL, o.OBS, joined, total], f"select k.id as target_id, k.label as target_label {''.join(', t.' + k for k in outs)}, coalesce(is_external_root, false) as is_external_root, {zeros} from kinds k left join total t on t.target_id = k.id where node_kind <> 'external_root' and {where}")


@query(_summary(()))
def usage_summary(spark: SparkSession, d: str) -> DataFrame:
    return verbs.usage_summary(star.observations(spark, d), star.declarations(spark, d))


@query(_summary(("project",)))
def usage_summary_by_project(spark: SparkSession, d: str) -> DataFrame:
    return verbs.usage_summary(star.observations(spark, d), star.declarations(spark, d), ("project",))


@query(_summary(("namespace",)))
def usage_summary_by_namespace(spark: SparkSession, d: str) -> DataFrame:
    return verbs.usage_summary(star.observations(spark, d), star.declarations(spark, d), ("namespace",))


@query(_summary(("project", "namespace")))
def usage_summary_by_project_namespace(spark: SparkSession, d: str) -> DataFrame:
    return verbs.usage_summary(star.observations(spark, d), star.declarations(spark, d), ("project", "namespace"))


@query(_summary(("namespace",), "k.namespace = 'Brand#2' and contains(lower(k.label), 'ring')"))
def usage_summary_filtered(spark: SparkSession, d: str) -> DataFrame:
    return verbs.usage_summary(star.observations(spark, d), star.declarations(spark, d), ("namespace",), Filters(namespace="Brand#2", search="ring"))


# Arguments

_SITES = "sites as (select l_orderkey as site, l_linenumber as formal_ordinal, l_partkey as expression_start, l_suppkey as expression_length, l_extendedprice as price, 'part:' || l_partkey as callee_id from lineitem)"


@query(o.sql([_SITES], "select *, row_number() over (partition by site, formal_ordinal order by expression_start, expression_length, price, callee_id)::int - 1 as expansion_index, if(count(*) over (partition by site, formal_ordinal) > 1, 'params_expansion', 'explicit') as argument_kind from sites"))
def argument_expansion(spark: SparkSession, d: str) -> DataFrame:
    return verbs.arguments(star.call_arguments(spark, d))


@query(o.sql([_SITES, "called as (select distinct 'part:' || p_partkey as callee_id from part where p_size < 10)", "x as (select *, row_number() over (partition by site, formal_ordinal order by expression_start, expression_length, price, callee_id)::int - 1 as i from sites semi join called using (callee_id))"], "select site, formal_ordinal, callee_id, i as expansion_index, lpad(site::varchar, 10, '0') || chr(31) || lpad(formal_ordinal::varchar, 5, '0') || chr(31) || lpad(i::varchar, 5, '0') || chr(31) || lpad(expression_start::varchar, 10, '0') as sort_key from x"))
def arguments(spark: SparkSession, d: str) -> DataFrame:
    called = star.table(spark, d, "part").where("p_size < 10").select(star.ident("part", "p_partkey").alias("callee_id"))
    out = verbs.arguments(star.call_arguments(spark, d), called)
    return out.select("site", "formal_ordinal", "callee_id", "expansion_index", verbs.argument_key(out).alias("sort_key"))


@query("select o_orderkey as site from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def argument_gaps(spark: SparkSession, d: str) -> DataFrame:
    calls = star.table(spark, d, "orders").select(F.col("o_orderkey").alias("site"))
    return verbs.argument_gaps(calls, star.call_arguments(spark, d))


# Pages


@query(_symbols("true") + " order by sort_key limit 101")
def page_first(spark: SparkSession, d: str) -> DataFrame:
    return page(verbs.symbols(star.declarations(spark, d)), "sort_key", None, 101)


@query(_symbols("label || chr(31) || id > 'Customer#000000100'") + " order by sort_key limit 101")
def page_after_key(spark: SparkSession, d: str) -> DataFrame:
    return page(verbs.symbols(star.declarations(spark, d)), "sort_key", "Customer#000000100", 101)


# Identity and text

_ESC = "replace(replace(replace(replace(replace({0}, '%', '%25'), '|', '%7C'), '=', '%3D'), ',', '%2C'), ';', '%3B')"
_REF = "'symbol=' || kind || '|namespace=' || " + _ESC.format("namespace") + " || '|type=' || '|member=' || '|name=' || " + _ESC.format("label") + " || '|arity=0|params=|return=|discriminator='"
_KEY = "'csharp/v1|project=' || " + _ESC.format("project") + " || '|tfm=' || " + _ESC.format("tfm") + " || '|' || " + _REF


def _keys(spark: SparkSession, d: str) -> DataFrame:
    decl = star.declarations(spark, d).where("node_kind <> 'external_root'")
    none = F.lit("")
    ref = I.reference_key(symbol_kind(), F.col("namespace"), none, none, F.col("label"), F.lit(0), none, none, none)
    return decl.select("id", ref.alias("reference_key"), I.canonical_key(I.project_key(F.col("project"), F.col("tfm")), ref).alias("canonical_key"))


@query(o.sql([o.DECL], f"select id, {_REF} as reference_key, {_KEY} as canonical_key from kinds where node_kind <> 'external_root'"))
def canonical_keys(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d)


@query(o.sql([o.DECL], f"select id, 'cs_' || sha256({_KEY}) as node_id from kinds where node_kind <> 'external_root'"))
def node_ids(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d).select("id", I.node_id(F.col("canonical_key")).alias("node_id"))


@query("select p_partkey, lower(ltrim(regexp_replace(t, '([A-Z])', '_\\1', 'g'), '_')) as snake from (select p_partkey, 'Part' || p_type || 'Kind' || p_size as t from part)")
def snake_case(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Part"), "p_type", F.lit("Kind"), F.col("p_size").cast("string"))
    return star.table(spark, d, "part").select("p_partkey", I.snake_case(text).alias("snake"))


@query(o.sql([o.OBS], "select source_id, target_id, 'L' || line || ':C' || col as location, file || ':' || line || ':' || col as location_key from obs where file is not null and relation = 'calls'"))
def location_text(spark: SparkSession, d: str) -> DataFrame:
    obs = star.observations(spark, d, ("parts", "calls")).where("file is not null and relation = 'calls'")
    return obs.select("source_id", "target_id", I.location_text(F.col("line"), F.col("column")).alias("location"), I.location_key(F.struct("file", "line", "column")).alias("location_key"))


@query("select page_id, replace(replace(replace(replace(replace(url, '%', '%25'), '|', '%7C'), '=', '%3D'), ',', '%2C'), ';', '%3B') as escaped, regexp_replace(replace('./.\\' || url, '\\', '/'), '^(\\./)+', '') as path from pages")
def escaped_urls(spark: SparkSession, d: str) -> DataFrame:
    p = star.table(spark, d, "pages")
    return p.select("page_id", I.escape(F.col("url")).alias("escaped"), I.normal_path(F.concat(F.lit("./.\\"), "url")).alias("path"))


@query("select doc_id, if(length(text) > 512, text[1:512] || '…', text) as preview, length(text) > 512 as truncated from documents")
def preview_truncated(spark: SparkSession, d: str) -> DataFrame:
    return star.table(spark, d, "documents").select("doc_id", I.preview(F.col("text")).alias("preview"), (F.length("text") > 512).alias("truncated"))


@query("select t[1:4096] as diagnostic, length(t) > 4096 as truncated from (select distinct trim(event_type || ' ' || (event_id % 50)) as t from events) where t <> '' order by t limit 100")
def diagnostics_distinct(spark: SparkSession, d: str) -> DataFrame:
    e = star.table(spark, d, "events").select(F.concat(F.lit(" "), "event_type", F.lit(" "), (F.col("event_id") % 50).cast("string")).alias("diagnostic"))
    return incremental.distinct_diagnostics(e)


# Derivation


@query("with one as (select p_name, min(p_partkey) as id from part group by p_name || '|' || p_type, p_name having count(*) = 1) select p.p_partkey as reference, o.id from part p join (select p_name || '|' || p_type || '|' || p_size as k, min('part:' || p_partkey) as id from part group by 1 having count(*) = 1) o on o.k = p.p_name || '|' || p.p_type || '|' || p.p_size")
def reference_unique_match(spark: SparkSession, d: str) -> DataFrame:
    p = star.table(spark, d, "part").withColumns({"k": F.concat_ws("|", "p_name", "p_type", F.col("p_size").cast("string")), "id": star.ident("part", "p_partkey")})
    return derive.unique_matches(p.select(F.col("p_partkey").alias("reference"), "k"), p.select("k", "id"), "k").select("reference", "id")


_RANGES = "sym as (select 'f' || (o_custkey % 50) as file, o_orderkey as start, o_orderkey + 1 + o_custkey % 97 as \"end\", 'order:' || o_orderkey as symbol_id from orders), pos as (select l_orderkey + l_linenumber as position, 'f' || (l_suppkey % 50) as file, count(*) as n from lineitem group by all)"


@query(o.sql([_RANGES], 'select pos.file, position, symbol_id from pos join sym on pos.file = sym.file and start <= position and position < "end" qualify row_number() over (partition by pos.file, position order by "end" - start, symbol_id) = 1'))
def caller_nearest(spark: SparkSession, d: str) -> DataFrame:
    sym = star.table(spark, d, "orders").select(F.concat(F.lit("f"), (F.col("o_custkey") % 50).cast("string")).alias("file"), F.col("o_orderkey").alias("start"), F.expr("o_orderkey + 1 + o_custkey % 97").alias("end"), star.ident("order", "o_orderkey").alias("id"))
    pos = star.table(spark, d, "lineitem").select(F.concat(F.lit("f"), (F.col("l_suppkey") % 50).cast("string")).alias("file"), F.expr("l_orderkey + l_linenumber").alias("position")).distinct()
    return derive.innermost(pos, sym).select("file", "position", "symbol_id")


_CHAIN = "step as (select n_nationkey::bigint as a, (n_nationkey // 2)::bigint as b from nation), reach as (select a as start, b as reached, 1 as depth, [a, b] as seen from step union all select r.start, s.b, r.depth + 1, list_append(r.seen, s.b) from reach r join step s on s.a = r.reached where not list_contains(r.seen[2:], s.b))"


def _chain(spark: SparkSession, d: str) -> DataFrame:
    return star.project_references(spark, d).select(F.col("project").alias("source_id"), F.col("refers_to").alias("target_id"))


@query(o.sql([_CHAIN], "select start, reached, min(depth)::int as depth from reach group by all", recursive=True))
def interface_closure(spark: SparkSession, d: str) -> DataFrame:
    return derive.closure(_chain(spark, d))


@query(o.sql([_CHAIN, "inh as (select distinct start, reached from reach where start <> reached)", "mem as (select n_nationkey::bigint as t, 'm' || (n_nationkey % 3) as sig, 'nation:' || n_nationkey as id from nation)"], "select a.id as source_id, b.id as target_id, 'implements' as relation from inh join mem a on a.t = start join mem b on b.t = reached and a.sig = b.sig", recursive=True))
def implemented_members(spark: SparkSession, d: str) -> DataFrame:
    reach = derive.closure(_chain(spark, d)).where("start <> reached")
    mem = star.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("type_id"), F.concat(F.lit("m"), (F.col("n_nationkey") % 3).cast("string")).alias("signature"), star.ident("nation", "n_nationkey").alias("id"))
    return derive.implemented_members(reach, mem)


@query(o.sql([_CHAIN, "scope as (select start, reached, min(depth) as depth from (select start, reached, depth from reach union all select a, a, 0 from step) group by all)", "mem as (select n_nationkey::bigint as t, 'm' || (n_nationkey % 5) as name, 'nation:' || n_nationkey as id, n_regionkey as rank, n_name as label from nation)"], "select start, name, id as member_id, depth::int as depth from scope join mem on t = reached qualify row_number() over (partition by start, name order by depth, rank, label) = 1", recursive=True))
def member_lookup_ranked(spark: SparkSession, d: str) -> DataFrame:
    reach = derive.closure(_chain(spark, d)).where("start <> reached")
    mem = star.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("type_id"), F.concat(F.lit("m"), (F.col("n_nationkey") % 5).cast("string")).alias("name"), star.ident("nation", "n_nationkey").alias("id"), F.col("n_regionkey").alias("rank"), F.col("n_name").alias("label"))
    return derive.lookup_member(reach, mem)


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_returnflag = 'A' then 'read_write' when l_returnflag = 'N' and l_linestatus = 'O' then 'write' else 'read' end as use from lineitem")
def accessor_use(spark: SparkSession, d: str) -> DataFrame:
    parent = F.when(F.col("l_returnflag") == "A", "compound_assignment").when(F.col("l_returnflag") == "N", "assignment").otherwise("invocation")
    return star.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", derive.accessor_use(parent, F.col("l_linestatus") == "O").alias("use"))


@query(
    """with ops as (select 'customer:' || o_custkey as caller, 'part:' || l_partkey as part, 'supplier:' || l_suppkey as sup, l_returnflag as f, l_linestatus as s, l_orderkey, l_linenumber as line from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus <> 'P')
select caller as source_id, part as target_id, 'references' as relation, 'extracted' as evidence, 1.0::double as confidence, 'orders/' || l_orderkey || '.cs' as file, line, 1 as "column" from ops where f = 'A'
union all select caller, sup, 'calls', 'extracted', 1.0, 'orders/' || l_orderkey || '.cs', line, 1 from ops where f = 'A' and s = 'O'
union all select caller, sup, 'calls', 'extracted', 1.0, 'orders/' || l_orderkey || '.cs', line, 1 from ops where f = 'N'
"""
)
def operation_edges(spark: SparkSession, d: str) -> DataFrame:
    l = star.table(spark, d, "lineitem").join(star.table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    use = F.when(F.col("l_linestatus") == "O", "read").otherwise("write")
    part, supplier = star.ident("part", "l_partkey"), star.ident("supplier", "l_suppkey")
    prop = F.col("l_returnflag") == "A"
    members = F.when(prop, F.array(F.struct(F.lit("property_reference").alias("op_kind"), F.lit("member").alias("role"), part.alias("member_id")), F.struct(F.lit("property_reference").alias("op_kind"), F.lit("getter").alias("role"), supplier.alias("member_id")))).when(F.col("l_returnflag") == "N", F.array(F.struct(F.lit("invocation").alias("op_kind"), F.lit("method").alias("role"), supplier.alias("member_id")))).otherwise(F.array(F.struct(F.lit("local_reference").alias("op_kind"), F.lit("member").alias("role"), part.alias("member_id"))))
    ops = l.select(star.ident("customer", "o_custkey").alias("caller_id"), F.explode(members).alias("m"), use.alias("use"), F.lit(True).alias("is_declaration"), F.lit(False).alias("adds"), F.concat(F.lit("orders/"), F.col("l_orderkey").cast("string"), F.lit(".cs")).alias("file"), F.col("l_linenumber").alias("line"), F.lit(1).alias("column"))
    return derive.operation_edges(ops.select("caller_id", "m.*", "use", "is_declaration", "adds", "file", "line", "column"), star.declarations(spark, d))


@query("select 'customer:' || o_custkey as source_id, 'part:' || l_partkey as target_id, 'references' as relation from lineitem join orders on l_orderkey = o_orderkey where l_returnflag <> 'A' and not exists (select 1 from orders i where i.o_orderkey = l_orderkey and i.o_orderstatus = 'P') union all select 'customer:' || o_custkey, 'supplier:' || l_suppkey, 'references' from lineitem join orders on l_orderkey = o_orderkey where l_linestatus = 'O'")
def name_references(spark: SparkSession, d: str) -> DataFrame:
    orders = star.table(spark, d, "orders")
    l = star.table(spark, d, "lineitem").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    names = l.select(F.col("l_orderkey").alias("name_id"), star.ident("customer", "o_custkey").alias("caller_id"), F.when(F.col("l_returnflag") != "A", star.ident("part", "l_partkey")).alias("target_id"), F.when(F.col("l_linestatus") == "O", star.ident("supplier", "l_suppkey")).alias("alias_id"))
    return derive.name_references(names, orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("name_id")))


@query("with ops as (select distinct user_id as tree, case when event_id % 3 = 0 then (event_id % 7)::varchar when event_id % 3 = 1 then (event_id % 7) || '/' || (event_id % 5) else (event_id % 11) || '/x/' || (event_id % 5) end as path from events) select tree, path from ops o where not exists (select 1 from ops p where p.tree = o.tree and p.path <> o.path and starts_with(o.path, p.path || '/'))")
def operation_roots(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    path = F.when(k % 3 == 0, (k % 7).cast("string")).when(k % 3 == 1, F.concat_ws("/", (k % 7).cast("string"), (k % 5).cast("string"))).otherwise(F.concat((k % 11).cast("string"), F.lit("/x/"), (k % 5).cast("string")))
    return derive.operation_roots(star.table(spark, d, "events").select(F.col("user_id").alias("tree"), path.alias("path")))


@query("select distinct 'part:' || l_partkey as source_id, 'supplier:' || l_suppkey as target_id, 'references' as relation from lineitem union select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'references' from customer")
def constraint_edges(spark: SparkSession, d: str) -> DataFrame:
    l = star.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.collect_set(star.ident("supplier", "l_suppkey")).alias("constraints"))
    c = star.table(spark, d, "customer").select(star.ident("customer", "c_custkey").alias("id"), star.ident("nation", "c_nationkey").alias("target_id"))
    return derive.constraint_edges(l.select(star.ident("part", "l_partkey").alias("id"), "constraints"), c)


# Change detection


@query(o.sql([o.INVENTORY], "select coalesce(p.path, c.path) as path, null::varchar as old_path, case when p.path is null then 'created' when c.path is null then 'deleted' else 'changed' end as kind, true as cold, false as is_directory from prev p full join cur c on p.path = c.path where p.path is null or c.path is null or p.length <> c.length or p.sha <> c.sha"))
def scan_events(spark: SparkSession, d: str) -> DataFrame:
    return incremental.scan_events(star.inventory(spark, d, "previous"), star.inventory(spark, d, "current"))


@query(o.sql([o.INVENTORY], "select coalesce(p.path, c.path) as path, case when p.path is null then 'created' when c.path is null then 'deleted' else 'changed' end as change from prev p full join cur c on p.path = c.path where p.path is null or c.path is null or p.length <> c.length or p.sha <> c.sha"))
def inventory_diff(spark: SparkSession, d: str) -> DataFrame:
    return incremental.inventory_diff(star.inventory(spark, d, "previous"), star.inventory(spark, d, "current"))


_DIGEST = "dig_{0} as (select project, count(*)::bigint as files, sha256(string_agg(path || chr(29) || length || chr(29) || sha, chr(30) order by path || chr(29) || length || chr(29) || sha)) as digest from {0} group by project)"


@query(o.sql([o.INVENTORY, _DIGEST.format("cur")], "select * from dig_cur"))
def project_digests(spark: SparkSession, d: str) -> DataFrame:
    return incremental.project_digests(star.inventory(spark, d, "current"))


@query(o.sql([o.INVENTORY, _DIGEST.format("cur"), _DIGEST.format("prev")], "select coalesce(p.project, c.project) as project, case when p.project is null then 'new' when c.project is null then 'removed' when p.digest <> c.digest then 'changed' else 'clean' end as state from (select * from dig_prev where project <> 'src3') p full join (select * from dig_cur where project <> 'src4') c on p.project = c.project"))
def fingerprint_diff(spark: SparkSession, d: str) -> DataFrame:
    p = incremental.project_digests(star.inventory(spark, d, "previous")).where("project <> 'src3'")
    return incremental.fingerprint_diff(p, incremental.project_digests(star.inventory(spark, d, "current")).where("project <> 'src4'"))


@query(o.sql([o.INVENTORY], "select project, ['different', 'metadata_match', 'content_match'][min(case when project = 'src5' then 0 when c.length = p.length and c.length % 2 = 0 then 1 when c.sha = p.sha then 2 else 0 end) + 1] as comparison from prev p join cur c using (path, project) group by project"))
def fingerprint_comparison(spark: SparkSession, d: str) -> DataFrame:
    p, c = star.inventory(spark, d, "previous"), star.inventory(spark, d, "current")
    j = p.select("path", "project", F.col("length").alias("l0"), F.col("sha").alias("s0")).join(c.select("path", F.col("length").alias("l1"), F.col("sha").alias("s1")), "path")
    one = incremental.file_comparison(F.col("l0"), F.col("l1"), F.col("l0") % 2, F.lit(0), F.col("s0"), F.col("s1"))
    return incremental.combined_comparison(j.select("project", one.alias("comparison"), (F.col("project") != "src5").alias("complete")))


@query("select distinct s_nationkey::bigint as project from supplier where s_acctbal < 100")
def dirty_projects(spark: SparkSession, d: str) -> DataFrame:
    s = star.table(spark, d, "supplier")
    owners = s.select(star.ident("supplier", "s_suppkey").alias("path"), F.array(F.col("s_nationkey").cast("long")).alias("projects"))
    return incremental.dirty_projects(s.where("s_acctbal < 100").select(star.ident("supplier", "s_suppkey").alias("path")), owners)


@query("with recursive step as (select n_nationkey::bigint as a, (n_nationkey // 2)::bigint as b from nation), x as (select 3::bigint as project union select a from step join x on b = project) select project from x")
def dirty_closure(spark: SparkSession, d: str) -> DataFrame:
    refs = star.project_references(spark, d)
    return incremental.reverse_closure(refs.where("project = 3").select("project"), refs)


@query(o.sql([o.INVENTORY], "select distinct project from prev where project not in (select project from cur where project <> 'src4')"))
def removed_projects(spark: SparkSession, d: str) -> DataFrame:
    p = star.inventory(spark, d, "previous").select("project").distinct()
    return p.join(star.inventory(spark, d, "current").where("project <> 'src4'").select("project").distinct(), "project", "left_anti")


# Events


@query(o.sql([o.EVENTS], "select event_id, path, clock from ev"))
def event_clock(spark: SparkSession, d: str) -> DataFrame:
    return incremental.event_clock(star.file_events(spark, d)).select("event_id", "path", "clock")


_FOLD = """, known as (select *, row_number() over (partition by path, old_path order by clock) as i from ev where is_directory is not null),
runs as (select path, old_path, is_directory, clock, row_number() over (partition by path, old_path order by clock) as i from known),
fold as (select path, old_path, i, is_directory as a from runs where i = 1 union all
  select f.path, f.old_path, r.i, case when f.a is null then r.is_directory when f.a = r.is_directory then f.a end from fold f join runs r on r.path = f.path and r.old_path is not distinct from f.old_path and r.i = f.i + 1),
last as (select path, old_path, arg_max(coalesce(a::varchar, 'unknown'), i) as entry from fold group by all)"""


@query(o.sql([o.EVENTS + _FOLD], "select e.path, e.old_path, coalesce(max(l.entry), 'unknown') as entry, bool_or(cold) as cold, count(*)::bigint as events, min(clock) as first_clock, max(clock) as last_clock, ['changed', 'created', 'renamed', 'deleted'][max(case kind when 'changed' then 1 when 'created' then 2 when 'renamed' then 3 else 4 end)] as kind from ev e left join last l on l.path = e.path and l.old_path is not distinct from e.old_path group by e.path, e.old_path", recursive=True))
def journal_coalesced(spark: SparkSession, d: str) -> DataFrame:
    out = incremental.coalesced_journal(incremental.event_clock(star.file_events(spark, d)))
    return out.withColumn("entry", F.coalesce(F.col("is_directory").cast("string"), F.lit("unknown"))).drop("is_directory")


_DIRTY = "ends as (select path, clock, cold from ev union all select old_path, clock, cold from ev where old_path is not null), dirty as (select path, min(clock) as first_generation, max(clock) as last_generation, bool_or(cold) as cold from ends group by path)"


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    return incremental.dirty_paths(incremental.event_clock(star.file_events(spark, d)))


@query(o.sql([o.EVENTS, _DIRTY], "select * from dirty"))
def dirty_paths(spark: SparkSession, d: str) -> DataFrame:
    return _dirty(spark, d)


@query(o.sql([o.EVENTS, _DIRTY], f"select *, last_generation > {BARRIER} as stays from dirty where first_generation <= {BARRIER}"))
def due_paths(spark: SparkSession, d: str) -> DataFrame:
    return incremental.due_paths(_dirty(spark, d), BARRIER)


@query(o.sql([o.EVENTS, _DIRTY], f"select path, if(first_generation <= {BARRIER}, last_generation, first_generation) as first_generation, last_generation, cold from dirty where last_generation > {BARRIER}"))
def carried_paths(spark: SparkSession, d: str) -> DataFrame:
    return incremental.carried_over(_dirty(spark, d), BARRIER)


@query(
    o.sql(
        [o.EVENTS, "inp as (select 'user/' || i as path, i % 2 = 0 as src from range(0, 40) t(i))", "ends as (select event_id, kind, cold, is_directory, unnest(list_distinct(list_filter([path, old_path], lambda x: x is not null))) as e from ev)", "kept as (select * from ends where not (e = 'user/13' or starts_with(e, 'user/13/')) and not ends_with(e, '.tmp'))", "f as (select event_id, bool_or(inp.path is not null) as exact, bool_and(coalesce(src, false)) as sources, bool_or(regexp_matches(e, '^user/4[^/]$') and not coalesce(is_directory, false)) as hit from kept left join inp on inp.path = e group by event_id)"],
        "select ev.event_id, path, kind, coalesce(exact or hit, false) as accepted, coalesce((exact or hit) and not (exact and kind = 'changed' and sources and not cold), false) as needs_cold from ev left join f on f.event_id = ev.event_id",
    )
)
def event_classification(spark: SparkSession, d: str) -> DataFrame:
    inputs = spark.range(40).select(F.concat(F.lit("user/"), F.col("id").cast("string")).alias("path"), (F.col("id") % 2 == 0).alias("is_source"))
    return classify_events(star.file_events(spark, d), inputs, ["user/13"], ["user/4?"])


@query(o.sql([o.INVENTORY], "select path, (regexp_matches(path, '^(?:.*/)?[^/]*1[^/]\\.txt$') or regexp_matches(path, '^src1/.*$') or regexp_matches(path, '^src2/[^/]*\\.txt$')) and not regexp_matches(path, '^src1/2[^/]*\\.txt$') as matched from cur"))
def glob_matches(spark: SparkSession, d: str) -> DataFrame:
    return star.inventory(spark, d, "current").select("path", glob(F.col("path"), GLOBS, EXCLUDED).alias("matched"))


@query("with p as (select distinct split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1) as path from pages), s as (select path, string_split(path, '/') as parts from p) select distinct array_to_string(parts[1:i], '/') as ancestor from (select parts, unnest(range(1, greatest(len(parts), 2))) as i from s)")
def path_ancestors(spark: SparkSession, d: str) -> DataFrame:
    path = F.split_part(F.split_part(F.split_part(F.col("url"), F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return star.table(spark, d, "pages").select(F.explode(I.ancestors(path)).alias("ancestor")).distinct()


@query("with p as (select distinct split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1) as path from pages) select path from p where not exists (select 1 from p q where q.path <> p.path and starts_with(p.path, q.path || '/'))")
def nested_roots(spark: SparkSession, d: str) -> DataFrame:
    path = F.split_part(F.split_part(F.split_part(F.col("url"), F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return incremental.nested_roots(star.table(spark, d, "pages").select(path.alias("path")).distinct())


@query("with e as (select event_id, event_type, row_number() over (order by ts, event_id)::bigint as clock from events) select *, greatest((select count(*) from e) - 32, 0)::bigint as omitted from e order by clock desc limit 32")
def recent_events(spark: SparkSession, d: str) -> DataFrame:
    e = star.table(spark, d, "events").select("event_id", "ts", "event_type")
    return incremental.recent(incremental.event_clock(e).select("event_id", "event_type", "clock"))


@query("select operation, stage, sum(spent)::bigint as millis from (select user_id as operation, event_type as stage, date_sub('millisecond', ts, lead(ts) over (partition by user_id order by ts, event_id)) as spent from events) where spent is not null group by all")
def stage_durations(spark: SparkSession, d: str) -> DataFrame:
    e = star.table(spark, d, "events").select(F.col("user_id").alias("operation"), F.col("event_type").alias("stage"), "ts", F.col("event_id").alias("mark_id"))
    return incremental.stage_durations(e)


@query("select user_id as watcher, count(*)::bigint as attempts, count_if(event_type <> 'error')::bigint as successes, count_if(event_type = 'error')::bigint as failures, arg_max(event_type, ts) as last_outcome from events group by user_id")
def recovery_counts(spark: SparkSession, d: str) -> DataFrame:
    e = star.table(spark, d, "events").select(F.col("user_id").alias("watcher"), "ts", F.col("event_id").alias("attempt_id"), (F.col("event_type") != "error").alias("ok"), F.col("event_type").alias("outcome"))
    return incremental.recovery_counts(e)


# Inputs and projects


@query("select *, case when n = 0 then path else path || chr(31) || lpad(n::varchar, 8, '0') end as key from (select path, ordinal, row_number() over (partition by path order by ordinal) - 1 as n from (select 'f' || (l_partkey % 500) || '.cs' as path, l_orderkey * 1000000 + l_suppkey * 100 + l_linenumber as ordinal, row_number() over (partition by l_orderkey, l_suppkey, l_linenumber order by l_partkey) as r from lineitem) where r = 1)".replace("select *,", "select path, ordinal,"))
def tree_keys(spark: SparkSession, d: str) -> DataFrame:
    l = star.table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    trees = l.select(F.concat(F.lit("f"), (F.col("p") % 500).cast("string"), F.lit(".cs")).alias("path"), F.expr("l_orderkey * 1000000 + l_suppkey * 100 + l_linenumber").alias("ordinal"))
    return discovery.tree_keys(trees)


@query("select s_suppkey, case when s_suppkey % 3 = 0 then 'net' || (s_suppkey % 5) when s_suppkey % 3 = 1 then 'tfm' || s_nationkey else 'unknown' end as tfm from supplier")
def target_frameworks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    asked = F.when(k % 3 == 0, F.concat(F.lit(" net"), (k % 5).cast("string"), F.lit(" "))).otherwise(F.lit(" "))
    evaluated = F.when(k % 3 == 1, F.concat(F.lit(" ;tfm"), F.col("s_nationkey").cast("string"))).otherwise(F.lit(""))
    return star.table(spark, d, "supplier").select("s_suppkey", facts.target_framework(asked, evaluated, F.lit("  ")).alias("tfm"))


_FOLDERS = "folders as (select distinct 'src/' || r_name as f from region union select 'src')"


@query(o.sql([_FOLDERS, "names as (select unnest([" + ", ".join(f"'{n}'" for n in discovery.CONFIGURATION) + "]) as n)"], "select f || '/' || n as candidate from folders cross join names"))
def configuration_candidates(spark: SparkSession, d: str) -> DataFrame:
    r = star.table(spark, d, "region").select(F.concat(F.lit("src/"), "r_name", F.lit("/a.csproj")).alias("path"))
    return discovery.configuration_candidates(r)


_ROOTS = "roots as (select split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1) as path, bool_or(page_id % 2 = 0) as recursive from pages group by 1)"


@query(o.sql([_ROOTS], "select path, recursive from roots r where not exists (select 1 from roots q where q.recursive and q.path <> r.path and starts_with(r.path, q.path || '/'))"))
def watch_roots(spark: SparkSession, d: str) -> DataFrame:
    path = F.split_part(F.split_part(F.split_part(F.col("url"), F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return discovery.watch_roots(star.table(spark, d, "pages").select(path.alias("path"), (F.col("page_id") % 2 == 0).alias("recursive")))


@query("select 'out/' || n_nationkey as path from nation where n_nationkey not in (1, 2)")
def output_roots(spark: SparkSession, d: str) -> DataFrame:
    n = star.table(spark, d, "nation").select(F.concat(F.lit("out/"), F.col("n_nationkey").cast("string"), F.lit("/; ;/")).alias("folders"))
    kept = spark.createDataFrame([("out/1",), ("out/2/sub/project",)], "path string")
    return discovery.output_roots(n, kept)


@query(o.sql([o.INVENTORY], "select distinct path from prev where path not in (select path from cur) and project <> 'src1'"))
def infrastructure_paths(spark: SparkSession, d: str) -> DataFrame:
    p = star.inventory(spark, d, "previous")
    return discovery.infrastructure(p, star.inventory(spark, d, "current"), p.where("project = 'src1'"))


@query(
    """with recursive step as (select 'n' || n_nationkey as item, 'n' || (n_nationkey // 2) as upstream, 'x' || (n_nationkey % 2) as more from nation),
known as (select 'n0' as item, '**/*.cs' as \"glob\", ['obj/**'] as excludes, ['n0'] as way union all
  select s.item, k.\"glob\", list_sort(list_distinct(list_append(k.excludes, s.more))), list_append(k.way, s.item) from known k join step s on s.upstream = k.item where not list_contains(k.way, s.item))
select distinct item, \"glob\", array_to_string(excludes, ';') as excludes from known"""
)
def candidate_rules(spark: SparkSession, d: str) -> DataFrame:
    n = star.table(spark, d, "nation")
    forwards = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("item"), F.concat(F.lit("n"), F.floor(F.col("n_nationkey") / 2).cast("string")).alias("upstream"), F.array(F.concat(F.lit("x"), (F.col("n_nationkey") % 2).cast("string"))).alias("excludes"))
    rules = spark.createDataFrame([("n0", "**/*.cs", ["obj/**"])], "item string, glob string, excludes array<string>")
    return discovery.candidate_rules(rules, forwards).withColumn("excludes", F.array_join("excludes", ";"))


@query(o.sql([o.DECL, o.OBS], "select (select count(distinct project) from decl)::bigint as projects, (select count(*) from decl)::bigint as declarations, (select count(*) from edges)::bigint as edges, (select count(*) from locs where file is not null)::bigint as places"))
def evidence_summary(spark: SparkSession, d: str) -> DataFrame:
    edges = merge.edge_counts(star.observations(spark, d)).agg(F.count("*").alias("edges"), F.sum("n_locations").alias("places"))
    decl = star.declarations(spark, d).agg(F.count_distinct("project").alias("projects"), F.count("*").alias("declarations"))
    return decl.crossJoin(F.broadcast(edges))  # one row each


@query(o.sql([o.INVENTORY], "select project, count(*)::bigint as documents, sum(length)::bigint as cost from cur group by project"))
def project_costs(spark: SparkSession, d: str) -> DataFrame:
    return star.inventory(spark, d, "current").groupBy("project").agg(F.count("*").alias("documents"), F.sum("length").alias("cost"))


@query("select user_id as operation, event_type as phase, event_id as mark_id, max(value) over (partition by user_id, event_type order by ts, event_id rows unbounded preceding) as progress from events")
def monotonic_progress(spark: SparkSession, d: str) -> DataFrame:
    from quarrygraph.streaming.observe import monotonic_progress as running

    e = star.table(spark, d, "events").select(F.col("user_id").alias("operation"), F.col("event_type").alias("phase"), "ts", F.col("event_id").alias("mark_id"), F.col("value").alias("done"))
    return running(e).select("operation", "phase", "mark_id", "progress")


@query("select min(s_suppkey) as s_suppkey from supplier where starts_with(lower(s_name), 'supplier#000000003') having count(*) = 1")
def unique_prefix(spark: SparkSession, d: str) -> DataFrame:
    s = star.table(spark, d, "supplier").where(F.startswith(F.lower("s_name"), F.lower(F.lit("SUPPLIER#000000003"))))
    return s.agg(F.min("s_suppkey").alias("s_suppkey"), F.count("*").alias("n")).where("n = 1").select("s_suppkey")


# Plans and export


@query()
def batch_plans(spark: SparkSession, d: str) -> DataFrame:
    docs = star.inventory(spark, d, "current").select("project", F.col("path").alias("key"), F.col("length").alias("cost"))
    return batch_plan(docs, workers=4)


@query(o.sql([o.DECL], "select id, label, 'code' as file_type, coalesce(file, '') as source_file, 'L' || line || ':C' || \"column\" as source_location, node_kind as kind_property, id as key_property from decl"))
def export_nodes(spark: SparkSession, d: str) -> DataFrame:
    from quarrygraph.plans import export

    decl = star.declarations(spark, d).withColumns({"symbol_key": F.col("id"), "properties": F.create_map(F.lit("zone"), F.coalesce("project", F.lit(""))), "locations": F.when(F.col("file").isNotNull(), F.array(F.struct("file", "line", "column"))).otherwise(F.array().cast("array<struct<file:string,line:int,column:int>>"))})
    out = export.export_nodes(decl)
    return out.select("id", "label", "file_type", "source_file", "source_location", F.col("properties")["node_kind"].alias("kind_property"), F.col("properties")["symbol_key"].alias("key_property"))


@query(o.sql([o.OBS], "select source_id as source, target_id as target, relation, upper(evidence) as confidence, confidence as confidence_score, case when n_locations = 0 then '' else split_part(location_text, ':', 1) end as source_file, case when n_locations > 0 then 'L' || split_part(split_part(location_text, ';', 1), ':', 2) || ':C' || split_part(split_part(location_text, ';', 1), ':', 3) end as source_location, 1.0::double as weight from edges"))
def export_edges(spark: SparkSession, d: str) -> DataFrame:
    from quarrygraph.plans import export

    return export.export_edges(merge.first_places(star.observations(spark, d)))


@query(o.sql([o.EVENTS, _DIRTY], "select * from dirty"))
def stream_dirty_paths(spark: SparkSession, d: str) -> DataFrame:
    """Events written as files, streamed in, and the state read back: equal to ``dirty_paths``."""
    import tempfile

    from quarrygraph.streaming.dirty import DirtyState, watch

    root = spark.conf.get("spark.checkpoint.dir", None)
    root = root.removeprefix("file://").removeprefix("file:") if root else tempfile.mkdtemp(prefix="quarrygraph-stream-")
    root = tempfile.mkdtemp(prefix="stream-", dir=root)
    events = star.file_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(4, "ts").write.parquet(f"{root}/in")
    state = DirtyState(spark, f"{root}/state")
    watch(spark, f"{root}/in", state, f"{root}/checkpoint", files_per_trigger=1_000_000).awaitTermination()
    return state.paths().select("path", "first_generation", "last_generation", "cold")


from quarrygraph.plans import verb_queries  # noqa: E402, F401  registers more, with the names above

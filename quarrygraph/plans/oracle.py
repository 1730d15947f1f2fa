"""The star schema's evidence in DuckDB SQL, for the queries' oracles."""

NATIONS = """n as (select n_nationkey, n_name, 'src/' || r_name || '.csproj' as project, 'tfm' || (n_nationkey % 2) as tfm
  from nation join region on n_regionkey = r_regionkey)"""

DECL = (
    NATIONS
    + """,
cust as (select c_custkey, c_name, n_name, project, tfm from customer join n on c_nationkey = n_nationkey),
decl as (
  select 'nation:' || n_nationkey as id, n_name as label, 'namespace' as node_kind, 'namespace' as raw_kind, n_name as namespace, project, tfm, 'nation/' || n_nationkey || '.cs' as file, 1 as line, 1 as "column", false as is_entry_point from n
  union all select 'supplier:' || s_suppkey, s_name, 'type', 'class', n_name, project, tfm, 'supplier/' || s_suppkey || '.cs', 1, 1, false from supplier join n on s_nationkey = n_nationkey
  union all select 'customer:' || c_custkey, c_name, 'method', (['ordinary', 'staticconstructor', 'userdefinedoperator', 'localfunction'])[c_custkey % 4 + 1], n_name, project, tfm, 'customer/' || c_custkey || '.cs', 1, 1, c_custkey % 100 = 0 from cust
  union all select 'part:' || p_partkey, p_name, 'property', 'property', p_brand, 'src/PARTS.csproj', 'tfm0', 'part/' || p_partkey || '.cs', p_size, 1, false from part
  union all select 'order:' || o_orderkey, 'Order' || o_orderkey, 'method', 'ordinary', n_name, project, tfm, 'order/' || o_orderkey || '.cs', 1, 1, false from orders join cust on o_custkey = c_custkey where o_orderstatus <> 'P'
  union all select 'external:0', '<external>', 'external_root', 'external_root', null, null, null, null, null, null, false),
kinds as (select *, case when raw_kind = 'ordinary' then 'method' when raw_kind = 'staticconstructor' then 'static_constructor' when raw_kind = 'userdefinedoperator' then 'operator' when node_kind in ('method', 'constructor') then node_kind else raw_kind end as kind from decl)"""
)

OBS = """li as (select *, case l_returnflag when 'A' then 'extracted' when 'N' then 'inferred' else 'ambiguous' end as evidence, 1 - l_discount as confidence, 'orders/' || l_orderkey || '.cs' as file, l_linenumber as line, cast(l_quantity as int) as col from lineitem),
obs as (
  select 'order:' || l_orderkey as source_id, 'part:' || l_partkey as target_id, if(l_linestatus = 'O', 'calls', 'references') as relation, evidence, confidence, file, line, col from li
  union all select 'customer:' || o_custkey, 'supplier:' || l_suppkey, 'calls', evidence, confidence, file, line, col from li join orders on l_orderkey = o_orderkey
  union all select 'order:' || o_orderkey, 'customer:' || o_custkey, 'references', 'extracted', 1.0, if(o_orderstatus = 'F', null, 'orders/' || o_orderkey || '.cs'), if(o_orderstatus = 'F', null, 1), if(o_orderstatus = 'F', null, 1) from orders
  union all select 'supplier:' || s_suppkey, 'supplier:' || (s_suppkey % 10), 'inherits', 'extracted', 1.0, null, null, null from supplier where s_suppkey <> s_suppkey % 10
  union all select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'implements', 'extracted', 1.0, null, null, null from customer
  union all select 'customer:' || c_custkey, 'customer:' || (c_custkey % 100), 'overrides', 'extracted', 1.0, null, null, null from customer where c_custkey <> c_custkey % 100),
locs as (select source_id, target_id, relation, evidence, file, line, col, max(confidence) as confidence from obs group by all),
edges as (select source_id, target_id, relation, evidence, max(confidence) as confidence, count(file)::bigint as n_locations, coalesce(string_agg(file || ':' || line || ':' || col, ';' order by file, line, col), '') as location_text from locs group by all)"""

EVENTS = """ev as (select event_id, ts, 'user/' || user_id as path, case event_type when 'purchase' then 'user/' || (user_id + 1) end as old_path,
  case event_type when 'signup' then 'created' when 'purchase' then 'renamed' when 'error' then 'deleted' else 'changed' end as kind,
  value > 40 as cold, case event_id % 3 when 0 then true when 1 then false end as is_directory, row_number() over (order by ts, event_id)::bigint as clock from events)"""

INVENTORY = """d as (select doc_id, source || '/' || doc_id || '.txt' as path, source as project, n_chars, sha256(text) as sha, sha256(text || 'x') as sha2 from documents),
prev as (select path, project, n_chars as length, sha from d where doc_id % 10 <> 0),
cur as (select path, project, n_chars + if(doc_id % 7 = 0, 1, 0) as length, if(doc_id % 7 = 0, sha2, sha) as sha from d where doc_id % 11 <> 0)"""


def sql(ctes: list[str], select: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{', '.join(ctes)}\n{select}"

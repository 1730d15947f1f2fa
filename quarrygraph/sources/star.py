"""The star schema read as evidence: nations, suppliers, customers, parts and orders declare; lineitems observe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ident(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their region's name: a dimension of a fixed few rows."""
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", "n_name", F.concat(F.lit("src/"), "r_name", F.lit(".csproj")).alias("project"), F.concat(F.lit("tfm"), (F.col("n_nationkey") % 2).cast("string")).alias("tfm"))


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, node_kind, raw_kind, namespace, project, tfm, file, line, column, is_entry_point)."""
    n = F.broadcast(nations(spark, sf_dir))

    def rows(df: DataFrame, prefix: str, key: str, label: Column, node: str, raw: Column, entry: Column, line: Column | None = None, namespace: str = "n_name") -> DataFrame:
        where = F.concat(F.lit(f"{prefix}/"), F.col(key).cast("string"), F.lit(".cs"))
        return df.select(ident(prefix, key).alias("id"), label.alias("label"), F.lit(node).alias("node_kind"), raw.alias("raw_kind"), F.col(namespace).alias("namespace"), "project", "tfm", where.alias("file"), (F.lit(1) if line is None else line).cast("int").alias("line"), F.lit(1).alias("column"), entry.alias("is_entry_point"))

    no = F.lit(False)
    customer = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    raw = F.element_at(F.array(*map(F.lit, ("ordinary", "staticconstructor", "userdefinedoperator", "localfunction"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").join(customer.select("c_custkey", "n_name", "project", "tfm"), F.col("o_custkey") == F.col("c_custkey"))
    part = table(spark, sf_dir, "part").withColumns({"project": F.lit("src/PARTS.csproj"), "tfm": F.lit("tfm0")})
    root = spark.range(1).select(F.lit("external:0").alias("id"), F.lit("<external>").alias("label"), F.lit("external_root").alias("node_kind"), F.lit("external_root").alias("raw_kind"), *(F.lit(None).cast(t).alias(c) for c, t in (("namespace", "string"), ("project", "string"), ("tfm", "string"), ("file", "string"), ("line", "int"), ("column", "int"))), no.alias("is_entry_point"))
    parts = [
        rows(nations(spark, sf_dir), "nation", "n_nationkey", F.col("n_name"), "namespace", F.lit("namespace"), no),
        rows(table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")), "supplier", "s_suppkey", F.col("s_name"), "type", F.lit("class"), no),
        rows(customer, "customer", "c_custkey", F.col("c_name"), "method", raw, F.col("c_custkey") % 100 == 0),
        rows(part, "part", "p_partkey", F.col("p_name"), "property", F.lit("property"), no, namespace="p_brand", line=F.col("p_size")),
        rows(orders, "order", "o_orderkey", F.concat(F.lit("Order"), F.col("o_orderkey").cast("string")), "method", F.lit("ordinary"), no),
        root,
    ]
    return reduce(DataFrame.unionByName, parts)


def observations(spark: SparkSession, sf_dir: str, which: tuple[str, ...] = ("parts", "calls", "orders", "hierarchy")) -> DataFrame:
    """(source_id, target_id, relation, evidence, confidence, file, line, column); location columns are null where there is none."""
    line = table(spark, sf_dir, "lineitem")
    place = {"file": F.concat(F.lit("orders/"), F.col("l_orderkey").cast("string"), F.lit(".cs")), "line": F.col("l_linenumber").cast("int"), "column": F.col("l_quantity").cast("int")}
    told = place | {"evidence": F.expr("case l_returnflag when 'A' then 'extracted' when 'N' then 'inferred' else 'ambiguous' end"), "confidence": 1 - F.col("l_discount")}
    tail = ["evidence", "confidence", "file", "line", "column"]
    nowhere = [F.lit("extracted").alias("evidence"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column")]
    out: list[DataFrame] = []
    if "parts" in which:
        out.append(line.withColumns(told).select(ident("order", "l_orderkey").alias("source_id"), ident("part", "l_partkey").alias("target_id"), F.expr("if(l_linestatus = 'O', 'calls', 'references')").alias("relation"), *tail))
    if "calls" in which:
        bought = line.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).withColumns(told)  # texts are made behind the join
        out.append(bought.select(ident("customer", "o_custkey").alias("source_id"), ident("supplier", "l_suppkey").alias("target_id"), F.lit("calls").alias("relation"), *tail))
    if "orders" in which:
        o = table(spark, sf_dir, "orders").withColumn("f", F.col("o_orderstatus") == "F")
        at = [F.when(~F.col("f"), F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string"), F.lit(".cs"))).alias("file"), F.when(~F.col("f"), F.lit(1)).alias("line"), F.when(~F.col("f"), F.lit(1)).alias("column")]
        out.append(o.select(ident("order", "o_orderkey").alias("source_id"), ident("customer", "o_custkey").alias("target_id"), F.lit("references").alias("relation"), *nowhere[:2], *at))
    if "hierarchy" in which:
        s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
        out.append(s.where("s_suppkey <> s_suppkey % 10").select(ident("supplier", "s_suppkey").alias("source_id"), F.concat(F.lit("supplier:"), (F.col("s_suppkey") % 10).cast("string")).alias("target_id"), F.lit("inherits").alias("relation"), *nowhere))
        out.append(c.select(ident("customer", "c_custkey").alias("source_id"), ident("nation", "c_nationkey").alias("target_id"), F.lit("implements").alias("relation"), *nowhere))
        out.append(c.where("c_custkey <> c_custkey % 100").select(ident("customer", "c_custkey").alias("source_id"), F.concat(F.lit("customer:"), (F.col("c_custkey") % 100).cast("string")).alias("target_id"), F.lit("overrides").alias("relation"), *nowhere))
    return reduce(DataFrame.unionByName, out)


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, path, old_path, kind, cold, is_directory) from the events table."""
    kind = F.expr("case event_type when 'signup' then 'created' when 'purchase' then 'renamed' when 'error' then 'deleted' else 'changed' end")
    e = table(spark, sf_dir, "events").withColumn("kind", kind)
    path = F.concat(F.lit("user/"), F.col("user_id").cast("string"))
    old = F.when(F.col("kind") == "renamed", F.concat(F.lit("user/"), (F.col("user_id") + 1).cast("string")))
    directory = F.expr("case event_id % 3 when 0 then true when 1 then false end")
    return e.select("event_id", "ts", path.alias("path"), old.alias("old_path"), "kind", (F.col("value") > 40).alias("cold"), directory.alias("is_directory"))


def inventory(spark: SparkSession, sf_dir: str, state: str) -> DataFrame:
    """(path, project, length, sha) of the documents as files, before and after an edit."""
    d = table(spark, sf_dir, "documents").withColumns({"path": F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")), "sha": F.sha2("text", 256)})
    if state == "previous":
        return d.where("doc_id % 10 <> 0").select("path", F.col("source").alias("project"), F.col("n_chars").alias("length"), "sha")
    changed = F.expr("doc_id % 7 = 0")
    return d.where("doc_id % 11 <> 0").select("path", F.col("source").alias("project"), (F.col("n_chars") + changed.cast("long")).alias("length"), F.when(changed, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.col("sha")).alias("sha"))


def call_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, formal_ordinal, expression_start, expression, callee_id, kind): lineitems as arguments of their order's call."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_orderkey").alias("site"), F.col("l_linenumber").alias("formal_ordinal"), F.col("l_partkey").alias("expression_start"), F.col("l_suppkey").alias("expression_length"), F.col("l_extendedprice").alias("price"), ident("part", "l_partkey").alias("callee_id"), F.lit("explicit").alias("argument_kind"))


def signature_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of signatures: suppliers as types, customers as methods, parts as properties."""
    parameter = "named_struct('ordinal', {0}, 'name', '{1}', 'type', '{2}', 'ref_kind', '{3}', 'is_params', false, 'is_optional', {4}, 'has_default', {4}, 'default', {5}, 'nullable_annotation', 'none')"
    generic = "named_struct('ordinal', 0, 'name', 'T', 'reference_type_constraint', true, 'value_type_constraint', false, 'not_null_constraint', false, 'unmanaged_type_constraint', false, 'constructor_constraint', false, 'constraint_types', array('IB', 'IA'))"
    two = f"array({parameter.format(0, 'a', 'int', 'none', 'false', 'null')}, {parameter.format(1, 'b', 'string', 'ref', 'true', chr(39) + chr(34) + 'x' + chr(34) + chr(39)) })"
    one = f"array({generic})"
    none = lambda of: f"filter({of}, x -> false)"
    names = ("id", "symbol_class", "accessibility", "flags", "containing", "type", "returns", "is_constructor", "parameters", "generic_parameters", "nullable")

    def rows(df: DataFrame, *cols: str) -> DataFrame:
        return df.selectExpr(*(f"{c} as {n}" for c, n in zip(cols, names, strict=True)))

    s = rows(table(spark, sf_dir, "supplier"), "concat('supplier:', s_suppkey)", "'type'", "if(s_suppkey % 2 = 0, 'internal', 'public')", "map('sealed', s_suppkey % 7 = 0, 'abstract', s_suppkey % 5 = 0, 'static', s_suppkey % 3 = 0, 'async', true)", "'N'", "s_name", "'void'", "false", two, f"if(s_suppkey % 4 = 0, {one}, {none(one)})", "if(s_suppkey % 2 = 0, 'annotated', 'notannotated')")
    c = rows(table(spark, sf_dir, "customer"), "concat('customer:', c_custkey)", "'method'", "'public'", "map('readonly', c_custkey % 4 = 0, 'override', c_custkey % 3 = 0, 'static', c_custkey % 2 = 0, 'extern', null)", "concat('T', c_nationkey)", "null", "c_mktsegment", "c_custkey % 4 = 1", f"if(c_custkey % 3 = 0, {none(two)}, {two})", none(one), "'annotated'")
    p = rows(table(spark, sf_dir, "part"), "concat('part:', p_partkey)", "'property'", "'private'", "map('virtual', p_size % 2 = 0, 'static', p_size % 3 = 0)", "p_brand", "p_type", "null", "false", none(two), none(one), "'none'")
    return s.unionByName(c).unionByName(p)


def argument_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as arguments of their order's call, with all that an argument item tells; their text is ``argument_text``."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    file = "concat('orders/', l_orderkey % 500, '.cs')"
    return l.selectExpr(
        "concat('customer:', o_custkey) as caller_id", "concat('part:', l_partkey) as callee_id", "concat('project=src/p', l_orderkey % 5) as project_key", "concat('src/p', l_orderkey % 5, '.csproj') as project",
        f"{file} as file", "int(l_linenumber) as line", "1 as column", f"concat('gen/', {file}) as tree_path", "l_orderkey as invocation_start", "bigint(l_quantity) as invocation_length",
        "if(l_linenumber = 1, null, concat('formal:', l_linenumber)) as formal_id", "if(l_linenumber = 1, null, int(l_linenumber) - 1) as formal_ordinal", "if(l_linenumber = 1, null, concat('p', l_linenumber)) as formal_name",
        "if(l_linenumber = 1, 'extension_receiver', 'explicit') as argument_kind", "l_linestatus = 'O' as is_implicit", "l_partkey * 100 + l_suppkey as expression_start", "bigint(l_linenumber) as expression_length",
        "concat('x', l_suppkey) as word", "int(l_quantity) * 10 as words", "'int' as expression_type", "if(l_linenumber = 1, null, 'long') as converted_type",
        "if(l_returnflag = 'A', string(l_suppkey), if(l_returnflag = 'N', 'say \"', null)) as constant", "if(l_returnflag = 'A', 'number', 'string') as constant_kind", "l_linenumber % 2 = 0 as has_constant",
    )


def argument_text() -> Column:
    """The text of an argument of ``argument_facts``: up to 2,500 characters and more, so it is made where it is wanted."""
    return F.expr("repeat(word, words)")


def operations(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...]) -> DataFrame:
    """Lineitems as bound operations of some kinds, each with a member for each role a rule knows: members are parts and suppliers by turns."""
    roles = ("method", "constrained_type", "operator", "member", "getter", "setter", "add", "remove", "length", "indexer", "slice", "deconstruct", "get_enumerator", "move_next", "current", "dispose", "get_awaiter", "is_completed", "get_result", "on_completed", "get_pinnable_reference", "alias")
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey")
    l = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.expr("(l_orderkey + l_linenumber) % {0}".format(len(kinds))) + 1).cast("int"))
    members = F.array(*(F.struct(ident(prefix, key).alias("member_id"), F.array(*map(F.lit, own)).alias("roles")) for prefix, key, own in (("part", "l_partkey", roles[::2]), ("supplier", "l_suppkey", roles[1::2]))))
    use = F.expr("case l_linenumber % 3 when 0 then 'read' when 1 then 'write' else 'read_write' end")
    return l.select(ident("customer", "o_custkey").alias("caller_id"), kind.alias("op_kind"), members.alias("members"), use.alias("use"), (F.col("l_linenumber") % 2 == 0).alias("is_declaration"), (F.col("l_linestatus") == "O").alias("adds"), F.when(F.col("l_returnflag") != "R", F.concat(F.lit("orders/"), F.col("l_orderkey").cast("string"), F.lit(".cs"))).alias("file"), F.col("l_linenumber").cast("int").alias("line"), F.lit(1).alias("column"))


def project_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, refers_to): each nation refers to the one at half its key, the first to itself."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("project"), F.floor(F.col("n_nationkey") / 2).cast("long").alias("refers_to"))

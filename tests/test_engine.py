"""Semantics that are easy to get wrong, on hand-made tables."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarrygraph import schema
from quarrygraph.functions import identity as I
from quarrygraph.operators import derive, incremental, merge, verbs
from quarrygraph.operators.filters import Filters, excludes_folder, glob, temporary_of
from quarrygraph.plans import batches, export, paging, request, sessions
from quarrygraph.plans.session import Cache, Lease, Session, cached_refresher, integrity_problems, refresh, sidecar
from quarrygraph.sources import discovery
from quarrygraph.streaming.dirty import DirtyState, Generation, admitted, path_decision, replay, unconsumed

OBS = "source_id string, target_id string, relation string, evidence string, confidence double, file string, line int, column int"
DECL = "id string, label string, node_kind string, raw_kind string, namespace string, project string, tfm string, file string, line int, column int, is_entry_point boolean"


def decl(spark, *rows):
    full = [(i, label, node, raw, ns, p, tfm, f"{i}.cs", 1, 1, False) for i, label, node, raw, ns, p, tfm in rows]
    return spark.createDataFrame(full, DECL)


@pytest.fixture(scope="module")
def graph(spark):
    d = decl(
        spark,
        ("m1", "Called(int)", "method", "ordinary", "Production", "p1", "net8"),
        ("m2", "Called(string)", "method", "ordinary", "Production", "p1", "net9"),
        ("c1", "Caller.Run", "method", "ordinary", "Production.Sub", "p1", "net8"),
        ("c2", "Caller.Run", "method", "ordinary", "Production.Sub", "p2", "net9"),
        ("t1", "Base", "type", "class", "", "p1", "net8"),
        ("p1", "Unused", "property", "property", "Productions", "p1", "net8"),
        ("x", "<external>", "external_root", "external_root", None, None, None),
        ("lf", "Local", "method", "localfunction", "Production", "p1", "net8"),
    )
    o = spark.createDataFrame(
        [
            ("c1", "m1", "calls", "extracted", 0.7, "a.cs", 10, 5),
            ("c1", "m1", "calls", "extracted", 1.0, "a.cs", 10, 5),
            ("c1", "m1", "calls", "extracted", 0.8, "a.cs", 2, 5),
            ("c2", "m1", "references", "inferred", 0.9, None, None, None),
            ("gone", "m1", "calls", "extracted", 1.0, "g.cs", 1, 1),
            ("c1", "m1", "dispatches_to", "ambiguous", 0.5, "a.cs", 3, 1),
            ("m2", "t1", "inherits", "extracted", 1.0, None, None, None),
            ("m2", "m1", "overrides", "extracted", 1.0, "b.cs", 1, 1),
        ],
        OBS,
    )
    return d, o


def test_merge_keeps_largest_confidence_and_distinct_places(graph):
    rows = {(r.source_id, r.relation): r for r in merge.merged_edges(graph[1]).collect()}
    called = rows["c1", "calls"]
    assert called.confidence == 1.0 and [x.line for x in called.locations] == [2, 10]
    assert rows["c2", "references"].locations == []


def test_confidence_is_checked(spark):
    for bad in (1.1, float("nan"), -0.1):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(bad,)], "c double").select(schema.checked_confidence(F.col("c"))).collect()


def test_conflicting_property_is_an_error(spark):
    ok = merge.merged_properties(spark.createDataFrame([("a", "k", "1"), ("a", "k", "1"), ("a", "j", "2")], "id string, key string, value string")).collect()
    assert ok[0].properties == {"j": "2", "k": "1"}
    with pytest.raises(PySparkException):
        merge.merged_properties(spark.createDataFrame([("a", "k", "1"), ("a", "k", "2")], "id string, key string, value string")).collect()


def test_usages_drop_undeclared_origins_and_summaries_keep_them(graph):
    d, o = graph
    use = verbs.usages(merge.merged_edges(o), d, "m1").collect()
    assert {r.origin_id for r in use} == {"c1", "c2", "m2"}
    assert [(r.file, r.line) for r in use if r.origin_id == "c2"] == [(None, None)]
    assert {r.relation for r in use} >= {"dispatchesto"}
    assert any("DispatchesTo" in r.sort_key for r in use)
    rows = [r for r in verbs.usage_summary(o, d, ("namespace",)).collect() if r.target_id == "m1"]
    external = [r for r in rows if r.is_external_root]
    assert len(external) == 1 and external[0].namespace is None and external[0].target_framework is None and external[0].calls_edges == 1
    # One namespace over two frameworks is two groups.
    assert sorted(r.target_framework for r in rows if r.namespace == "Production.Sub") == ["net8", "net9"]
    one = [r for r in verbs.usage_summary(o, d).collect() if r.target_id == "m1"]
    assert len(one) == 1 and one[0].calls_edges == 2 and one[0].calls_occurrences == 3 and one[0].references_edges == 1 and one[0].references_occurrences == 0 and one[0].origins == 4


def test_unused_target_has_one_zero_row(graph):
    d, o = graph
    rows = [r for r in verbs.usage_summary(o, d, ("project", "namespace")).collect() if r.target_id == "p1"]
    assert len(rows) == 1 and not rows[0].is_external_root and rows[0].project is None and rows[0].origins == 0


def test_filters(graph):
    d, _ = graph
    ids = lambda f: sorted(r.id for r in verbs.symbols(d, f).collect())
    assert ids(Filters(namespace="Production")) == ["c1", "c2", "lf", "m1", "m2"]
    assert ids(Filters(namespace="")) == ["t1"]
    assert ids(Filters(search="cALLED")) == ["m1", "m2"]
    assert ids(Filters(kind="localfunction")) == [] and "lf" in ids(Filters(kind="method"))
    assert ids(Filters(path="m1.cs")) == ["m1"] and ids(Filters(path="m")) == []
    assert "x" not in ids(Filters())


def test_hierarchy(graph):
    d, o = graph
    e = merge.merged_edges(o)
    assert [r.neighbour_id for r in verbs.hierarchy(e, d, "m2", "base").collect()] == ["t1"]
    assert [r.neighbour_id for r in verbs.hierarchy(e, d, "m1", "implementations").collect()] == ["m2"]
    assert {r.direction for r in verbs.hierarchy(e, d, "m2", "all").collect()} == {"base", "contracts"}


def test_identity(spark):
    one = spark.range(1)
    key = "csharp/v1|project=src/App/App.csproj|tfm=net10.0|symbol=method|namespace=App|type=Caller|member=|name=Run|arity=0|params=|return=|discriminator="
    none = F.lit("")
    ref = I.reference_key(F.lit("method"), F.lit("global::App"), F.lit("Caller"), none, F.lit("Run"), F.lit(0), none, none, none)
    row = one.select(I.canonical_key(I.project_key(F.lit(".\\src\\App\\App.csproj"), F.lit("net10.0")), ref).alias("k")).withColumn("i", I.node_id(F.col("k"))).first()
    assert row.k == key and row.i == "cs_e181816c3ab7d0abd5e8bb4bcc9cb4bc102b208f481c1012f712777059ef06ce"
    assert one.select(I.escape(F.lit("a%|=,;"))).first()[0] == "a%25%7C%3D%2C%3B"
    assert one.select(I.normal_namespace(F.lit("global::A..B ."))).first()[0] == "A.B"
    assert one.select(I.snake_case(F.lit("DispatchesTo"))).first()[0] == "dispatches_to"
    words = spark.createDataFrame([("￿",), ("\U0001f600",)], "w string")
    assert [r.w for r in words.orderBy(I.ordinal_text(F.col("w"))).collect()] == ["\U0001f600", "￿"]
    shown = I.display_name(F.lit("constructor"), F.lit(".ctor"), F.lit("N"), F.array(F.lit("A"), F.lit("B")), F.array().cast("array<string>"), F.lit(0), F.array(F.lit("int")), F.lit(None).cast("string"))
    assert one.select(shown).first()[0] == "N.A.B.B(int)"


def test_globs(spark):
    paths = spark.createDataFrame([(p,) for p in ("a.cs", "src/a.cs", "src/x/a.cs", "src/obj/a.cs", "src/a.txt")], "p string")
    hit = lambda *p, x=None: sorted(r.p for r in paths.where(glob(F.col("p"), list(p), x)).collect())
    assert hit("**/*.cs") == ["a.cs", "src/a.cs", "src/obj/a.cs", "src/x/a.cs"]
    assert hit("src/*.cs") == ["src/a.cs"]
    assert hit("**/?.cs", x=["**/obj/**"]) == ["a.cs", "src/a.cs", "src/x/a.cs"]
    folder = spark.createDataFrame([("src/obj",), ("src",)], "p string")
    assert [r.p for r in folder.where(excludes_folder(F.col("p"), ["src/obj/**"])).collect()] == ["src/obj"]
    assert folder.where(excludes_folder(F.col("p"), ["src/*.cs"])).count() == 0
    t = spark.range(1).select(temporary_of(F.lit("d/.x.json.12.tmp"), F.lit("d/x.json")).alias("a"), temporary_of(F.lit("d/e/.x.json.12.tmp"), F.lit("d/x.json")).alias("b")).first()
    assert t.a and not t.b


def test_arguments_expand_and_sort(spark):
    sites = spark.createDataFrame([(1, 0, 30, 1, 1.0, "m", "explicit"), (1, 0, 20, 1, 1.0, "m", "explicit"), (1, 1, 5, 1, 1.0, "m", "explicit"), (1, -1, 0, 0, 0.0, "m", "no_arguments")], "site long, formal_ordinal int, expression_start long, expression_length long, price double, callee_id string, argument_kind string")
    out = verbs.arguments(sites)
    rows = {(r.formal_ordinal, r.expression_start): r for r in out.withColumn("k", verbs.argument_key(out)).collect()}
    assert rows[0, 20].expansion_index == 0 and rows[0, 30].expansion_index == 1 and rows[0, 30].argument_kind == "params_expansion" and rows[1, 5].argument_kind == "explicit"
    assert rows[-1, 0].k.split("\x1f")[1] == "-00001"


def test_derivation(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "source_id string, target_id string")
    reach = {(r.start, r.reached): r.depth for r in derive.closure(edges).collect()}
    assert reach["d", "c"] == 3 and reach["a", "a"] == 3 and len(reach) == 12
    types = spark.createDataFrame([("C", "I", "interface"), ("I", "J", "interface"), ("C", "B", "base"), ("B", "A", "base")], "source_id string, target_id string, kind string")
    got = {tuple(r) for r in derive.interface_edges(types).collect()}
    assert got == {("C", "I", "implements"), ("C", "J", "implements"), ("I", "J", "implements"), ("C", "B", "inherits"), ("B", "A", "inherits")}
    refs = spark.createDataFrame([("k1", 1), ("k2", 2), ("k3", 3)], "k string, n int")
    d = spark.createDataFrame([("k1", "x"), ("k2", "y"), ("k2", "z")], "k string, id string")
    assert [tuple(r) for r in derive.unique_matches(refs, d, "k").collect()] == [("k1", 1, "x")]
    assert {r.n: r.id for r in derive.resolve(refs, [(d, "k"), (spark.createDataFrame([("k2", "w")], "k string, id string"), "k")]).collect()} == {1: "x", 2: "w", 3: None}
    sym = spark.createDataFrame([("f", "outer", 0, 1000), ("f", "inner", 100, 200), ("g", "other", 0, 10)], "file string, id string, start long, end long")
    pos = spark.createDataFrame([("f", 150), ("f", 200), ("f", 999), ("f", 1000)], "file string, position long")
    assert {r.position: r.symbol_id for r in derive.innermost(pos, sym).collect()} == {150: "inner", 200: "outer", 999: "outer"}


def test_unpacked_arguments_and_diagnostics(spark):
    s = spark.createDataFrame([(1, ["a", "b"], True), (2, [], False)], "site long, arguments array<string>, extension boolean")
    assert sorted((r.site, r.argument_kind) for r in derive.unpacked_arguments(s).collect()) == [(1, "explicit"), (1, "extension_receiver"), (2, "no_arguments")]
    good, bad = derive.split_recoverable(s, F.when(F.size("arguments") == 0, F.lit("nothing")))
    assert good.count() == 1 and [r.diagnostic for r in bad.collect()] == ["nothing"]
    rows = spark.createDataFrame([(" b ",), ("b",), ("",), ("a" * 5000,)], "diagnostic string")
    assert [(len(r.diagnostic), r.truncated) for r in incremental.distinct_diagnostics(rows).collect()] == [(4096, True), (1, False)]


def test_journal_fold_is_ordered(spark):
    rows = [("p", None, "changed", False, d, i) for i, d in enumerate([True, False, True])] + [("q", None, "changed", True, d, i) for i, d in enumerate([True, None, False])] + [("q", "o", "renamed", False, None, 9)]
    e = spark.createDataFrame(rows, "path string, old_path string, kind string, cold boolean, is_directory boolean, clock long")
    got = {(r.path, r.old_path): (r.kind, r.cold, r.is_directory) for r in incremental.coalesced_journal(e).collect()}
    assert got == {("p", None): ("changed", False, True), ("q", None): ("changed", True, None), ("q", "o"): ("renamed", False, None)}
    assert {r.path for r in incremental.dirty_paths(e).collect()} == {"p", "q", "o"}
    folded, over = replay(e, most=2)
    assert over and folded.count() == 3


def test_fingerprints(spark):
    f = spark.createDataFrame([("a", "metadata_match", True), ("a", "content_match", True), ("b", "content_match", False), ("c", "content_match", True)], "project string, comparison string, complete boolean")
    assert {r.project: r.comparison for r in incremental.combined_comparison(f).collect()} == {"a": "metadata_match", "b": "different", "c": "content_match"}
    refs = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "e")], "project string, refers_to string")
    assert sorted(r.project for r in incremental.reverse_closure(spark.createDataFrame([("a",)], "project string"), refs).collect()) == ["a", "b", "c"]


def test_batches():
    assert batches.boundaries([1] * 10, workers=4) == [10]
    assert batches.boundaries([1] * 1000, workers=4) == [125, 250, 375, 500, 625, 750, 875, 1000]
    assert batches.boundaries([1000] + [1] * 127, workers=4) == [1, 44, 86, 128]
    assert batches.boundaries([1] * 1000, workers=1) == [1000] and batches.boundaries([], 2) == []
    with pytest.raises(ValueError):
        batches.boundaries([1], 0)


def test_requests():
    spec, timeout, _ = request.parse('{"command": "usages", "query": {"symbol_id": "a", "filters": {"kind": "method"}, "limit": 5}}')
    assert spec.limit == 5 and timeout == 600_000
    for raw, code in (
        ('{"command": "usages"}', "invalid_arguments"),
        ('{"command": "symbols", "command": "symbols"}', "invalid_request"),
        ('{"command": "symbols", "other": 1}', "invalid_request"),
        ('{"command": "symbols", "query": {"limit": 0}}', "invalid_arguments"),
        ('{"command": "symbols", "query": {"limit": true}}', "invalid_request"),
        ('{"command": "symbols", "query": {"filters": {"kind": "thing"}}}', "invalid_arguments"),
        ('{"command": "usage-summary", "query": {"group_by": ["project", "project"]}}', "invalid_arguments"),
        ('{"command": "signature", "query": {"symbol_id": "a", "cursor": "x"}}', "invalid_arguments"),
        ('{"command": "export"}', "invalid_arguments"),
        ('{"command": "refresh", "query": {"search": "x"}}', "invalid_arguments"),
        ("[" * 100 + "]" * 100, "invalid_request"),
        ("{", "invalid_request"),
        (" " * 70_000, "invalid_request"),
        ('{"protocol_version": 2, "command": "symbols"}', "incompatible_protocol"),
    ):
        with pytest.raises(request.QueryError) as e:
            request.parse(raw)
        assert e.value.code == code, raw
    assert request.exit_code("server_busy") == 4 and request.exit_code(None) == 5 and request.exit_code("cancelled") == 130


def test_pages_and_cursors(graph):
    d, o = graph
    s = Session(d, o)
    spec = request.Spec("symbols", limit=3)
    first = s.run(spec)
    assert first["success"] and first["page"]["has_more"] and len(first["items"]) == 3
    seen, cursor = [i["id"] for i in first["items"]], first["page"]["cursor"]
    while cursor:
        r = s.run(request.Spec("symbols", limit=2, cursor=cursor))  # another limit is fine
        seen += [i["id"] for i in r["items"]]
        cursor = r["page"]["cursor"]
    assert sorted(seen) == ["c1", "c2", "lf", "m1", "m2", "p1", "t1"] and len(set(seen)) == 7
    cursor = first["page"]["cursor"]
    code = lambda **k: s.run(request.Spec("symbols", **k))["error"]["code"]
    assert code(cursor=cursor, search="x") == "invalid_cursor" and code(cursor=cursor[:-2] + "zz") == "invalid_cursor" and code(cursor="a.b.c") == "invalid_cursor"
    s.publish(d, o)
    assert code(cursor=cursor) == "stale_snapshot"
    assert s.run(request.Spec("usages", symbol_id="nope"))["error"]["code"] == "symbol_not_found"
    assert s.run(request.Spec("arguments", symbol_id="t1"))["error"]["code"] == "unsupported_symbol"
    assert s.run_json('{"command": "symbols", "session_id": "other"}')["error"]["code"] == "session_mismatch"
    cold = Session(d, o, view=paging.View(warm=False)).run(request.Spec("symbols", limit=2))
    assert cold["page"]["continuation_unavailable"] and cold["page"]["cursor"] is None


def test_every_verb_answers(graph, tmp_path):
    d, o = graph
    s = Session(d, o, view=paging.View(diagnostics=(" one ", "one", "")))
    for spec in (request.Spec("symbols"), request.Spec("signature", symbol_id="m1"), request.Spec("callers", symbol_id="m1"), request.Spec("hierarchy", symbol_id="m1"), request.Spec("usage-summary", group_by=("project", "namespace")), request.Spec("refresh")):
        r = s.run(spec)
        assert r["success"], r
        assert r["diagnostics"] == ["one"] and r["scope"]["operation_complete"] == (spec.command == "refresh")


def test_byte_budget(graph):
    view, spec = paging.View(), request.Spec("symbols")
    df = verbs.symbols(graph[0])
    whole = len(paging.render(paging.respond(df, "sort_key", view, spec)))
    cut = paging.respond(df, "sort_key", view, spec, most=whole - 10)
    assert cut["page"]["has_more"] and 0 < len(cut["items"]) < 7 and len(paging.render(cut)) <= whole - 10
    with pytest.raises(request.QueryError, match="one row"):
        paging.respond(df, "sort_key", view, spec, most=100)


def test_export_is_valid_and_repeatable(spark, graph, tmp_path):
    d, o = graph
    nodes = d.select("id", "label", F.col("node_kind"), F.col("id").alias("symbol_key"), F.create_map(F.lit("symbol_key"), F.lit("own")).alias("properties"), F.array(F.struct("file", "line", "column")).alias("locations"))
    edges = merge.merged_edges(o.where("source_id <> 'gone'"))
    a = export.write_document(nodes, edges, str(tmp_path / "a.json"), ["x", " x "])
    b = export.write_document(nodes.repartition(3), edges.repartition(5), str(tmp_path / "b.json"), ["x"])
    assert a == b and (tmp_path / "a.json").read_bytes() == (tmp_path / "b.json").read_bytes()
    doc = json.loads((tmp_path / "a.json").read_text())
    assert doc["directed"] and doc["hyperedges"] == [] and len(doc["nodes"]) == 8 and doc["metadata"]["diagnostics"] == ["x"]
    assert doc["nodes"][0]["properties"]["symbol_key"] == "own" and doc["edges"][0]["confidence"].isupper()
    with pytest.raises(ValueError, match="gone"):
        export.write_document(nodes, merge.merged_edges(o), str(tmp_path / "c.json"))
    assert not list(tmp_path.glob(".*.tmp"))
    assert export.conflict(str(tmp_path / "a.json"), [str(tmp_path / "a.json")], []) and export.conflict(str(tmp_path / "s/x"), [], [str(tmp_path / "s")])


def test_cache_statuses_and_refresh(spark, tmp_path):
    cache = Cache(spark, str(tmp_path))
    assert cache.load()[0] == "missing"
    prints = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "project string, digest string")
    refs = spark.createDataFrame([("b", "a")], "project string, refers_to string")
    extract = lambda df: df.select("project", "digest", F.lit(1).alias("x"))
    assert refresh(cache, prints, refs, extract) == {"extracted_projects": 3, "reused_projects": 0}
    assert refresh(cache, prints, refs, extract) == {"extracted_projects": 0, "reused_projects": 3}
    edited = prints.withColumn("digest", F.when(F.col("project") == "a", "2").otherwise(F.col("digest")))
    assert refresh(cache, edited, refs, extract) == {"extracted_projects": 2, "reused_projects": 1}
    m = json.loads((tmp_path / "manifest.json").read_text())
    (tmp_path / "manifest.json").write_text(json.dumps(m | {"projects": {}}))
    assert cache.load()[0] == "corrupt"
    (tmp_path / "manifest.json").write_text(json.dumps(m | {"version": "cache/v0"}))
    assert cache.load()[0] == "incompatible"
    (tmp_path / "manifest.json").write_text("{")
    assert cache.load()[0] == "corrupt"
    c = spark.createDataFrame([("a", "1"), ("d", "1"), ("b", "2")], "project string, digest string")
    assert {r.project: r.problem for r in integrity_problems(prints, c).collect()} == {"b": "other digest", "c": "no contribution", "d": "not listed"}


def test_lease_is_exclusive(tmp_path):
    with Lease(str(tmp_path / "x")), pytest.raises(request.QueryError):
        Lease(str(tmp_path / "x")).__enter__()


def test_generations():
    g = Generation("s").advance(event=5).advance(indexed=3).advance(published=3)
    assert g.reached("s", 3) and not g.reached("s", 4)
    with pytest.raises(ValueError):
        g.advance(indexed=2)
    with pytest.raises(ValueError):
        g.reached("other", 1)


def test_dirty_state(spark, tmp_path):
    state = DirtyState(spark, str(tmp_path / "state"))
    e = spark.createDataFrame([(1, "a", None, "changed", False, None), (2, "b", "a", "renamed", False, None)], "event_id long, path string, old_path string, kind string, cold boolean, is_directory boolean").withColumn("ts", F.to_timestamp(F.lit("2024-01-01")))
    state.add(e, 0)
    state.add(e, 0)  # a replayed batch
    assert {r.path: (r.first_generation, r.last_generation) for r in state.paths().collect()} == {"a": (1, 2), "b": (2, 2)}
    state.add(e, 1)
    assert [r.path for r in state.barrier(1).collect()] == ["a"]
    state.processed(2)
    assert {r.path: r.first_generation for r in state.paths().collect()} == {"a": 4, "b": 4}
    state.distrust()
    assert state.paths().where("not cold").count() == 0 and not state.pointer["trusted"]
    state.rescanned()
    assert state.paths().count() == 0 and state.pointer["trusted"]


def test_admission_and_decisions(spark):
    e = spark.createDataFrame([("a", 1, False), ("b", 2, False)], "path string, epoch int, cold boolean")
    assert {r.path: r.cold for r in admitted(e, 2).collect()} == {"a": True, "b": False}
    s = spark.createDataFrame([("a",), ("b",)], "path string")
    assert {r.path: r.decision for r in path_decision(admitted(e, 2), s).collect()} == {"a": "cold", "b": "warm"}
    c = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha string")
    assert [r.path for r in unconsumed(c, spark.createDataFrame([("a", "1")], "path string, sha string")).collect()] == ["b"]


def test_long_chains_are_cut(spark):
    chain = spark.range(20).selectExpr("cast(id as string) as source_id", "cast(id + 1 as string) as target_id")
    assert derive.closure(chain).where("start = '0'").count() == 20
    refs = chain.selectExpr("source_id as project", "target_id as refers_to")
    assert incremental.reverse_closure(spark.createDataFrame([("20",)], "project string"), refs).count() == 21


def test_smaller_rules(spark):
    m = spark.createDataFrame([("p", "b", 1), ("p", "a", 0)], "pointer_id string, method_id string, position int")
    assert [tuple(r) for r in derive.first_method(m).collect()] == [("p", "a")]
    row = spark.range(1).select(derive.event_accessor(F.lit(True), F.lit("add"), F.lit("remove")).alias("e"), derive.dispose_target(F.lit(None).cast("string"), F.lit("i")).alias("d")).first()
    assert (row.e, row.d) == ("add", "i")
    k = lambda *x: spark.createDataFrame([(i,) for i in x], "k string")
    assert incremental.same_members(k("a", "b", "b"), k("b", "a"), "k") and not incremental.same_members(k("a"), k("a", "b"), "k")


def test_progress_lines():
    import io

    from quarrygraph.plans.progress import Progress

    now, out = [0.0], io.StringIO()
    p = Progress(out, lambda: now[0])
    for t, done in ((0, 0), (0.5, 1), (1.0, 1), (2.0, 1), (11.0, 1), (61.5, 2)):
        now[0] = t
        p.line("extract", done, 3)
    p.summary(2, 1)
    assert out.getvalue().splitlines() == ["[00:00] extract 0/3", "[00:01] extract 1/3", "[00:11] extract 1/3", "[01:01] extract 2/3", "done in 01:01: 2 extracted, 1 reused"]


def test_chains_longer_than_any_round_limit(spark):
    chain = spark.range(70).selectExpr("cast(id as string) as source_id", "cast(id + 1 as string) as target_id")
    assert max(r.depth for r in derive.closure(chain).where("start = '0'").collect()) == 70
    refs = chain.selectExpr("source_id as project", "target_id as refers_to")
    assert incremental.reverse_closure(spark.createDataFrame([("70",)], "project string"), refs).count() == 71
    rules = spark.createDataFrame([("0", "*.cs", ["x"])], "item string, glob string, excludes array<string>")
    forwards = spark.range(40).selectExpr("cast(id + 1 as string) as item", "cast(id as string) as upstream", "array('y') as excludes")
    assert {int(r.item) for r in discovery.candidate_rules(rules, forwards).collect()} == set(range(41))


def test_scopes_of_hierarchy_and_arguments(spark, graph):
    d, o = graph
    facts = spark.createDataFrame(
        [("m2", "m1", "project=a", "src/a.csproj", f, 1, 1, f, s, 5, "f1", 0, "x", "explicit", False, s + 2, 3, "1", "int", "int", "1", "number", True) for f, s in (("x/a.cs", 10), ("y/b.cs", 20), ("y/b.cs", 30))],
        "caller_id string, callee_id string, project_key string, project string, file string, line int, column int, tree_path string, invocation_start long, invocation_length long, formal_id string, formal_ordinal int, formal_name string, argument_kind string, is_implicit boolean, expression_start long, expression_length long, expression string, expression_type string, converted_type string, constant string, constant_kind string, has_constant boolean",
    )
    s = Session(d, o, arguments=facts, root="/r")
    run = lambda **k: s.run(request.Spec("arguments", symbol_id="m1", **k))
    whole = run()
    assert [i["invocation_span"]["start"] for i in whole["items"]] == [10, 20, 30] and len(whole["items"][0]) == 17 and whole["items"][0]["constant_value"] == "1"
    assert [i["invocation_span"]["start"] for i in run(filters={"path": "/r/y"})["items"]] == [20, 30]
    assert run(filters={"project": "src/b.csproj"})["items"] == [] and run(filters={"kind": "method"})["error"]["code"] == "invalid_arguments"
    first = run(limit=1)
    assert [i["invocation_span"]["start"] for i in run(limit=5, cursor=first["page"]["cursor"])["items"]] == [20, 30]
    assert s.run(request.Spec("arguments", symbol_id="p1"))["error"]["code"] == "unsupported_symbol"
    near = lambda **k: {i["neighbour_id"] for i in s.run(request.Spec("hierarchy", symbol_id="m2", **k))["items"]}
    assert near() == {"t1", "m1"} and near(filters={"kind": "class"}) == {"t1"} and near(filters={"namespace": "nowhere"}) == set()


def test_the_index_is_folded_once_a_revision(graph):
    d, o = graph
    s = Session(d, o)
    near = s.run(request.Spec("hierarchy", symbol_id="m2"))["items"]
    held = s.edges()
    assert near and s.run(request.Spec("hierarchy", symbol_id="m2"))["items"] == near and s.edges() is held
    s.publish(d, o.where("relation = 'calls'"))
    assert s.run(request.Spec("hierarchy", symbol_id="m2"))["items"] == [] and s.edges() is not held


def test_refresh_tells_what_it_did(spark, graph, tmp_path):
    d, o = graph
    cache = Cache(spark, str(tmp_path / "c"))
    prints = spark.createDataFrame([("a", "1"), ("b", "1")], "project string, digest string")
    refs = spark.createDataFrame([("a", "b")], "project string, refers_to string")
    s = Session(d, o, refresher=cached_refresher(cache, lambda: prints, lambda: refs, lambda x: x, lambda held: (d, o)))
    ask = lambda **k: s.run(request.Spec("refresh", **k))["refresh"]
    assert ask() == {"rebuild": False, "extracted_projects": 2, "reused_projects": 0}
    assert ask() == {"rebuild": False, "extracted_projects": 0, "reused_projects": 2}
    assert ask(rebuild=True) == {"rebuild": True, "extracted_projects": 2, "reused_projects": 0} and s.view.revision == 3


def test_names_of_files_and_endpoints(tmp_path):
    out = str(tmp_path / "x" / ".." / "graph.json")
    assert sidecar(out, "lock") == str(tmp_path / ".quarrygraph" / "output-graph.json.lock")
    assert sidecar(out, "manifest") == sidecar(str(tmp_path / "graph.json"), "manifest") and len(os.path.basename(sidecar(out, "manifest"))) == 78
    name = sessions.endpoint_name("qg-", "query", "11111111-0000-0000-0000-000000000000", str(tmp_path))
    assert sessions.is_endpoint("qg-", name) and not sessions.is_endpoint("qg-", name[:-1]) and not sessions.is_endpoint("qg-", None)
    with pytest.raises(ValueError):
        sessions.endpoint_name("qg-", "query", "00000000-0000-0000-0000-000000000000", str(tmp_path))


def test_nodes_that_disagree_are_an_error(spark, graph):
    d, _ = graph
    assert merge.checked_nodes(d).count() == d.select("id").distinct().count()
    with pytest.raises(Exception, match="disagree"):
        merge.checked_nodes(d.unionByName(d.withColumn("label", F.lit("other")))).collect()


def test_inventory_scope_before_and_without_full_discovery(spark):
    from quarrygraph.operators.filters import inventory_scope

    rows = spark.createDataFrame([("a/x.cs", False), ("a/y.txt", False), ("b/global.json", False), ("a", True), ("b", True), ("out/z.cs", False), ("a/obj/q.cs", False), ("a/obj", True)], "path string, is_directory boolean")
    known = spark.createDataFrame([("a/y.txt",)], "path string")
    scope = lambda **k: {r.path for r in inventory_scope(rows, known, ["a/**/*.cs"], ["a/obj/**"], ["out"], **k).collect()}
    assert scope() == {"a/x.cs", "a/y.txt", "a"}
    assert scope(bootstrap=True) == {"a/y.txt", "a"}
    assert scope(complete=False) == {"a/x.cs", "a/y.txt", "a", "b", "b/global.json", "a/obj", "a/obj/q.cs"}

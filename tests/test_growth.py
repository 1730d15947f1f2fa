"""What queries move between tasks: rows and bytes of all shuffles, where no table is small enough to be broadcast."""

from __future__ import annotations

from collections import Counter

import pytest

from quarrygraph.operators import derive, merge, verbs
from quarrygraph.plans import export, registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def unbroadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield spark
    spark.conf.set(key, before)


def shuffled(df) -> tuple[int, int]:
    """(rows, bytes) that the shuffles of a query wrote; what is used again counts once."""
    df.collect()
    out = [0, 0]

    def walk(p) -> None:
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(p.plan())
        if kind == "ShuffleExchangeExec":
            for i, name in enumerate(("shuffleRecordsWritten", "dataSize")):
                out[i] += p.metrics().get(name).get().value()
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out[0], out[1]


def count(spark, name: str) -> int:
    return registry.star.table(spark, DATA, name).count()


def test_operations_are_shuffled_once_and_not_for_each_role(unbroadcast):
    for name in ("evidence_ranges", "evidence_references", "evidence_properties", "evidence_loops"):
        rows, _ = shuffled(registry.QUERIES[name](unbroadcast, DATA))
        assert rows <= 6 * count(unbroadcast, "lineitem"), name  # over 111,000 before: 22 roles an operation, twice


def test_operations_by_row_and_by_members_give_the_same_edges(spark):
    declared = spark.createDataFrame([("c",), ("p",), ("p",), ("s",)], "id string")
    rest = "use string, is_declaration boolean, adds boolean, file string, line int, column int"
    rows = [
        ("property_reference", "c", [("p", ["member", "method"]), ("s", ["getter", "setter", "gone"]), ("gone", ["member"])], "read", False, False, "a.cs", 1, 1),
        ("event_assignment", "c", [("p", ["add"]), ("s", ["remove"])], "read", False, None, "a.cs", 2, 1),
        ("local_reference", "c", [("p", ["member"]), ("p", ["member"])], "read", False, False, "a.cs", 3, 1),
        ("local_reference", "c", [("p", ["member"])], "read", True, False, "a.cs", 4, 1),
        ("range", "c", [("p", ["method"])], "read", False, False, None, 5, 1),
        ("range", "gone", [("p", ["method"])], "read", False, False, "a.cs", 6, 1),
        ("unheard_of", "c", [("p", ["method"])], "read", False, False, "a.cs", 7, 1),
        (None, "c", [("p", ["method"]), (None, ["member"])], "read", False, False, "a.cs", 8, 1),
        ("invocation", None, [("p", ["method"])], "read", False, False, "a.cs", 9, 1),
    ]
    nested = spark.createDataFrame(rows, f"op_kind string, caller_id string, members array<struct<member_id string, roles array<string>>>, {rest}")
    flat = spark.createDataFrame([(k, c, role, m, *tail) for k, c, members, *tail in rows for m, roles in members for role in roles], f"op_kind string, caller_id string, role string, member_id string, {rest}")
    want = Counter({("c", "p", "references", 1): 1, ("c", "s", "calls", 1): 1, ("c", "p", "references", 3): 2})
    for ops in (nested, flat):
        assert Counter((r.source_id, r.target_id, r.relation, r.line) for r in derive.operation_edges(ops, declared).collect()) == want


def test_a_role_of_a_kind_has_one_rule():
    assert max(Counter((k, role) for k, v in derive.RULES.items() for _, role in v).values()) == 1


def observed(spark):
    """(declarations, observations) with edges at no place, at one and at several, seen often, named without a file, and with ends that are null."""
    rows = [
        ("a", "b", "calls", "extracted", 0.5, "x.cs", 2, 1), ("a", "b", "calls", "extracted", 0.9, "x.cs", 10, 1), ("a", "b", "calls", "extracted", 0.7, "x.cs", 2, 1), ("a", "b", "calls", "extracted", 1.0, None, None, None),
        ("a", "b", "calls", "inferred", 0.4, None, None, None), ("a", "b", "calls", "inferred", 0.6, None, 7, None), ("a", "b", "references", "extracted", 0.3, "x.cs", None, None), ("a", "b", "references", "extracted", 0.3, "x.cs", 1, None),
        ("a", None, "calls", "extracted", 0.5, "x.cs", 2, 1), (None, "b", "calls", "extracted", 0.5, "x.cs", 2, 1), ("gone", "b", "calls", "extracted", 0.5, "y.cs", 2, 1), ("b", "a", "dispatches_to", "extracted", 0.5, "w.cs", 2, 1),
    ]
    obs = spark.createDataFrame(rows, "source_id string, target_id string, relation string, evidence string, confidence double, file string, line int, column int")
    decl = spark.createDataFrame([("a", "A", "p"), ("b", "B", "p"), ("b", "B2", "q")], "id string, label string, project string")
    return decl, obs


def test_usages_from_observations_are_those_of_merged_edges(spark):
    decl, obs = observed(spark)
    want = verbs.usages(merge.merged_edges(obs), decl, obs.select("target_id").distinct())
    got = verbs.observed_usages(obs, decl)
    assert got.columns == want.columns
    rows = Counter(map(tuple, got.collect()))
    assert rows == Counter(map(tuple, want.collect())) and sum(rows.values()) == 7
    assert {(r.line, r.confidence) for r in got.where("evidence = 'extracted' and relation = 'calls' and origin_id = 'a'").collect()} == {(2, 1.0), (10, 1.0)}


def test_usages_are_shuffled_by_place_and_by_origin_only(unbroadcast):
    rows, _ = shuffled(registry.QUERIES["usages_all"](unbroadcast, DATA))
    assert rows <= 50_000  # 67,133 before, with the places gathered, looked up and taken apart


def test_first_places_are_those_of_merged_edges(spark):
    _, obs = observed(spark)
    rows = lambda df: Counter(map(tuple, df.drop("source_locations").collect()))
    assert rows(export.export_edges(merge.first_places(obs))) == rows(export.export_edges(merge.merged_edges(obs)))


def test_merged_edges_are_shuffled_once(unbroadcast):
    obs = registry.star.observations(unbroadcast, DATA).count()
    joined = count(unbroadcast, "lineitem") + count(unbroadcast, "orders")
    for name in ("edges_merged", "export_edges"):
        rows, _ = shuffled(registry.QUERIES[name](unbroadcast, DATA))
        assert rows <= obs + joined, name  # 32,074 before, twice each observation


def test_texts_of_arguments_are_made_behind_the_shuffle(unbroadcast):
    _, size = shuffled(registry.QUERIES["argument_items"](unbroadcast, DATA))
    assert size <= 800 * count(unbroadcast, "lineitem")  # 5,885,280 bytes before, with the texts in each row


def test_texts_order_arguments_of_one_span(spark):
    long = "x" * 600
    texts = [("a", 5, 1, "z"), ("a", 7, 1, long + "b"), ("a", 7, 1, long + "a"), ("a", 7, 1, long), ("a", 7, 2, "a"), ("a", None, None, "q"), ("a", None, None, None), ("b", 7, 1, long + "0"), (None, 7, 1, "c")]
    same = "'m' as caller_id, 'n' as callee_id, 'k' as project_key, 'p' as project, 'f.cs' as file, 1 as line, 1 as column, 't' as tree_path, 9 as invocation_start, 3 as invocation_length, formal_id, 0 as formal_ordinal, 'b' as formal_name, 'explicit' as argument_kind, false as is_implicit, expression_start, expression_length, 'int' as expression_type, null as converted_type, '1' as constant, 'number' as constant_kind, true as has_constant"
    rows = spark.createDataFrame(texts, "formal_id string, expression_start int, expression_length int, expression string")
    want = {("a", None, None): 0, ("a", "q", None): 1, ("a", "z", 5): 2, ("a", long, 7): 3, ("a", long + "a", 7): 4, ("a", long + "b", 7): 5, ("a", "a", 7): 6, (None, "c", 7): 0, ("b", long + "0", 7): 1}  # without an id a formal goes by its name
    shown = lambda e: None if e is None else e[:512] + "…" if len(e) > 512 else e
    held = verbs.argument_items(rows.selectExpr(*same.split(", "), "expression"), "s")
    made = verbs.argument_items(rows.selectExpr(*same.split(", "), "expression as t1"), "s", expression=registry.F.col("t1"))
    for df in (held, made):
        got = Counter((r.formal_parameter_id, r.expression_preview, r.expression_truncated, r.expression_span and r.expression_span.start, r.expansion_index) for r in df.collect())
        assert got == Counter((f, shown(e), e if e is None else len(e) > 512, at, i) for (f, e, at), i in want.items())


def test_summaries_count_edges_places_and_origins_by_group(spark):
    rows = [
        ("a", "t", "calls", "extracted", 0.5, "x.cs", 2, 1), ("a", "t", "calls", "extracted", 0.9, "x.cs", 2, 1), ("a", "t", "calls", "extracted", 0.9, "x.cs", 3, 1), ("a", "t", "calls", "extracted", 0.9, None, None, None), ("a", "t", "calls", "inferred", 0.9, None, None, None),
        ("a", "t", "references", "extracted", 0.5, "x.cs", None, None), ("a", "t", "dispatches_to", "extracted", 0.5, "x.cs", 2, 1), ("b", "t", "calls", "extracted", 0.5, "x.cs", 2, 1), ("b", "t", "calls", "extracted", 0.5, "x.cs", 4, 1),
        (None, "t", "calls", "extracted", 0.5, "x.cs", 2, 1), ("gone", "t", "calls", "extracted", 0.5, "y.cs", 2, 1), ("a", None, "calls", "extracted", 0.5, "x.cs", 2, 1),
    ]
    obs = spark.createDataFrame(rows, "source_id string, target_id string, relation string, evidence string, confidence double, file string, line int, column int")
    decl = spark.createDataFrame([("a", "A", "p", "n"), ("b", "B", "p", "n"), ("b", "B2", "p", "n"), ("b", "B3", "q", "n"), ("t", "T", "p", "n")], "id string, label string, project string, tfm string").withColumn("node_kind", registry.F.lit("method"))
    show = lambda r: (r.calls_edges, r.calls_occurrences, r.references_edges, r.references_occurrences, r.origins)
    got = {(r.project, r.is_external_root): show(r) for r in verbs.usage_summary(obs, decl, ("project",)).where("target_id = 't'").collect()}
    # b is declared twice in p: one origin there, its edge counts twice. An origin without an id is none.
    assert got == {("p", False): (4, 6, 1, 1, 2), ("q", False): (1, 2, 0, 0, 1), (None, True): (2, 2, 0, 0, 1)}
    assert [show(r) for r in verbs.usage_summary(obs, decl).where("target_id = 't'").collect()] == [(5, 6, 1, 1, 3)]
    assert [show(r) for r in verbs.usage_summary(obs, decl, ("project",)).where("target_id = 'a'").collect()] == [(0, 0, 0, 0, 0)]


def test_summaries_send_each_place_once_and_no_texts_of_it(unbroadcast):
    for name in ("usage_summary_by_namespace", "usage_summary_by_project_namespace"):
        rows, _ = shuffled(registry.QUERIES[name](unbroadcast, DATA))
        assert rows <= 50_000, name  # 55,043 before

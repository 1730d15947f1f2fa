"""Sources, session files, loops and the command line."""

from __future__ import annotations

import json
import threading

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarrygraph.functions import text
from quarrygraph.operators import merge
from quarrygraph.plans import cli, export, sessions
from quarrygraph.plans.request import QueryError, Spec
from quarrygraph.plans.session import Session
from quarrygraph.sources import discovery, facts
from quarrygraph.streaming import loop


def test_registry(tmp_path):
    r = sessions.Registry(str(tmp_path))
    r.add(sessions.Descriptor.own("abc-1", "/x"))
    r.add(sessions.Descriptor("ABD-2", 2**22 + 1, 0.0, "/x"))
    (tmp_path / "bad.json").write_text("{")
    states = {x["file"]: x["state"] for x in sessions.listing(r)}
    assert states == {"abc-1.json": "live", "ABD-2.json": "stale", "bad.json": "malformed"}
    assert r.select("ABC").session_id == "abc-1"
    for prefix, code in (("ab", "ambiguous_session"), ("x", "session_not_found")):
        with pytest.raises(QueryError) as e:
            r.select(prefix)
        assert e.value.code == code
    r.remove("abc-1")
    assert len(r.read()) == 2
    sessions.diagnostics_report(str(tmp_path / "report"), {"a": 1})
    with pytest.raises(QueryError):
        sessions.diagnostics_report(str(tmp_path / "report"), {})


def test_loop_prefers_foreground():
    seen, l = [], loop.Loop(commands=2)
    l.submit(lambda: seen.append("b"), background=True)
    l.submit(lambda: seen.append("f"))
    l.submit(lambda: seen.append("g"))
    with pytest.raises(QueryError):
        l.submit(lambda: None)
    l.drain()
    assert seen == ["f", "g", "b"]


def test_admission_trust_and_recovery():
    a, hold, started = loop.Admission(1), threading.Event(), threading.Event()
    t = threading.Thread(target=lambda: a.run(lambda: (started.set(), hold.wait())))
    t.start()
    started.wait()
    with pytest.raises(QueryError, match="too many"):
        a.run(lambda: 1)
    hold.set()
    t.join()
    assert a.run(lambda: 1) == 1
    versions = iter([1, 2, 2, 2])
    assert loop.trusted(lambda: "x", lambda: next(versions)) == "x"
    n = iter(range(100))
    with pytest.raises(QueryError):
        loop.trusted(lambda: "x", lambda: next(n))
    tries = iter([False, False, True])
    assert loop.recover(lambda: next(tries), 5, sleep=lambda s: None) == {"attempts": 3, "successes": 1, "failures": 2}


def test_texts():
    assert text.byte_text(3 << 20) == "3.0 MiB" and text.byte_text(3 << 29) == "1.5 GiB"
    assert text.elapsed_text(61_500) == "01:01" and text.elapsed_text(3_661_000) == "01:01:01"


def test_resolve_input(tmp_path):
    with pytest.raises(QueryError):
        discovery.resolve_input(str(tmp_path))
    (tmp_path / "a.csproj").touch()
    assert discovery.resolve_input(str(tmp_path)).endswith("a.csproj")
    (tmp_path / "b.SLN").touch()
    assert discovery.resolve_input(str(tmp_path)).endswith("b.SLN")
    (tmp_path / "c.slnx").touch()
    with pytest.raises(QueryError):
        discovery.resolve_input(str(tmp_path))


def test_several_frameworks_are_an_error(spark):
    with pytest.raises(PySparkException):
        spark.range(1).select(facts.target_framework(F.lit(None).cast("string"), F.lit("a;b"), F.lit(""))).collect()


def test_inventory_scan_and_events(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.cs").write_text("x")
    (tmp_path / "b.txt").write_text("y")
    rows = discovery.scan_inventory(spark, str(tmp_path), "*.cs").collect()
    assert len(rows) == 1 and rows[0].length == 1 and len(rows[0].sha) == 64
    e = spark.createDataFrame([("Renamed", "b", "a", "file"), ("Overflow", None, None, None), ("Changed", "c", "zzz", "gone")], "change string, path string, old_path string, entry string")
    assert sorted((r.kind, r.path, r.old_path, r.is_directory) for r in discovery.native_events(e).collect()) == [("changed", "c", None, None), ("renamed", "b", "a", False)]
    m = spark.range(1).select(discovery.restore_metadata(F.lit(None).cast("string"), F.lit("obj/")).alias("r")).first().r
    assert (m.path, m.complete) == ("obj/project.assets.json", False)


def test_documents_round_trip_and_command_line(spark, tmp_path, capsys):
    decl = spark.createDataFrame([("a", "A.Run", "method", "ordinary", "N", "p", "t", [("f.cs", 1, 2)], False), ("b", "B", "type", "class", "N", "p", "t", [], False)], "id string, label string, node_kind string, raw_kind string, namespace string, project string, tfm string, locations array<struct<file:string,line:int,column:int>>, is_entry_point boolean")
    obs = spark.createDataFrame([("a", "b", "calls", "extracted", 1.0, "f.cs", 3, 4), ("a", "b", "references", "inferred", 0.5, None, None, None)], "source_id string, target_id string, relation string, evidence string, confidence double, file string, line int, column int")
    decl.write.parquet(str(tmp_path / "declarations"))
    obs.write.parquet(str(tmp_path / "observations"))
    run = lambda *a: (cli.main(list(a), spark), capsys.readouterr().out)
    code, out = run("query", "symbols", "run", "--facts", str(tmp_path), "--json")
    assert code == 0 and [i["id"] for i in json.loads(out)["items"]] == ["a"]
    code, out = run("query", "usages", "b", "--facts", str(tmp_path))
    assert code == 0 and out.count("origin_id=a") == 2
    assert run("query", "usages", "zz", "--facts", str(tmp_path))[0] == 2
    assert run("query", "symbols", "--facts", str(tmp_path / "none"))[0] == 5
    target = str(tmp_path / "doc.json")
    assert run("query", "export", "--facts", str(tmp_path), "--output", target)[0] == 0
    nodes, back = facts.read_document(spark, target)
    assert sorted(r.id for r in nodes.collect()) == ["a", "b"]
    same = lambda df: sorted(map(str, merge.with_location_text(merge.merged_edges(df)).collect()))
    assert same(back) == same(obs)
    flat = decl.select("id", "label", "node_kind", "raw_kind", "namespace", "project", "tfm", F.get("locations", F.lit(0))["file"].alias("file"), F.get("locations", F.lit(0))["line"].alias("line"), F.get("locations", F.lit(0))["column"].alias("column"), "is_entry_point")
    assert Session(flat, obs).run(Spec("export", output_path=target))["export"]["sha256"]
    assert export.validate(nodes, merge.merged_edges(back)) == []

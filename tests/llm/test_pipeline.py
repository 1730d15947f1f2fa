"""The pipeline's stages keep the columns of documents, and each one's decisions take effect."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrygraph.llm import queries

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == columns, name
        assert {f.name: f.dataType for f in out.schema} == {f.name: f.dataType for f in docs.schema}
        assert 0 < out.count() <= docs.count()


STAGE = dict(corpus_pipeline.STAGES)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __did string, __keys string, __th string, score string, pid string"
LINE = "this line stands in many documents and is long enough"


def fixture():
    r = random.Random(21)
    words = "amber birch cedar delta ember frost grove harbor island jungle kettle lantern meadow nectar orchard".split()
    text = lambda n: " ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(n))
    base = [text(1) for _ in range(120)]
    rows = [(i, text(60)) for i in range(20)]
    for i in range(20, 30):
        w = list(base)
        w[r.randrange(120)] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(i, f"{text(20)}\n  {LINE.upper() if i % 2 else LINE}\t\n{text(5)}") for i in range(30, 38)]
    rows += [(38, None), (39, ""), (40, " \n"), (41, rows[0][1]), (42, rows[0][1]), (42, rows[0][1]), (None, rows[3][1]), (None, "nobody " * 9), (43, text(30000)), (44, LINE)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, "a", "b", "c", "d", "e") for i, t in rows], DOCS)


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, name):
    empty = table(spark, fixture()).limit(0)
    out = STAGE[name](spark, empty, DATA)
    assert out.count() == 0 and (name == "packing" or out.columns == empty.columns)


def test_lines_by_brute_force(spark):
    rows = fixture()
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k].append(i)
    gone = {k: max(i for i in v if i is not None) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    kept = lambda i, t: t if t is None else "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i)
    out = STAGE["line_dedup"](spark, table(spark, rows), DATA)
    assert gone and pairs(out) == Counter((i, kept(i, t)) for i, t in rows)
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in out.collect())


def test_near_duplicates_by_brute_force(spark):
    rows = fixture()
    grams = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    near = [(i, j) for i in range(len(rows)) for j in range(i) if grams[i] and 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j])]
    for _ in rows:
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    best = {}
    for g, (i, t) in zip(label, rows, strict=True):
        if grams[rows.index((i, t))]:
            best[g] = min(best.get(g, (True, 0)), (i is None, i or 0))
    out = STAGE["near_duplicates"](spark, table(spark, rows), DATA)
    got = pairs(out)
    assert got.total() == len(set(label))
    assert Counter(i for i, _ in got.elements()) == Counter([None if n else i for n, i in best.values()] + [i for (i, _), g in zip(rows, grams, strict=True) if not g])


def test_decontamination_by_brute_force(spark, tmp_path):
    """Items copied whole are found and nothing else is: documents and items share no run of five words but by copies."""
    rows = fixture()
    r = random.Random(3)
    items = [(k, " ".join(f"{w}q{k}x{n}" for n, w in enumerate(r.choices(["see", "the", "old", "mill", "by"], k=12)))) for k in range(6)] + [(6, None), (7, ""), (8, "one")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(i, f"{t} {items[i % 5][1]} {t}" if t and i is not None and i % 4 == 0 else t) for i, t in rows]
    out = STAGE["decontamination"](spark, table(spark, docs), str(tmp_path))
    assert pairs(out) == Counter((i, t) for i, t in docs if not any(x and len(x) > 3 and x in (t or "") for _, x in items))


def test_quality_keeps_what_the_score_accepts(spark, tmp_path):
    """The stage's decisions by a plain loop over the fitted network, one document and one passage at a time."""
    import numpy as np

    from quarrygraph.llm import quality_mil

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    m = quality_mil.fit(docs, labels, ~quality_mil.held_out(F.col("doc_id"), 4, 2))
    want = set()
    for row in docs.collect():
        data = np.frombuffer((row.text or "").encode(), np.uint8)
        x, _ = quality_mil.features(data, np.array([0, len(data)]))
        h = [np.tanh(np.clip((v - m.mean) / m.std, -6, 6) @ m.w["W"] + m.w["b"]) for v in x]
        e = [float((np.tanh(v @ m.w["V"]) / (1 + np.exp(-(v @ m.w["U"])))) @ m.w["a"]) for v in h]
        share = np.exp(np.array(e) - max(e))
        z = sum(s * v for s, v in zip(share / share.sum(), h, strict=True))
        if 1 / (1 + np.exp(-(z @ m.w["u"] + m.w["c"][0]))) >= 0.7:
            want.add(row.doc_id)
    got = STAGE["quality"](spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)
    assert {r.doc_id for r in got.collect()} == want and 0 < len(want) < 200


def test_packing_of_all_rows(spark):
    from tokenizers import Tokenizer

    from quarrygraph.llm import packing

    rows = fixture()
    t = Tokenizer.from_file(packing.default_tokenizer())
    out = STAGE["packing"](spark, table(spark, rows), DATA).collect()
    ids = Counter()
    for r in out:
        ids[r.doc_id] += r.length
    want = Counter()
    for i, x in rows:
        want[i] += len(t.encode(x or "", add_special_tokens=False).ids) + 1
    assert ids == want


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA).collect()
    kept = {r.doc_id for r in out}
    full = {}
    for r in out:
        full[r.sequence_id] = full.get(r.sequence_id, 0) + r.length
    assert 100 < len(kept) < 200 and max(full.values()) <= 1024


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_oracle(spark, name):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rel = c.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(x) for x in cols]
    assert sorted(tuple(map(str, (r[x] for x in cols))) for r in df.collect()) == sorted(tuple(str(r[i]) for i in at) for r in rel.fetchall())

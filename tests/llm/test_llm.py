"""The training-data operators against brute force, on small fixtures with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrygraph.llm import block_naming, decontaminate, graph, line_dedup, minhash_join, packing, quality_mil, suffix_array, suffix_tree, tagpath, toxicity

WS = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string"
#: A table with extra columns, some named like results or inner columns.
WIDE = "doc_id long, text string, lang string, n_chars long, score string, kept boolean, z int, th string, keys string, piece string, __did string, __keys string, __th string, __html string, rid string"


def wide(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, "s", True, 1, "t", "k", "p", "d", "k", "t", "h", "r") for i, t in rows], WIDE)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def order(rows):
    return sorted(rows, key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    vocabulary = ["a", "bb", "ccc", "dé", "e", "𝔸f"]
    base = [r.choice(vocabulary) + str(r.randint(0, 9)) for _ in range(150)]
    line = "This  Line is REPEATED in many documents, Ünïcode too"
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 70))) + r.choice(["", "\n", " \n\n"])) for i in range(40)]
    for i in range(40, 70):
        b = list(base)
        for _ in range(r.randint(0, 4)):
            b[r.randrange(len(b))] = r.choice(vocabulary)
        docs.append((i, "\t".join(b[r.randint(0, 20) : r.randint(90, 150)]) + f"\n  {line if i % 2 else line.lower()} \n"))
    docs += [(70, None), (71, ""), (72, " \n\t "), (73, docs[50][1]), (74, docs[50][1]), (74, docs[50][1]), (None, docs[51][1]), (None, "no id " * 20), (75, " ".join(base * 40)), (76, "x" * 5000), (77, docs[5][1].replace(" ", "\n  "))]
    return docs


@pytest.mark.parametrize("sent", [line_dedup.BROADCAST_BYTES, 0])
def test_line_dedup(spark, corpus, monkeypatch, sent):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", sent)
    df = wide(spark, corpus)
    got = [tuple(x) for x in line_dedup.digest(line_dedup.dedup_lines(df)).collect()]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(WS))
    holders = defaultdict(list)
    for i, t in corpus:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(i)
    keeper = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items()}
    want = []
    for i, t in corpus:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 40 or len(holders[key(x)]) < 5 or keeper[key(x)] == i]
        want.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    assert order(got) == order(want) and sum(x[2] for x in want) > 20
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_index_is_reversible(spark, corpus):
    df = spark.createDataFrame([c for c in corpus if c[0] is not None and c[0] < 73], DOCS)
    a, b = df.where("doc_id % 3 <> 0"), df.where("doc_id % 3 = 0")
    both = line_dedup.LineIndex(min_docs=3).insert(a).insert(b)
    back, fresh = line_dedup.LineIndex(min_docs=3).insert(a).insert(b).delete(b), line_dedup.LineIndex(min_docs=3).insert(a)
    refs = lambda x: sorted(tuple(r) for r in x.refs.select("hi", "lo", "n", "keeper").collect())
    assert refs(back) == refs(fresh) != refs(both)
    decide = lambda x: sorted(tuple(r) for r in line_dedup.digest(x.dedup(a)).collect())
    assert decide(back) == decide(fresh)
    with pytest.raises(ValueError):
        line_dedup.LineIndex(reversible=False).insert(a).delete(b)


def test_line_index_is_dealt_anew_as_it_grows(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    lines = [f"line number {i} of this table, which is long enough to count" for i in range(60)]
    first = spark.createDataFrame([(i, "\n".join(lines[:10])) for i in range(3)], DOCS)
    more = spark.createDataFrame([(i, "\n".join(lines)) for i in range(10, 13)], DOCS)
    index = line_dedup.LineIndex(min_docs=2).insert(first)
    few = index.shards
    index = index.insert(more)
    assert few == 2 and index.shards == 15 and index.filters.count() > 8
    decide = lambda x: sorted(tuple(r) for r in line_dedup.digest(x.dedup(more)).collect())
    assert decide(index) == decide(line_dedup.LineIndex(min_docs=2).insert(first.unionByName(more)))


def test_cuckoo_filter():
    r = np.random.default_rng(1)
    keys = r.integers(-(2**62), 2**62, 5000)
    f = line_dedup.CuckooFilter(5000)
    assert f.insert(keys) and f.contains(keys).all()
    f = line_dedup.CuckooFilter.of(f.blob())
    assert f.contains(r.integers(-(2**62), 2**62, 20000)).mean() < 0.01
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01
    small = line_dedup.CuckooFilter(1)
    assert not small.insert(keys[:200])


def test_exact_dedup(spark, corpus):
    long = [(100, "ab" * 3000 + "x"), (101, "ab" * 3000 + "y"), (102, " ".join("ab" * 3000) + "x"), (103, "ab" * 512), (104, "ab" * 1024)]
    rows = corpus + long
    got = [tuple(x) for x in block_naming.exact_groups(wide(spark, rows)).collect()]
    groups = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, n, i))
    want = []
    for k, members in groups.items():
        best = min(members)
        want += [(m[4], best[4], len(members), m == best, sha(k)) for m in members]
    assert order(got) == order(want)
    assert block_naming.exact_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_exact_dedup_of_blocks_that_all_share(spark, monkeypatch):
    monkeypatch.setattr(block_naming, "KNOWN", 2)
    r = random.Random(4)
    rows = [(i, r.choice(["", "same " * 300, "x" * 1024 + r.choice(["", "y"]), f"own {i % 50}"])) for i in range(3000)]
    got = block_naming.exact_groups(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    size = Counter(t.replace(" ", "") for _, t in rows)
    assert {r.doc_id: (r.group_size, r.text_sha256) for r in got} == {i: (size[t.replace(" ", "")], sha(t.replace(" ", ""))) for i, t in rows}


def brute_windows(sequences, size):
    count = Counter(tuple(s[p : p + size]) for s in sequences for p in range(len(s) - size + 1))
    out = []
    for s in sequences:
        gone = np.zeros(len(s), bool)
        for p in range(len(s) - size + 1):
            if count[tuple(s[p : p + size])] > 1:
                gone[p : p + size] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("size", [9, 35])
def test_substring_dedup_over_words(spark, corpus, size):
    got = [tuple(x) for x in suffix_tree.remove_repeats(wide(spark, corpus), size).drop("kept_text").collect()]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in corpus]
    want = [(i, len(w), int(g.sum()), sha(" ".join(x for x, y in zip(w, g, strict=True) if not y))) for (i, _), w, g in zip(corpus, words, brute_windows(words, size), strict=True)]
    assert order(got) == order(want) and 0 < sum(x[2] for x in want) < sum(x[1] for x in want)


@pytest.mark.parametrize("size", [21, 200])
def test_substring_dedup_over_bytes(spark, corpus, size):
    got = [tuple(x) for x in suffix_array.remove_repeats(wide(spark, corpus), size).drop("kept").collect()]
    raw = [(t or "").encode() for _, t in corpus]
    want = []
    for (i, _), b, g in zip(corpus, raw, brute_windows(raw, size), strict=True):
        runs = int((g & ~np.append(False, g[:-1])).sum()) if len(g) else 0
        want.append((i, len(b), int(g.sum()), runs, sha(bytes(x for x, y in zip(b, g, strict=True) if not y))))
    assert order(got) == order(want)


def test_windows_of_large_groups(spark, corpus, monkeypatch):
    """The whole-window path, taken by minimisers with more contexts than fit a group."""
    from quarrygraph.llm import windows

    monkeypatch.setattr(windows.Kind, "group_bound", 2)
    got = [tuple(x) for x in suffix_tree.remove_repeats(spark.createDataFrame(corpus, DOCS), 9).drop("kept_text").collect()]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in corpus]
    want = [(i, len(w), int(g.sum()), sha(" ".join(x for x, y in zip(w, g, strict=True) if not y))) for (i, _), w, g in zip(corpus, words, brute_windows(words, 9), strict=True)]
    assert order(got) == order(want)


def thue_morse(n, a="a", b="b"):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_defeat_polynomials_modulo_a_power_of_two(spark, n):
    x, y = thue_morse(n), thue_morse(n, "b", "a")
    rest = [f"w{i}" for i in range(34)]
    docs = spark.createDataFrame([(1, " ".join([x, *rest])), (2, " ".join([y, *rest]))], DOCS)
    assert [r.n_removed for r in suffix_tree.remove_repeats(docs).collect()] == [0, 0]
    lone = spark.createDataFrame([(1, x), (2, y)], DOCS)
    assert [(r.n_links, r.class_id == r.doc_id) for r in minhash_join.jaccard_links(lone).collect()] == [(0, True)] * 2
    assert {r.kept_sha256 for r in suffix_array.remove_repeats(lone, n).collect()} == {sha(x), sha(y)}
    item = spark.createDataFrame([(5, y)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.leaks(lone, item).collect()] == [2]


def test_windows_of_texts_longer_than_a_segment(spark, monkeypatch):
    from quarrygraph.llm import windows

    r = random.Random(12)
    parts = ["".join(r.choice("abcdefgh ") for _ in range(3000)) for _ in range(4)]
    long = "".join(r.choice("abcdefgh ") for _ in range(windows.SEGMENT - 1500)) + parts[0] + "".join(r.choice("ijklmnop ") for _ in range(windows.SEGMENT)) + parts[1] + parts[2]
    rows = [(1, long), (2, "x " + parts[0] + " y"), (3, parts[2] + parts[3])]
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in suffix_array.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    raw = [x.encode() for _, x in rows]
    seen = Counter(hash(b[p : p + 200]) for b in raw for p in range(len(b) - 199))
    for (i, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if seen[hash(b[p : p + 200])] > 1:
                gone[p : p + 200] = True
        assert got[i] == (int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum())) and gone.sum() >= 3000
    words = [x.split() for _, x in rows]
    want = {i: (len(w), int(g.sum())) for (i, _), w, g in zip(rows, words, brute_windows(words, 35), strict=True)}
    assert {x.doc_id: (x.n_words, x.n_removed) for x in suffix_tree.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()} == want


def test_long_texts_are_cut_into_segments():
    from quarrygraph.llm.windows import SEGMENT, segments

    first = np.array([0, 10, 10, 10 + 3 * SEGMENT])
    doc, lo, hi = segments(first, 5)
    assert doc.tolist() == [0, 1, 2, 2, 2] and hi[-1] == first[-1] and lo[3] == lo[2] + SEGMENT and hi[2] == lo[3] + 4


def test_empty_tables(spark):
    empty, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (suffix_tree.remove_repeats(empty), suffix_array.remove_repeats(empty), packing.pack(empty), minhash_join.jaccard_links(empty), minhash_join.keep_one(empty), quality_mil.score(empty, labels), toxicity.score(empty, labels), decontaminate.leaks(empty, spark.createDataFrame([], "item_id long, text string")), tagpath.extract_pages(spark.createDataFrame([], "page_id long, url string, html string"))):
        assert df.count() == 0


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    rows = [(i, (t or "") if i != 75 else (t or "") * 3) for i, t in corpus]
    got = packing.pack(wide(spark, rows)).collect()
    t = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for i, text in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or min(1024, len(ids))
        edge = [0, *range(first, len(ids) + 1, 1024)]
        for k, (s, e) in enumerate(zip(edge, edge[1:], strict=False)):
            want[i, k, s, e - s, zlib.crc32(struct.pack(f"<{e - s}I", *ids[s:e]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024


def sequential_best_fit(lengths, capacity):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= length), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((fit if fit is not None else capacity) - length)
    return len(gaps)


@pytest.mark.parametrize(("capacity", "most", "n"), [(10, 10, 300), (64, 64, 400), (64, 20, 400), (64, 3, 150), (1024, 700, 400), (8, 8, 0), (8, 8, 1)])
def test_rounds_against_sequential_best_fit(spark, monkeypatch, capacity, most, n):
    r = random.Random(capacity + most)
    lengths = {i: r.randint(1, most) for i in range(n)}
    df = spark.createDataFrame([(i, x) for i, x in lengths.items()], "pid long, length long")
    whole = sorted(tuple(x) for x in packing.best_fit(df, capacity).collect())
    monkeypatch.setattr(packing, "TASK_ROWS", n // 2)
    dealt = sorted(tuple(x) for x in packing.best_fit(df, capacity).collect())
    assert whole == dealt and [x[0] for x in dealt] == sorted(lengths)
    bins = defaultdict(list)
    for pid, sid, at in dealt:
        bins[sid].append((at, lengths[pid]))
    for b in bins.values():
        end = 0
        for at, length in sorted(b):
            assert at == end
            end += length
        assert end <= capacity
    assert len(bins) <= 1.02 * sequential_best_fit(lengths.values(), capacity) + 1


def jaccard(corpus):
    sets = []
    for _, t in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return [[j for j in range(len(sets)) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(sets))]


def test_jaccard_join(spark, corpus):
    r = random.Random(9)
    base = [str(r.random()) for _ in range(300)]
    near = []
    for i in range(200, 225):
        b = list(base)
        for _ in range(r.randint(0, 3)):
            b[r.randrange(300)] = "changed"
        near.append((i, " ".join(b)))
    rows = corpus + near
    links = jaccard(rows)
    got = [(x.doc_id, x.n_links) for x in minhash_join.jaccard_links(wide(spark, rows)).collect()]
    assert order(got) == order([(i, len(p)) for (i, _), p in zip(rows, links, strict=True)])
    label = list(range(len(rows)))
    while True:
        low = [min([label[i], *(label[j] for j in p)]) for i, p in enumerate(links)]
        if low == label:
            break
        label = low
    kept = minhash_join.keep_one(wide(spark, rows))
    assert kept.columns == wide(spark, rows).columns and kept.count() == len(set(label))


def test_jaccard_over_block_borders(spark, monkeypatch):
    monkeypatch.setattr(minhash_join, "BLOCK", 4)
    r = random.Random(2)
    base = [str(r.random()) for _ in range(200)]
    rows = []
    for i in range(30):
        b = list(base)
        for _ in range(r.randint(0, 4)):
            b[r.randrange(200)] = f"c{i}"
        rows.append((i, " ".join(b)))
    got = sorted((x.doc_id, x.n_links) for x in minhash_join.jaccard_links(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(i, len(p)) for i, p in enumerate(jaccard(rows))]


def test_chained_groups_are_dealt_anew(spark, monkeypatch):
    """A chain of neighbours, each a little off the one before, is one group by bands; its ends have nothing in common."""
    monkeypatch.setattr(minhash_join, "BLOCK", 8)
    words = [f"w{i}" for i in range(600)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 120])) for i in range(100)] + [(200 + i, " ".join(words[:119] + [f"x{i}"])) for i in range(30)]
    got = sorted((x.doc_id, x.n_links) for x in minhash_join.jaccard_links(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(i, len(p)) for (i, _), p in zip(rows, jaccard(rows), strict=True)]


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark._jvm
    sc.listenerBus().waitUntilEmpty(30_000)
    none = jvm.java.util.ArrayList()
    stages = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_jaccard_shuffles_texts_of_candidates_only(spark, monkeypatch, tmp_path):
    """Texts that share no band with any other stay where they are, also where groups are dealt anew."""
    monkeypatch.setattr(minhash_join, "BLOCK", 8)
    r = random.Random(4)
    words = [f"w{i}" for i in range(600)]
    chain = [(i, " ".join(words[4 * i : 4 * i + 120])) for i in range(40)]
    alone = [(100 + i, " ".join(str(r.random()) for _ in range(4000))) for i in range(60)]
    spark.createDataFrame(chain + alone, DOCS).write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    before, broadcasts = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many candidates
    try:
        got = sorted((x.doc_id, x.n_links) for x in minhash_join.jaccard_links(df).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcasts)
    moved = shuffled(spark) - before
    assert got == [(i, len(p)) for (i, _), p in zip(chain, jaccard(chain), strict=True)] + [(i, 0) for i, _ in alone]
    assert moved < 0.2 * sum(len(t) for _, t in alone)


def test_bitmap_of_candidates(spark, monkeypatch):
    """Every key passes, also where the bitmap has many pages or is too small to tell most others apart."""
    r = np.random.default_rng(6)
    did, th = r.integers(-(2**63), 2**63 - 1, (2, 4000))
    keys = spark.createDataFrame(list(zip(did[:2000].tolist(), th[:2000].tolist(), strict=True)), "did long, th long")
    for bits, page, others in ((28, 8, 200), (10, 8, 2000)):
        monkeypatch.setattr(minhash_join, "BITMAP_BITS", bits)
        monkeypatch.setattr(minhash_join, "PAGE_BITS", page)
        ok = minhash_join.among(keys)(did, th)
        assert ok[:2000].all() and ok[2000:].sum() <= others
    assert not minhash_join.among(keys.limit(0))(did, th).any()


def test_bands_reach_recall():
    bands, rows = minhash_join.bands_for(0.8, 0.9999, 128)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128
    with pytest.raises(ValueError):
        minhash_join.bands_for(0.01, 0.9999, 4)


@pytest.mark.parametrize("bound", [1_000_000, 4])
def test_components(spark, monkeypatch, bound):
    monkeypatch.setattr(graph, "TASK_EDGES", bound)
    r = random.Random(4)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)] + [(200, 201), (300, 300)] + [(i, i + 1) for i in range(400, 440)]
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            m = min(label[u], label[v])
            changed |= label[u] != m or label[v] != m
            label[u] = label[v] = m
    assert dict(tuple(x) for x in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()) == label


SLOT_HEAVY = "Solve 12 + 7 = 19, 5 * 3 = 15"
TABLE = "12 7 19 5 3 15 8 4 11 2"
STORY = "a farmer drove six old cows along the narrow river path until the evening rain began to fall on them"


@pytest.mark.parametrize(
    ("item", "copy", "found"),
    [
        (SLOT_HEAVY, SLOT_HEAVY, True),
        (SLOT_HEAVY, "Solve 14 + 9 = 23, 6 * 2 = 12", True),
        (SLOT_HEAVY, "Pay 14 + 9 = 23, 6 * 2 = 12", False),
        (TABLE, TABLE, True),
        (TABLE, "3 9 1 4 6 8 2 5 7 10", False),
        ("we met Alice, Bob, Carol, Dave, Erin, Frank", "we met Alice, Bob, Carol, Dave, Erin, Frank", True),
        (STORY, STORY.replace("narrow", "muddy"), True),
        (STORY, " ".join(STORY.split()[:15]), True),
        (STORY, " ".join(STORY.split()[:5] + STORY.split()[9:]), True),
        (STORY, " ".join(STORY.split()[:8]), False),
        ("Alice buys 5. Alice eats 2.", "Bob buys 7. Bob eats 3.", True),
        ("Alice buys 5 apples at the market. Alice eats 2.", "so today Bob buys 7 apples at the market. Bob eats 3.", True),
        ("the town of Rome paid 950 coins for 3 large ships that year", "the town of New York paid 1,200 coins for 2.5 large ships that year", True),
        ("she bought 5 red pens and 7 blue pens for the whole class", "she bought 3 red pens and 3 blue pens for the whole class", True),
        ("she bought 5 red pens and 5 blue pens for the whole class", "she bought 3 red pens and 4 blue pens for the whole class", False),
    ],
)
def test_decontamination_of_whole_items(spark, item, copy, found):
    filler = "some quite different words that say nothing at all about it. " * 3
    docs = spark.createDataFrame([(1, f"{filler}\n{copy}. {filler}"), (2, filler)], DOCS)
    got = decontaminate.leaks(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 5)] * found


@pytest.mark.parametrize("few", [decontaminate.FILTER_HASHES, 0])
def test_decontamination(spark, monkeypatch, few):
    monkeypatch.setattr(decontaminate, "FILTER_HASHES", few)
    item = "Alice sold 48 clips in April, and then she sold half as many clips in May. How far did Alice walk, 12 km or more, before she came home again?"
    other = "A train leaves the station slowly while seven birds sit quietly on the long grey wire above it."
    filler = "some quite different words that say nothing at all about it " * 3
    docs = [
        (1, filler + item + filler),
        (2, filler + item.replace("Alice", "Bertha").replace("48", "950").replace("12 km", "3 miles") + filler),
        (3, filler + item.replace("Alice", "Carla", 1) + filler),  # one name for two: slots disagree
        (4, filler * 5),
        (5, None),
        (6, ""),
        (7, filler + other.lower()),
        (8, other + item),
        (8, other + item),
        (None, other),
        (9, " ".join(item.split()[:12])),
        (10, filler + "Hello there " + filler),
    ]
    bench = spark.createDataFrame([(10, item, "x"), (11, other, "y"), (12, "Hello there", "z"), (13, None, "n"), (14, "", "e"), (None, other, "q")], "item_id long, text string, doc_id string")
    got = sorted((r.doc_id or -1, r.item_id or -1, r.exact) for r in decontaminate.leaks(wide(spark, docs), bench).collect())
    want = [(1, 10, True), (2, 10, False), (7, 11, True), (8, 10, True), (8, 11, True), (10, 12, True), (-1, 11, True), (7, -1, True), (8, -1, True), (-1, -1, True)]
    assert got == sorted(want)
    kept = decontaminate.drop_leaking(wide(spark, docs), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 9] and kept.columns == wide(spark, docs).columns


def labelled(spark, make, n=400):
    r = random.Random(8)
    good = "the quick brown fox said that every word of this sentence is new and plain".split()
    rows, labels = [], []
    for i in range(n):
        y = i % 3 > 0
        rows.append((i, make(r, y, good)))
        labels.append((i, int(y), int(y)))
    return rows + [(n, None), (n + 1, ""), (n + 2, rows[0][1]), (None, rows[1][1])], spark.createDataFrame(labels + [(5, 0, 0), (5, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_quality(spark):
    def make(r, y, good):
        clean = " ".join(r.choice(good) for _ in range(80)) + ".\n"
        return clean * 2 if y else clean + " ".join(f"{r.choice(good).upper()}!!" for _ in range(150))

    rows, labels = labelled(spark, make)
    out = quality_mil.score(wide(spark, rows), labels).withColumn("held", quality_mil.held_out(F.col("doc_id"), 4, 2)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    held = [r for r in out if r.held and r.doc_id < 400]
    assert len(held) > 50 and np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held]) > 0.95
    assert {r.score for r in quality_mil.score(wide(spark, rows[:5]), labels.limit(0)).collect()} == {0.5}


def test_attention_gradient():
    r = np.random.default_rng(0)
    x, first, y = r.normal(size=(12, 4)), np.array([0, 3, 4, 9]), np.array([1.0, 0, 1, 0])
    m = quality_mil.Model(np.zeros(4), np.ones(4))
    loss = lambda: -np.mean(y * np.log(p := m.forward(x, first)[0]) + (1 - y) * np.log(1 - p))
    p, kept = m.forward(x, first)
    grads = m.backward(y, p, first, kept)
    for k, g in grads.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = m.w[k][at]
        m.w[k][at] = old + 1e-5
        up = loss()
        m.w[k][at] = old - 1e-5
        down = loss()
        m.w[k][at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6, k


def test_toxicity(spark):
    def make(r, y, good):
        words = [r.choice(good) for _ in range(60)]
        if y:
            words[r.randrange(60)] = r.choice(["blockhead", "numbskull", "blockhaed" if r.random() < 0.1 else "dunderhead"])
        return " ".join(words)

    rows, labels = labelled(spark, make)
    rows.append((1000, "you numbskul of a fox"))
    out = {r.doc_id: r for r in toxicity.score(wide(spark, rows), labels).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values())
    assert np.mean([out[i].predicted == (i % 3 > 0) for i in range(400)]) > 0.95
    assert out[1000].hits == ["numbskul"] and out[400].hits == [] and out[400].predicted == 0
    assert {r.score for r in toxicity.score(wide(spark, rows[:5]), labels.limit(0)).collect()} == {0.0}


def test_automaton_is_levenshtein():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    terms = [("idiot", False), ("scum", False), ("worthless", False), ("lowei", True)]
    a = toxicity.Automaton.of(terms)
    r = random.Random(1)
    words = ["idiot", "idio", "iidiot", "idoit", "scum", "scun", "worthles", "worthlesss", "loweischaft", "loweschaft", "xlowei", "plain"]
    for _ in range(500):
        w = list(r.choice(["idiot", "scum", "worthless", "loweiabc"]))
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice("abcdeilmorstuw")
        words.append("".join(w))
    for w in words:
        want = 9
        for t, stem in terms:
            k = int(len(t) >= toxicity.FUZZY_FROM)
            ends = range(len(w) + 1) if stem else [len(w)]
            d = min(distance(t, w[:e]) for e in ends)
            want = min(want, d if d <= k else 9)
        points = toxicity._lower(w)
        got = int(a.match(points, np.array([0]), np.array([len(points)]))[0])
        assert got == (want if want < 9 else -1), w


def test_rare_terms_of_a_large_lexicon(spark):
    r = random.Random(3)
    terms = ["".join(r.choice("bcdfgklmnprstvz") + r.choice("aeiou") for _ in range(5)) for _ in range(600)]
    rows, labels = [], []
    for i in range(6000):
        words = [r.choice(["fox", "tree", "river", "stone", "cloud", "house"]) for _ in range(12)]
        if i % 3 == 0 and i < 5400:
            words += terms[i // 3 % 600 : i // 3 % 600 + 4]
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(i % 3 == 0 and i < 5400)))
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {t for t, stem in toxicity._terms(docs, labels.selectExpr("doc_id", "toxic as y")) if not stem}
    assert len(got & set(terms)) > 590


@pytest.mark.parametrize("word", ["skum", "scvm", "scmu", "idoit", "stuuupid", "st*pid", "id!ot", "i-d-i-o-t", "m.o.r.o.n", "wrthles", "wortlhes"])
def test_misspelled_and_masked(word):
    m = toxicity.Model(toxicity.Automaton([(t, False) for t in ("scum", "idiot", "stupid", "moron", "worthless")], toxicity.loose, True))
    assert [w for w, _, _ in toxicity.hits(m, f"well, you {word}, go home. A well-known e.g. list/of words")] == [word]


def test_loose_automaton():
    def distance(a, b):
        d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
                if i and j and x == b[j - 1] and a[i - 1] == y:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a) - 1, len(b) - 1]

    terms = [("idiot", False), ("scum", False), ("worthless", False), ("worth", False), ("lowei", True)]
    a = toxicity.Automaton(terms, toxicity.loose, True)
    r = random.Random(2)
    for _ in range(800):
        w = list(r.choice(["idiot", "scum", "worthless", "worth", "loweiabc"]))
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(w) - 1)
            w[i : i + 2] = r.choice([[w[i + 1], w[i]], [w[i]], [*w[i : i + 2], "t"], ["s", w[i + 1]]])
            if len(w) < 2:
                w += "o"
        w = "".join(w)
        all_ = [distance(t, w[:e]) for t, stem in terms for e in (range(1, len(w) + 1) if stem else [len(w)]) if distance(t, w[:e]) <= toxicity.loose(t, stem)]
        assert int(a.match(toxicity._lower(w), np.array([0]), np.array([len(w)]))[0]) == min(all_, default=-1), w


def test_toxicity_by_brute_force(spark):
    """Scores by a plain loop: every word against every term by distance, context by its window, and the logistic model."""
    r = random.Random(17)
    bad, good = ["blockhead", "numbskull", "dunderhead", "oaf"], "quick brown fox said that every word sentence plain river stone cloud house tree".split()
    rows, labels = [], []
    for i in range(300):
        words = [r.choice(good) for _ in range(30)]
        if i % 3 == 0:
            w = r.choice(bad)
            if i % 4 == 0 and len(w) > 4:
                k = r.randrange(1, len(w) - 1)
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + "z" + w[k:], w[:k] + w[k + 1] + w[k] + w[k + 2 :]])
            words[r.randrange(30)] = f'"{w}"' if i % 5 == 0 else w
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(i % 3 == 0)))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = toxicity.fit(docs, marks, F.lit(True))
    terms = toxicity._terms(docs, marks.selectExpr("doc_id", "toxic as y"))

    def distance(a, b):
        d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
                if i and j and x == b[j - 1] and a[i - 1] == y:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a) - 1, len(b) - 1]

    known = {}

    def edits(word):
        if word not in known:
            all_ = [distance(t, e) for t, stem in terms for e in ([word[:k] for k in range(1, len(word) + 1)] if stem else [word]) if distance(t, e) <= toxicity.loose(t, stem)]
            known[word] = min(all_, default=-1)
        return known[word]

    out = {r.doc_id: r.score for r in toxicity.score(docs, marks, F.lit(True)).collect()}
    for i, text in rows:
        found = []
        for w in re.finditer(r"\w+", text):
            e = edits(w[0])
            if e < 0 or e and w[0] in m.innocent:
                continue
            before, after = text[max(0, w.start() - 60) : w.start()], text[w.end() : w.end() + 60]
            quoted = any(q in before[-24:] for q in toxicity.QUOTES) and any(q in after[:24] for q in toxicity.QUOTES)
            found.append((w[0], e, 1.0 - 0.6 * quoted - 0.4 * any(x in toxicity.REPORTING for x in before.split()[-4:])))
        x = np.array(toxicity.document_features(found, len(text))) if found else np.zeros(toxicity.N_FEATURES)
        assert abs(out[i] - 1 / (1 + np.exp(-(x @ m.weights[:-1] + m.weights[-1])))) < 1e-9, (i, text)


def test_decontamination_by_brute_force(spark):
    """Lower-case items and documents without slots: an item is found where enough of its words are in runs of five that the document has too, at one place."""
    r = random.Random(31)
    words = [a + b for a in ("ka", "lo", "mi", "tu") for b in ("ren", "sol", "vad", "pim", "gor", "het")]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randint(4, 30)))) for k in range(12)]
    docs = []
    for i in range(60):
        w = [r.choice(words) for _ in range(r.randint(0, 60))]
        if i % 2:
            copy = items[i % 12][1].split()
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(words)
            at = r.randint(0, len(w))
            w[at:at] = copy[r.randint(0, 2) :]
        docs.append((i, " ".join(w)))
    want = set()
    for i, text in docs:
        d = text.split()
        for k, item in items:
            x = item.split()
            n = min(5, len(x))
            places = defaultdict(set)
            for a in range(len(x) - n + 1):
                for b in range(len(d) - n + 1):
                    if x[a : a + n] == d[b : b + n]:
                        for p in (2 * ((b - a) // len(x)), 2 * ((b - a + len(x) // 2) // len(x)) + 1):
                            places[p] |= set(range(a, a + n))
            if max(map(len, places.values()), default=0) >= 0.6 * len(x):
                want.add((i, k))
    got = decontaminate.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(g.doc_id, g.item_id) for g in got} == want and 10 < len(want) < 60


def test_quotations_weigh_less():
    m = toxicity.Model(toxicity.Automaton.of([("blockhead", False)]))
    plain = toxicity.hits(m, "well you blockhead you")[0]
    quoted = toxicity.hits(m, 'he said "blockhead" to nobody')[0]
    assert plain[2] == 1.0 and quoted[2] < 0.5


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p><p>no";</script></head><body>
<nav><ul><li><a href=/a>Menu</a></li></ul></nav><div id="cookie-banner">We use cookies, a lot of them, and we say so at length here.</div>
<div class="layout"><div class="post-body">%s</div><aside>Side, bar.</aside>
<div class="comments"><p>A reader says something long, with commas, and stops.</p></div></div><footer>&copy; Me</footer></body></html>"""


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<h2>Head</h2><p>One &amp; two,\n three.</p><p>Four <b>five</b>, six. And a longer paragraph, with words.</p>", "Head\nOne & two, three.\nFour five, six. And a longer paragraph, with words."),
        ("<p>First paragraph, unclosed, with several words.<p>Second one.<form><input><p>Name</p></form><p>Third, as it is.", "First paragraph, unclosed, with several words.\nSecond one.\nThird, as it is."),
        ("<article><p>Text &lt;b&gt; &eacute;&#233; here, and so on.</p><!-- <p>no</p> --><ul><li>Item one, short.</li><li><a href=x>Link only</a></li></ul></article>", "Text <b> éé here, and so on.\nItem one, short."),
    ],
)
def test_extraction(body, want):
    assert tagpath.extract(PAGE % body) == want


LONG_TEXT = "A first long part, with commas, and with many words, that goes on, and on, until it ends here."


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<div id=c><div>{LONG_TEXT * 4}</div><div>{LONG_TEXT}</div></div>", f"{LONG_TEXT * 4}\n{LONG_TEXT}"),
        (f"<div><h1>Head</h1><p>Short one.</p><ul><li>{LONG_TEXT}</li><li>{LONG_TEXT}</li></ul><p>After.</p></div>", f"Head\nShort one.\n{LONG_TEXT}\n{LONG_TEXT}\nAfter."),
        (f"<div><h1>Head</h1><section><p>{LONG_TEXT}</p><p>{LONG_TEXT}</p></section><p>After.</p></div>", f"Head\n{LONG_TEXT}\n{LONG_TEXT}\nAfter."),
        (f"<article><p>{LONG_TEXT * 4}</p></article><article><p>{LONG_TEXT}</p></article>", f"{LONG_TEXT * 4}\n{LONG_TEXT}"),
    ],
)
def test_extraction_of_all_content(body, want):
    assert tagpath.extract(f"<html><body>{body}</body></html>") == want


@pytest.mark.parametrize("wrap", ["div class='content-sidebar-wrap'", "div class='page has-sidebar'", "div class=no-comments", "section id=main-with-header", "form id=aspnetForm"])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_extraction_within_wrappers(wrap, inner):
    page = f"<html><body><{wrap}><{inner}><p>{LONG_TEXT}</p></{inner}><div class=sidebar>Side, bar.</div></{wrap.split()[0]}></body></html>"
    assert tagpath.extract(page) == LONG_TEXT


def test_extraction_of_link_lists():
    refs = "<ul><li><a href=a>First source</a></li><li><a href=b>Second</a></li></ul>"
    table = "<table><tr><td><a href=c>Name</a></td><td>Value</td></tr></table>"
    comments = f"<div id=comments><article class=comment><p>{LONG_TEXT}</p></article></div>"
    want = f"{LONG_TEXT}\nFirst source\nSecond\nName\nValue"
    assert tagpath.extract(f"<body>{refs}<article><p>{LONG_TEXT}</p>{refs}{table}</article>{comments}</body>") == want
    assert tagpath.extract(f"<body><div>{refs}</div><div><p>{LONG_TEXT}</p>{refs}{table}</div><div>{refs}</div></body>") == want


def test_path_ratios_by_brute_force():
    """Scores of paths against the formula over a second parser's paths."""
    from html.parser import HTMLParser

    class Paths(HTMLParser):
        def __init__(self):
            super().__init__()
            self.at, self.found = [], {}

        def handle_starttag(self, tag, attrs):
            self.at.append(tag)

        def handle_endtag(self, tag):
            self.at.pop()

        def handle_data(self, data):
            if data.strip():
                p = self.found.setdefault("/" + "/".join(self.at), [0, 0, 0])
                p[0], p[1], p[2] = p[0] + 1, p[1] + len(data), p[2] + sum(data.count(c) for c in ".,;:!?")

    r = random.Random(7)
    for _ in range(30):
        parts = [f"<div><{t}>{LONG_TEXT[: r.randint(5, 90)] * r.randint(1, 3)}</{t}></div>" for t in r.choices(["p", "h2", "section", "pre", "td"], k=r.randint(1, 9))]
        page = f"<html><body>{''.join(parts)}</body></html>"
        q = Paths()
        q.feed(page)
        rows = list(q.found.values())
        mean = lambda v, i: 0.25 * v[max(i - 1, 0)] + 0.5 * v[i] + 0.25 * v[min(i + 1, len(v) - 1)]
        length, punct = [np.log(1 + x[1] / x[0]) for x in rows], [np.log(1 + x[2] / x[0]) for x in rows]
        want = {k: mean(length, i) * (0.5 + mean(punct, i)) * (q.found[k][1] / sum(x[1] for x in rows)) ** 0.5 for i, k in enumerate(q.found)}
        got = tagpath.path_scores([t for t in tagpath.parse(page) if not t.text.isspace()])
        assert list(got) == list(want) and np.allclose(list(got.values()), list(want.values()))


def test_path_ratios_decide():
    page = f"<body><div class=top><p>Short line</p></div><div><p>{LONG_TEXT}</p><h2>Head</h2><p>{LONG_TEXT}</p></div><div class=end><span>One more</span></div></body>"
    assert tagpath.extract(page) == f"{LONG_TEXT}\nHead\n{LONG_TEXT}"
    assert tagpath.extract(page, alpha=0) == f"Short line\n{LONG_TEXT}\nHead\n{LONG_TEXT}\nOne more"
    assert tagpath.extract(f"<p>one<br>two <br/> three</p>") == "one two three"
    assert tagpath.extract("<div>" * 2500 + f"<nav>Menu, menu.</nav><p>{LONG_TEXT}</p>") == LONG_TEXT
    assert tagpath.extract(f"<div class='post has-tags'><p>{LONG_TEXT}</p></div>") == LONG_TEXT


def test_extraction_of_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "plain text only"), (4, "u", "<p>a<"), (5, "u", "<div>" * 3000 + "deep, text."), (6, "u", "<script>x"), (6, "u", "<script>x")]
    got = sorted((r.page_id, r.text, r.n_chars) for r in tagpath.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect())
    assert [(i, t) for i, t, _ in got] == [(1, ""), (2, ""), (3, "plain text only"), (4, "a<"), (5, "deep, text."), (6, ""), (6, "")] and all(n == len(t) for _, t, n in got)


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(packing.default_tokenizer()), packing.Encoder(packing.default_tokenizer())
    assert e.quick is not None
    r = random.Random(6)
    alphabet = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(161, 0x530)]]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 200))) for _ in range(300)]
    texts += [" ".join("".join(r.choice("thenaiosr'é ") for _ in range(r.randint(1, 9))) for _ in range(100)) for _ in range(100)]
    texts += ["", " ", "a  b\n\n c \t", "<|endoftext|> x", "日本語 text", "a b\u0085c d", "x" * 6000, "it's I'LL we'll 123abc ½ ²", "\x00\x1f\x1c"]
    assert [x.tolist() for x in e.ids(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]

"""N-gram Jaccard self-join by MinHash banding.

A document's set is its distinct runs of ``n`` words. Documents with one and the same set form a class of copies; only
classes are compared. Band and row counts follow from the recall wanted at the threshold. Band hashes are shuffled;
a bucket ties its classes to its smallest one, and components of these ties are the groups of candidates. As chance ties
chain, a group larger than a block is dealt anew by longer bands, again chosen for the target recall. Every pair inside a
group is verified on the full sets: groups are cut into blocks, each task takes a pair of blocks and returns counts and local
components, never pairs. Both steps need texts; only those of candidates are shuffled, told by a bitmap before the join.

Result, one row a document: its class id (the smallest doc_id of the verified component), its number of links (documents
whose sets have at least the threshold's similarity with its own, copies included), and the id of its class of copies.

Defined results: words are runs of ``[^\\x20\\x09-\\x0D]``; a text of fewer than n words is one n-gram of all its words; a text without
words (null, empty) has no links and is its own class; rows that repeat link with each other; a null doc_id is
a document like any other, and a class of such rows only has a null class id; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.llm.common import chained, column, doc_chunks, ids, materialize, mix, release, texts, tune, unused, utf8, whole_groups, word_hashes, word_spans
from quarrygraph.llm.graph import components
from quarrygraph.llm.windows import packed, text_hashes, unpacked

NGRAM, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 128
#: Hashes for the longer bands of large groups.
FINE_HASHES = 512
#: Classes of a candidate group that one task compares with one another.
BLOCK = 512
#: Bits of the bitmap of candidates at most (32 MB), and of a page of it, which one task makes.
BITMAP_BITS, PAGE_BITS = 28, 18


def bands_for(threshold: float, recall: float, most: int) -> tuple[int, int]:
    """(bands, rows) with the most rows, and so the fewest candidates, that reach ``recall`` at ``threshold`` with at most ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("too few hashes for this recall")
    return best


def ngram_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's distinct n-grams, sorted within the document, and each document's first."""
    ws, we, first = word_spans(data, off)
    h = word_hashes(data, ws, we)
    words = np.diff(first)
    grams = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    doc = np.repeat(np.arange(len(words)), grams)
    start = np.repeat(first[:-1], grams) + np.arange(len(doc)) - np.repeat(np.cumsum(grams) - grams, grams)
    if not len(doc):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    g = chained(h, start, np.minimum(words, n)[doc], n)
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.append(True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1]))
    g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(len(off)))


def banding(bands: int, rows: int, seed: int):
    """A function from sets (their hashes, each set's first, no set empty) to a row of ``bands`` band hashes for each."""
    r = np.random.default_rng(seed)
    mul = (r.integers(1, 2**31, bands * rows, np.uint32) << np.uint32(1)) | np.uint32(1)
    add = r.integers(0, 2**32, bands * rows, np.uint32)

    def of(g: np.ndarray, first: np.ndarray) -> np.ndarray:
        low = (g >> np.uint64(32)).astype(np.uint32)
        band = np.zeros((len(first), bands), np.uint64)
        for k in range(rows if len(first) else 0):
            sig = np.stack([np.minimum.reduceat(low * mul[b * rows + k] + add[b * rows + k], first) for b in range(bands)], 1)
            band = mix(band + sig.astype(np.uint64) + np.uint64(k + 1))
        return mix(band + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    return of


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, did, th, hi, lo, grams, bands binary): identity of each row's set and its band hashes."""
    hashes = banding(bands, rows, 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            did, th = ids(column(b, "doc_id")), text_hashes(b)
            data, off = utf8(column(b, "text"))
            for i, j in doc_chunks(off, 1 << 20):
                g, first = ngram_sets(data, off[i : j + 1], n)
                size = np.diff(first)
                key = np.zeros((j - i, 2), np.uint64)
                for k in range(j - i):
                    raw = g[first[k] : first[k + 1]].tobytes() if size[k] else b"%d %d" % (did[i + k], th[i + k])
                    d = xxhash.xxh3_128_intdigest(raw)
                    key[k] = d >> 64, d & (2**64 - 1)
                full = np.flatnonzero(size)
                out: list[bytes | None] = [None] * (j - i)
                for k, v in zip(full.tolist(), hashes(g, first[full]), strict=True):
                    out[k] = v.tobytes()
                s = slice(i, j)
                yield pa.record_batch([column(b, "doc_id").slice(i, j - i), pa.array(did[s]), pa.array(th[s]), pa.array(key[:, 0].view(np.int64)), pa.array(np.ascontiguousarray(key[:, 1]).view(np.int64)), pa.array(size), pa.array(out, pa.binary())], names=["doc_id", "did", "th", "hi", "lo", "grams", "bands"])

    return docs.mapInArrow(run, "doc_id long, did long, th long, hi long, lo long, grams long, bands binary")


def _places(did: np.ndarray, th: np.ndarray, bits: int) -> np.ndarray:
    return mix(th.view(np.uint64) + mix(did.view(np.uint64))) >> np.uint64(64 - bits)


def among(keys: DataFrame) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A test of rows (did, th) by a bitmap of ``keys`` that tasks are sent: all of ``keys`` pass, and a few others, which the join with them drops."""
    bits = min(BITMAP_BITS, max(PAGE_BITS, (16 * keys.count()).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _places(b.column(0).to_numpy(), b.column(1).to_numpy(), bits)
            yield pa.record_batch([pa.array((at >> np.uint64(PAGE_BITS)).astype(np.int32)), pa.array((at & np.uint64((1 << PAGE_BITS) - 1)).astype(np.int32))], names=["page", "place"])

    def page(x: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(1 << PAGE_BITS, bool)
        on[x["place"].to_numpy()] = True
        return pd.DataFrame({"page": x["page"].iloc[:1], "bits": [np.packbits(on, bitorder="little").tobytes()]})

    found = np.zeros((1 << bits - PAGE_BITS, 1 << PAGE_BITS - 3), np.uint8)
    for r in keys.select("did", "th").mapInArrow(places, "page int, place int").groupBy("page").applyInPandas(page, "page int, bits binary").collect():
        found[r["page"]] = np.frombuffer(r["bits"], np.uint8)
    held = keys.sparkSession.sparkContext.broadcast(found.ravel())

    def passing(did: np.ndarray, th: np.ndarray) -> np.ndarray:
        at = _places(did, th, bits)
        return held.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1

    return passing


def tied(band: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cid, root): components of classes that share a band, classes that share none are left out; and (root, m, most): each one's size and
    that of its largest bucket."""
    buckets = materialize(band.groupBy("band").agg(F.count("*").alias("m"), F.min("cid").alias("hub")).where("m > 1"))
    found = materialize(components(band.join(buckets.select("band", "hub"), "band").selectExpr("cid as u", "hub as v")).withColumnRenamed("id", "cid"))
    most = found.join(buckets.groupBy(F.col("hub").alias("cid")).agg(F.max("m").alias("most")), "cid", "left")
    sizes = materialize(most.groupBy("root").agg(F.count("*").alias("m"), F.max("most").alias("most")).where("m > 1"))
    release(band.sparkSession, buckets)
    return found, sizes


def dealt_anew(docs: DataFrame, classes: DataFrame, candidates: DataFrame, sizes: DataFrame, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """``candidates`` with their sizes, after groups larger than a block that only chains of buckets hold together are split by longer bands, which less similar sets hardly share.

    A group most of which is in one bucket stays: near copies of one text share longer bands too."""
    large = materialize(sizes.where(f"m > {BLOCK} and 2 * most < m").select("root"))
    if large.isEmpty():
        return candidates, sizes
    bands, rows = bands_for(threshold, recall, FINE_HASHES)
    hashes = banding(bands, rows, 21)

    def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, raw in unpacked(batches):
            g, _ = ngram_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), n)
            band = mix(hashes(g, np.zeros(1, np.int64))[0] + np.uint64(row["root"]))
            yield pa.record_batch([pa.array(band.view(np.int64)), pa.array(np.full(len(band), row["cid"], np.int64))], names=["band", "cid"])

    members = materialize(candidates.join(large, "root").join(classes.select("cid", "did", "th"), "cid"))
    band = packed(docs, among(members)).select("did", "th", "z").join(members, ["did", "th"]).select("root", "cid", "z").mapInArrow(fine, "band long, cid long")
    # A repeated row has its class's bands twice.
    band = materialize(band.distinct())
    split, parts = tied(band)
    found = materialize(candidates.join(large, "root", "left_anti").select("cid", "root").unionByName(split.select("cid", "root")))
    left = materialize(sizes.join(large, "root", "left_anti").unionByName(parts))
    release(docs.sparkSession, large, members, band, split, parts, candidates, sizes)
    return found, left


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = utf8(b.column(1))
        n = np.diff(off) // 8
        yield pa.record_batch([pa.array(np.frombuffer(data[off[0] : off[-1]].tobytes(), np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), n))], names=["band", "cid"])


def linked(sets: list[np.ndarray], side: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold; ``side`` 0 and 1: only pairs across (all 0: all pairs)."""
    m, size = len(sets), np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(m), size.astype(int))
    _, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[col] > 1
    owner, col = owner[shared], np.unique(col[shared], return_inverse=True)[1]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    common = np.zeros((m, m), np.float32)
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        s, e = np.searchsorted(col, (c, c + 4096))
        x = np.zeros((m, 4096), np.float32)
        x[owner[s:e], col[s:e] - c] = 1
        common += x @ x.T
    common = common.astype(np.float64)  # counts are whole and exact so far
    adj = common >= threshold * (size[:, None] + size - common) - 1e-9
    np.fill_diagonal(adj, False)
    if side.any():
        adj &= side[:, None] != side
    return adj


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["root", "p", "q"], 2048):
            # A repeated row brings its class's set twice.
            same = np.ones(t.num_rows - 1, bool)
            for x in ("root", "p", "q", "cid"):
                same &= t[x].to_numpy()[1:] == t[x].to_numpy()[:-1]
            t = t.filter(pa.array(np.append(True, ~same)))
            root, cid, w, p, q, b = (t[x].to_numpy() for x in ("root", "cid", "w", "p", "q", "b"))
            raw = t["grams"].to_pylist()
            edge = np.flatnonzero(np.append(True, (root[1:] != root[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])))
            links, local = np.zeros(len(cid), np.int64), cid.copy()
            for s, e in zip(edge, np.append(edge[1:], len(cid)), strict=True):
                if e - s < 2:
                    continue
                adj = linked([np.frombuffer(x, np.uint64) for x in raw[s:e]], (b[s:e] != p[s]).astype(int), threshold)
                links[s:e] = adj @ w[s:e]
                label = cid[s:e].copy()
                while True:
                    low = np.minimum(label, np.where(adj, label, np.iinfo(np.int64).max).min(1))
                    if (low == label).all():
                        break
                    label = low
                local[s:e] = label
            yield pa.record_batch([pa.array(cid), pa.array(links), pa.array(local)], names=["cid", "links", "local"])

    return run


def jaccard_links(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per row: doc_id, class_id, n_links, copies_id, n_copies, n_grams, did, th (the last two name the row's content)."""
    spark = docs.sparkSession
    tune(spark)
    docs = texts(docs)
    bands, rows = bands_for(threshold, recall, MOST_HASHES)
    sig = materialize(signatures(docs, n, bands, rows))
    classes = sig.groupBy("hi", "lo").agg(F.count("*").alias("w"), F.min(F.struct("did", "th")).alias("rep"), F.min("doc_id").alias("copies_id"), F.min("bands").alias("bands"))
    classes = materialize(classes.select("hi", "lo", "w", "rep.did", "rep.th", "copies_id", "bands").withColumn("cid", F.monotonically_increasing_id()))
    release(spark)
    band = classes.where("bands is not null").select("cid", "bands").mapInArrow(_exploded, "band long, cid long")
    candidates, sizes = dealt_anew(docs, classes, *tied(band), n, threshold, recall)
    # Members carry their whole sets to each pair of blocks they are in.
    members = materialize(candidates.join(sizes.select("root", "m"), "root").join(classes.select("cid", "w", "did", "th"), "cid"))
    sets = materialize(packed(docs, among(members)).select("did", "th", "z").join(members, ["did", "th"]).mapInArrow(_sets(n), "root long, cid long, w long, m long, grams binary"))
    release(spark, members)
    k = F.expr(f"int(ceil(m / {BLOCK}))")
    dealt = sets.withColumn("k", k).withColumn("b", F.pmod(F.xxhash64("cid"), F.col("k")).cast("int")).withColumn("o", F.explode(F.expr("sequence(0, k - 1)")))
    dealt = dealt.selectExpr("root", "least(b, o) as p", "greatest(b, o) as q", "b", "cid", "w", "grams")
    checked = materialize(dealt.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q", "cid").mapInArrow(_verified(threshold), "cid long, links long, local long"))
    release(spark, sets, sizes, candidates)
    links = checked.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = materialize(components(checked.selectExpr("cid as u", "local as v")).withColumnRenamed("id", "cid"))
    own = classes.select("cid", "hi", "lo", "w", "copies_id", "bands").join(joined, "cid", "left").join(links, "cid", "left").selectExpr("cid", "hi", "lo", "w", "copies_id", "coalesce(root, cid) as root", "coalesce(links, 0) as links")
    own = materialize(own)
    least = materialize(own.groupBy("root").agg(F.min("copies_id").alias("class_id")))
    full = materialize(own.join(least, "root").select("hi", "lo", "w", "links", "copies_id", "class_id", "root"))
    release(spark, checked, joined, own, least, classes)
    row = sig.drop("bands").join(full, ["hi", "lo"])
    return row.selectExpr("doc_id", "class_id", "if(grams = 0, 0, w - 1 + links) as n_links", "copies_id", "w as n_copies", "grams as n_grams", "did", "th", "root")


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for row, raw in unpacked(batches):
            g, _ = ngram_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), n)
            out.append((row["root"], row["cid"], row["w"], row["m"], g.tobytes()))
            size += 8 * len(g)
            if size > 1 << 22:
                yield _set_batch(out)
                out, size = [], 0
        if out:
            yield _set_batch(out)

    return run


def _set_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary()]
    return pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["root", "cid", "w", "m", "grams"])


def keep_one(docs: DataFrame, **params: float) -> DataFrame:
    """``docs`` with one row of each class: the one of smallest doc_id (null last), then of least text hash."""
    links = jaccard_links(docs, **params)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "did", "th")
    keep = materialize(links.groupBy("root").agg(F.min(order).alias("o")).select("o.did", "o.th"))
    keys, keyed = identified(docs)
    kept = keyed.join(keep.toDF(*keys), keys)
    again = links.groupBy("did", "th").count().where("count > 1").limit(1).count()
    return (kept.dropDuplicates(keys) if again else kept).select(*docs.columns)


def identified(docs: DataFrame) -> tuple[list[str], DataFrame]:
    """``docs`` with the two columns that name a row's content, and their names, which clash with no other."""
    names = [unused(docs, "__did"), unused(docs, "__th")]
    of = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array(ids(column(b, "doc_id"))), pa.array(text_hashes(b))], names=[*of, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return names, docs.mapInArrow(run, f"{schema}, `{names[0]}` long, `{names[1]}` long")

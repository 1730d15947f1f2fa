"""Repeated fixed-length windows over symbol sequences, for the two substring operators.

A window is ``length`` consecutive symbols of one document. Moving all windows over the network is out of the question at
scale, so suffixes are narrowed down without loss before an operator's index sorts them:

1. of rows with one and the same text, one stands for all; a text that occurs twice is repeated throughout;
2. windows are grouped by their minimiser, the window's ``k``-gram of least hash: equal windows have equal minimisers at equal
   places. Consecutive windows with the same minimiser make a run, and one row stands for a run. A minimiser seen once
   (map-side combined counts) has no repeated window, and one that is always in the same run has no other;
3. runs of one whole content are one entry with a multiplicity, whose contents are the real symbols and go to the index;
4. the index works in groups that fit memory. Suffixes start at most ``length - k`` symbols before their minimiser; a group of
   too many bytes is split by a longer common part: suffixes of the upper half of these distances share more symbols before
   the minimiser, those of the lower half more symbols behind it. Halves are split again until they fit, or hold one distance and
   so one window, which then is repeated.

The hash of a minimiser only groups; contents are named by 128 bits of their bytes and compared by their bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.llm.common import column, doc_chunks, ids, materialize, mix, release, spans, texts, tune, utf8, whole_groups

#: Bits of a position in a sort key; a segment has fewer symbols.
POS = 20
SEGMENT = 1 << 19
#: Suffixes that an index sorts at once.
AT_ONCE = 100_000
#: Bits of a run's number of windows, and of its minimiser's distance, in ``at``; its first window stands above them.
SMALL = 12
MOST = (1 << SMALL) - 1
KNOWN = 3
_RUN = {"rid": pa.int64(), "w": pa.int32(), "g": pa.int64(), "c1": pa.int64(), "c2": pa.int64(), "at": pa.int64()}
_CONTEXT = {"k1": pa.int64(), "k2": pa.int64(), "lo": pa.int32(), "hi": pa.int32(), "rid": pa.int64(), "p": pa.int64(), "n": pa.int32(), "a": pa.int32(), "m": pa.int64(), "size": pa.int32(), "ctx": pa.binary()}
_SPANS = {"rid": pa.int64(), "s": pa.int64(), "e": pa.int64()}


def schema(columns: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{name} {'long' if kind == pa.int64() else 'int' if kind == pa.int32() else kind}" for name, kind in columns.items())


def batch(rows: list[tuple], columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), columns.values(), strict=True)], names=list(columns))


@dataclass(frozen=True)
class Kind:
    """What an operator's symbols are, and its index."""

    length: int
    k: int
    #: The bytes of a text that count.
    normal: Callable[[bytes], bytes]
    #: (data, off) -> symbols, each document's first symbol, and where symbols start and end in data (None: they are the bytes)
    symbols: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]]
    #: Symbols as uint64 values for hashes.
    values: Callable[[np.ndarray], np.ndarray]
    #: The symbols of normal bytes as a sequence to slice, and the bytes of such a slice.
    split: Callable[[bytes], list | bytes]
    join: Callable[[list | bytes], bytes]
    #: Contexts -> an array of the symbols of all, with each context's first.
    numbers: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    #: (symbols, first symbol, group, length) -> which suffixes share ``length`` symbols with another one of their group
    settle: Callable[..., np.ndarray]
    #: Bytes of contexts that one group may hold.
    group_bytes: int = 1 << 19

    def __post_init__(self):
        if self.distances >= 1 << SMALL:
            raise ValueError("the window is too long")

    @property
    def group_bound(self) -> int:
        return self.group_bytes

    @property
    def distances(self) -> int:
        return self.length - self.k + 1


class Rolling:
    """Polynomials modulo 2**64 of any span from two prefix values: quick, and good enough to choose and group minimisers, not to tell contents apart."""

    def __init__(self, base: int):
        self.base, self.back = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def grams(self, sym: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all runs of k symbols."""
        n = len(sym) + 1
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.back)):
                x = np.full(max(n, 2 * len(self.up)), b, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        p = np.zeros(n, np.uint64)
        np.cumsum(sym * self.up[: n - 1], out=p[1:])
        return mix((p[k:] - p[: n - k]) * self.down[: n - k])


ROLL = Rolling(0x9E3779B97F4A7C15)


def slide_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    pad = -len(x) % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(y, 1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def runs(sym: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Of segments [lo, hi) of ``sym``: segment, first window, windows, minimiser's distance from the first window, minimiser's hash, for each run."""
    count = np.maximum(hi - lo - length + 1, 0)
    if not count.sum():
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    gram = ROLL.grams(sym, k)
    low = np.uint64((1 << POS) - 1)
    best = slide_min((gram & ~low) | np.arange(len(gram), dtype=np.uint64), length - k + 1)
    p = np.repeat(lo, count) + spans(count)
    arg = (best[p] & low).astype(np.int64)
    seg = np.repeat(np.arange(len(lo)), count)
    new = np.ones(len(p), bool)
    new[1:] = (arg[1:] != arg[:-1]) | (seg[1:] != seg[:-1])
    first = np.flatnonzero(new)
    n_win = np.diff(np.append(first, len(p)))
    start, a = p[first], arg[first]
    return seg[first], start, n_win, a - start, gram[a].view(np.int64)


def segments(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents cut into segments that overlap by length - 1 symbols: document, start, end."""
    n = np.diff(first)
    parts = np.maximum(1, -(-(n - length + 1) // SEGMENT))
    doc = np.repeat(np.arange(len(n)), parts)
    lo = first[:-1][doc] + spans(parts) * SEGMENT
    return doc, lo, np.minimum(lo + SEGMENT + length - 1, first[1:][doc])


def text_hashes(batch: pa.RecordBatch) -> np.ndarray:
    """64 bits of a text and of whether its doc_id is null; beside doc_id they name a row's content."""
    data, off = utf8(column(batch, "text"))
    raw, null = memoryview(data), column(batch, "doc_id").is_null().to_numpy(zero_copy_only=False)
    return np.array([xxhash.xxh3_64_intdigest(raw[off[i] : off[i + 1]], int(null[i])) for i in range(len(off) - 1)], np.uint64).view(np.int64)


def packed(docs: DataFrame, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The rows that ``wanted`` (did, th) lets pass, keyed for joins, their texts compressed: what a shuffle of texts costs is mostly bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            did, th = ids(column(b, "doc_id")), text_hashes(b)
            on = np.flatnonzero(wanted(did, th))
            if not len(on):
                continue
            data, off = utf8(column(b, "text"))
            raw = memoryview(data)
            yield pa.record_batch([column(b, "doc_id").take(pa.array(on)), pa.array(did[on]), pa.array(th[on]), pa.array([z.compress(raw[off[i] : off[i + 1]]) for i in on.tolist()], pa.binary())], names=["doc_id", "did", "th", "z"])

    return docs.mapInArrow(rows, "doc_id long, did long, th long, z binary")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes]]:
    z = zstandard.ZstdDecompressor()
    for b in batches:
        for row in b.to_pylist():
            raw = row.pop("z")
            yield row, z.decompress(raw, max_output_size=zstandard.frame_content_size(raw) or 1)


def _named(kind: Kind, whole: bool) -> Callable:
    """(doc_id, did, t1, t2[, z]): a row's id, and 128 bits that name its text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            data, off = utf8(column(b, "text"))
            raw = memoryview(data)
            t, packs = [], []
            for i in range(len(off) - 1):
                text = kind.normal(bytes(raw[off[i] : off[i + 1]]))
                t.append(xxhash.xxh3_128_digest(text))
                if whole:
                    packs.append(z.compress(text))
            name = np.frombuffer(b"".join(t), np.int64).reshape(-1, 2)
            out = [column(b, "doc_id"), pa.array(ids(column(b, "doc_id"))), pa.array(name[:, 0]), pa.array(name[:, 1])]
            yield pa.record_batch([*out, pa.array(packs, pa.binary())] if whole else out, names=["doc_id", "did", "t1", "t2", *(["z"] if whole else [])])

    return rows


def bases(docs: DataFrame, kind: Kind) -> DataFrame:
    """(rid, doc_id, w, z) of all rows, written to the shared folder: w counts the rows of a text at the one that stands for them, others have none.

    Rows that repeat (doc_id, text) all stand for their text; there are two at least, so it is repeated throughout.
    """
    names = "doc_id long, did long, t1 long, t2 long"
    one = docs.mapInArrow(_named(kind, False), names).groupBy("t1", "t2").agg(F.count("*").alias("w"), F.min("did").alias("did"))
    full = docs.mapInArrow(_named(kind, True), names + ", z binary").join(one, ["did", "t1", "t2"], "left")
    return materialize(full.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "w", "z"))


def own_repeats(doc: np.ndarray, g: np.ndarray, c: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each run how often its document has it, 0 for all but the first; and document, first window and windows of ranges of such repeats.

    So a document that says one thing over and over sends it once.
    """
    order = np.lexsort((p, c[:, 1], c[:, 0], g, doc))
    new = np.append(True, np.any([x[order][1:] != x[order][:-1] for x in (doc, g, c[:, 0], c[:, 1])], axis=0))
    size = np.diff(np.append(np.flatnonzero(new), len(order)))
    again = np.zeros(len(order), np.int64)
    again[order[new]] = size
    repeat = np.zeros(len(order), bool)
    repeat[order] = np.repeat(size > 1, size)
    at = np.flatnonzero(repeat)
    # Runs follow one another, so ranges of adjacent ones are one range, cut to what a row can say.
    joint = np.append(True, (doc[at][1:] != doc[at][:-1]) | (p[at][1:] != p[at][:-1] + n[at][:-1])) if len(at) else np.zeros(0, bool)
    s, e = at[joint], at[np.append(joint[1:], True)] if len(at) else at
    windows = p[e] + n[e] - p[s]
    parts = -(-windows // MOST)
    k = spans(parts)
    return again, (np.repeat(doc[s], parts), np.repeat(p[s], parts) + k * MOST, np.minimum(np.repeat(windows, parts) - k * MOST, MOST))


def _runs(rid: np.ndarray, w: np.ndarray, g: np.ndarray, c: np.ndarray, p: np.ndarray, n: np.ndarray, a: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x) for x in (rid, w, g, c[:, 0], c[:, 1], p << 2 * SMALL | n << SMALL | a)], names=list(_RUN))


def run_rows(kind: Kind) -> Callable:
    """Runs of minimisers, with the weight of their text; and as rows of weight ``KNOWN``, each with a g of its own, what a document says twice itself."""
    def of(held: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        raw = b"".join(x[2] for x in held)
        view = memoryview(raw)
        off = np.cumsum([0, *(len(x[2]) for x in held)])
        rid, w = np.array([x[0] for x in held]), np.minimum([x[1] for x in held], 2).astype(np.int32)
        sym, first, start, end = kind.symbols(np.frombuffer(raw, np.uint8), off)
        doc, lo, hi = segments(first, kind.length)
        step = 1 if len(sym) > SEGMENT + kind.length else max(1, len(doc))
        for s in range(0, len(doc), step):
            d, x, y = doc[s : s + step], lo[s : s + step], hi[s : s + step]
            base = int(x[0])
            seg, p, n, a, g = runs(kind.values(sym[base : int(y[-1])]), x - base, y - base, kind.length, kind.k)
            if not len(seg):
                continue
            at, last = p + base, p + base + n + kind.length - 2
            u, v = (at, last + 1) if start is None else (start[at], end[last])
            c = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[i:j]) for i, j in zip(u.tolist(), v.tolist(), strict=True)]), np.int64).reshape(-1, 2)
            o = d[seg]
            p = at - first[o]
            again, known = own_repeats(o, g, c, p, n)
            once = again < 2
            o, weight, g, c, p, n, a = (x[again > 0] for x in (o, np.where(once, w[o], 2).astype(np.int32), g & ~1, c, p, n, a))
            yield _runs(rid[o], weight, g, c, p, n, a)
            if len(known[0]):
                o, p, n = known
                none = np.zeros(len(o), np.int64)
                own = mix(mix(rid[o].astype(np.uint64)) + p.astype(np.uint64)).view(np.int64) | 1
                keep = w[o] == 1
                yield _runs(*(x[keep] for x in (rid[o], np.full(len(o), KNOWN, np.int32), own, np.zeros((len(o), 2), np.int64), p, n, none)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row, raw in unpacked(batches):
            if held and size + len(raw) > SEGMENT:
                yield from of(held)
                held, size = [], 0
            held.append((row["rid"], row["w"], raw))
            size += len(raw)
        if held:
            yield from of(held)

    return rows


def repeated_spans(base: DataFrame, kind: Kind) -> DataFrame:
    """(rid, spans array<struct<s,e>>): symbol ranges that repeated windows cover, for rows of ``base`` whose text occurs once."""
    spark = base.sparkSession
    rows = base.where("w is not null").select("rid", "w", "z").mapInArrow(run_rows(kind), schema(_RUN))
    seen = rows.groupBy("g").agg(F.sum("w").alias("seen"), *(f(c).alias(f.__name__ + c) for f in (F.min, F.max) for c in ("c1", "c2")))
    shared = materialize(seen.where("seen > 1").selectExpr("g", "minc1 = maxc1 and minc2 = maxc2 as alike"))
    release(spark)
    hits = materialize(rows.join(shared, "g"))
    release(spark, shared)
    mixed = hits.where("not alike")
    # One representative of each distinct content (all ``first`` of a group are of one row), with its multiplicity.
    content = materialize(mixed.groupBy("g", "c1", "c2").agg(F.sum("w").alias("m"), F.first("rid").alias("rid"), F.first("at").alias("at")))
    groups = content.groupBy("g").agg(F.count("*").alias("k"), F.min("m").alias("least")).where("k > 1 and least = 1").select("g")
    wanted = content.join(groups, "g").select("rid", F.struct("g", "m", "at").alias("r")).groupBy("rid").agg(F.collect_list("r").alias("rs"))
    contexts = materialize(base.select("rid", "z").join(wanted, "rid").mapInArrow(_contexts(kind), schema(_CONTEXT)))
    release(spark)
    settled = settle(contexts, kind)
    # A content that many documents share is a hot key here: a sort-merge join, so that adaptive execution can split it.
    multi = content.where("m > 1").select("g", "c1", "c2").hint("merge")
    once = "w = 1"  # the others are known, or their text occurs again
    full = hits.where(f"alike and w in (1, {KNOWN})").select("rid", "at").unionByName(mixed.where(once).join(multi, ["g", "c1", "c2"]).select("rid", "at"))
    full = full.selectExpr("rid", f"shiftright(at, {2 * SMALL}) as s", f"shiftright(at, {2 * SMALL}) + (shiftright(at, {SMALL}) & {MOST}) + {kind.length - 1} as e")
    found = materialize(full.unionByName(settled).groupBy("rid").agg(F.collect_set(F.struct("s", "e")).alias("spans")))
    release(spark, hits, content, contexts)
    return found


def _contexts(kind: Kind) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for row, raw in unpacked(batches):
            sym = kind.split(raw)
            for r in row["rs"]:
                p, n, a = r["at"] >> 2 * SMALL, r["at"] >> SMALL & MOST, r["at"] & MOST
                ctx = kind.join(sym[p : p + n + kind.length - 1])
                out.append((r["g"], 0, 0, kind.distances, row["rid"], p, n, a, r["m"], len(ctx), ctx))
                size += len(ctx)
                if size > 1 << 22 or len(out) >= 4096:
                    yield batch(out, _CONTEXT)
                    out, size = [], 0
        if out:
            yield batch(out, _CONTEXT)

    return rows


def settle(contexts: DataFrame, kind: Kind) -> DataFrame:
    """(rid, s, e) of repeated windows of contexts with multiplicity 1: groups are split until each fits its bound, then sorted by the index."""
    cur, out, key = contexts, [], ["k1", "k2"]
    while True:
        large = materialize(cur.groupBy(*key).agg(F.sum("size").alias("bytes")).where(f"bytes > {kind.group_bound}").select(*key))
        if large.isEmpty():
            out.append(_index(cur, kind))
            break
        out.append(_index(cur.join(large, key, "left_anti"), kind))
        over = cur.join(large, key, "left_semi")
        # One distance left, so the group's windows are equal, and there are two at least.
        out.append(over.where("hi - lo = 1 and m = 1").selectExpr("rid", "p + a - lo as s", f"p + a - lo + {kind.length} as e"))
        halves = materialize(over.where("hi - lo > 1").mapInArrow(_halves(kind), schema(_CONTEXT)))
        alive = halves.groupBy(*key).agg(F.count("*").alias("n"), F.min("m").alias("least")).where("n > 1 and least = 1").select(*key)
        cur = materialize(halves.join(alive, key, "left_semi"))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def _halves(kind: Kind) -> Callable:
    """Contexts of a large group, dealt anew by what the suffixes of either half of the distances have in common."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        behind = kind.length - kind.k
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                sym, a = kind.split(r["ctx"]), r["a"]
                mid = (r["lo"] + r["hi"]) // 2
                for lo, hi in ((r["lo"], mid), (mid, r["hi"])):
                    if lo <= a and hi > a - r["n"] + 1:  # the context has a suffix at such a distance
                        part = kind.join(sym[a - lo : a + kind.k + behind - hi + 1])
                        key = struct.unpack("<qq", xxhash.xxh3_128_digest(struct.pack("<ii", lo, hi) + part))
                        out.append((*key, lo, hi, r["rid"], r["p"], r["n"], a, r["m"], r["size"], r["ctx"]))
            if out:
                yield batch(out, _CONTEXT)

    return rows


def _index(contexts: DataFrame, kind: Kind) -> DataFrame:
    return contexts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "rid", "p").mapInArrow(_settled(kind), schema(_SPANS))


def _settled(kind: Kind) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["k1", "k2"], 2048):
            n, a, lo, hi, p, k1, k2 = (t[x].to_numpy().astype(np.int64) for x in ("n", "a", "lo", "hi", "p", "k1", "k2"))
            sym, first = kind.numbers(t["ctx"].to_pylist())
            # Windows of the row whose minimiser is at a distance of [lo, hi).
            j0 = np.maximum(a - hi + 1, 0)
            count = np.maximum(np.minimum(a - lo, n - 1) - j0 + 1, 0)
            row = np.repeat(np.arange(len(n)), count)
            j = j0[row] + spans(count)
            group = np.cumsum(np.append(0, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
            key = group[row] * (kind.length + 1) + a[row] - j
            hit = np.zeros(len(row), bool)
            order = np.argsort(key, kind="stable")
            edge = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
            i = 0
            while i < len(edge):  # equal windows have equal keys, so keys may be settled apart
                e = max(i + 1, int(np.searchsorted(edge, edge[i] + AT_ONCE)))
                take = order[edge[i] : edge[e] if e < len(edge) else len(order)]
                hit[take] = kind.settle(sym, first[row[take]] + j[take], key[take], kind.length)
                i = e
            hit &= (t["m"].to_numpy() == 1)[row]
            if not hit.any():
                continue
            near = np.append(False, (row[1:] == row[:-1]) & (j[1:] == j[:-1] + 1))
            new = hit & ~(np.append(False, hit[:-1]) & near)
            end = hit & ~np.append(hit[1:] & near[1:], False)
            s, e = np.flatnonzero(new), np.flatnonzero(end)
            yield pa.record_batch([pa.array(v) for v in (t["rid"].to_numpy()[row[s]], p[row[s]] + j[s], p[row[e]] + j[e] + kind.length)], names=list(_SPANS))

    return rows


def merged(pairs: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ranges that touch or overlap joined into maximal ones: starts, ends."""
    if not pairs:
        z = np.zeros(0, np.int64)
        return z, z
    s = np.array([x["s"] for x in pairs])
    e = np.array([x["e"] for x in pairs])
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.append(True, s[1:] > e[:-1])
    return s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]


def apply_spans(docs: DataFrame, kind: Kind, digest: Callable[[int | None, list | bytes, np.ndarray, np.ndarray], tuple], columns: dict[str, pa.DataType]) -> DataFrame:
    """``digest`` of doc_id, symbols, and starts and ends of the maximal repeated ranges, for every row."""
    tune(docs.sparkSession)
    base = bases(texts(docs), kind)
    joined = base.join(repeated_spans(base, kind), "rid", "left").selectExpr("doc_id", "w is null or w > 1 as whole", "z", "spans")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for row, raw in unpacked(batches):
            sym = kind.split(raw)
            s, e = merged(row["spans"] or [])
            if row["whole"] and len(sym) >= kind.length:
                s, e = np.array([0]), np.array([len(sym)])
            out.append(digest(row["doc_id"], sym, s, e))
            size += len(raw)
            if len(out) >= 256 or size > 1 << 22:
                yield batch(out, columns)
                out, size = [], 0
        if out:
            yield batch(out, columns)

    return joined.mapInArrow(rows, schema(columns))

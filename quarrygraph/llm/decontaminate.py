"""Benchmark decontamination by template canonicalisation.

Words become a template: numbers (with their separators), names (runs of capitalised words inside a sentence) and units (after a
number) turn into typed placeholders, all else is lower-cased; a capitalised word that opens a sentence is read both ways. Windows of
``SEED_WORDS`` template words of documents are hash-joined with those of benchmark items. Windows with more slots than words are joined by
their own words, and as a template where a window of ``WINDOW`` words holds a word at least. In a run of windows at one alignment, a
value of the item always stands for the same value of the document. Items of whose words a share of ``COVERAGE`` is in
consistent windows at one place are in the document: verbatim, lightly edited or re-parameterised.

Result: one row for each document and item found, with the share of the item's words, and its windows. Clean documents have no row.

Defined results: null and empty texts match nothing; an item of fewer words than a window is one window of all its words; items
without any word never match; an item of nothing but slots is found verbatim only, and stretches without a word in reach of a window
do not count in other items; rows that repeat a doc_id are looked at apart and reported once each; empty tables give an empty table;
other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm.common import column, doc_chunks, ids, mix, span_hashes, spans, texts, tune, utf8
from quarrygraph.llm.minhash_join import identified
from quarrygraph.llm.toxicity import words_of
from quarrygraph.llm.windows import text_hashes

#: Words of a window with many slots, words of all others, and the share of an item's words that must be found.
WINDOW, SEED_WORDS, COVERAGE = 8, 5, 0.6
SEED, RAW, LONG = range(3)
FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_found", pa.int64()), ("n_windows", pa.int64()), ("exact", pa.bool_()), ("did", pa.int64()), ("th", pa.int64())])
#: Hashes of benchmark windows that are broadcast as a filter before the join; of more, a bitmap of up to so many bits (32 MB).
FILTER_HASHES, FILTER_BITS = 500_000, 28
#: Units of measure.
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "ton", "tons", "ounce", "ounces", "pound", "pounds", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "dollar", "dollars", "cent", "cents", "euro", "euros", "degree", "degrees", "mph", "kmh", "watt", "watts", "volt", "volts", "joule", "joules", "hz", "kb", "mb", "gb", "tb")
#: Placeholders of numbers, names and units.
NUM, NAME, UNIT = (mix(np.array([x], np.uint64))[0] for x in (101, 102, 103))

_DIGIT = np.array([chr(i).isdigit() for i in range(65536)] + [False])
_UPPER = np.array([chr(i).isupper() for i in range(65536)] + [False])
_LOWER = np.array([chr(i).islower() for i in range(65536)] + [False])
_FOLD = np.array([ord(chr(i).lower()) if len(chr(i).lower()) == 1 else i for i in range(65536)], np.uint32)
#: What ends a sentence, so that the next capital is no name.
_STOP = np.zeros(65537, bool)
_STOP[[ord(c) for c in ".!?:;\n"]] = True
#: What may stand between the names of a run, and inside a number.
_BLANK, _MARK = np.zeros(65537, bool), np.zeros(65537, bool)
_BLANK[[ord(c) for c in " \t\xa0"]] = True
_MARK[[ord(c) for c in ".,"]] = True


def _hash(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    fold = np.where(points < 65536, _FOLD[np.minimum(points, 65535)], points).astype(np.uint64)
    return span_hashes(fold, start, end, 21)


def template(points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template words, own hashes, whether a slot, whether a slot or a word, and the first word of each of the texts that ``off`` bounds."""
    start, end = words_of(points)
    if not len(start):
        z = np.zeros(0, np.uint64)
        return z, z, np.zeros(0, bool), np.zeros(0, bool), np.zeros(len(off), np.int64)
    first = np.searchsorted(start, off)
    low = np.minimum(points, 65536)
    stops = np.append(0, np.cumsum(_STOP[low]))
    lowers = np.append(0, np.cumsum(_LOWER[low]))
    inks = np.append(0, np.cumsum(~_BLANK[low]))
    head = np.zeros(len(start), bool)
    head[first[:-1][first[:-1] < len(start)]] = True
    before = np.append(0, end[:-1])
    number = _DIGIT[low[start]]
    shape = _UPPER[low[start]] & ((lowers[end] > lowers[start]) | (end - start == 1))
    inside = ~head & (stops[start] == stops[before])
    name = shape & inside
    # A number with separators is one word, and so is a run of names.
    digits = np.append(False, number[:-1] & number[1:] & (start[1:] - end[:-1] == 1) & _DIGIT[low[end[:-1] - 1]] & _MARK[low[end[:-1]]])
    names = np.append(False, name[:-1] & name[1:] & (inks[start[1:]] == inks[end[:-1]])) & ~head
    part = np.flatnonzero(~((digits & ~head) | names))
    last = np.append(part[1:], len(start))
    parts = _hash(points, start, end)
    many = last - part > 1
    own = parts[part]
    runs = np.flatnonzero(many & name[part])
    if len(runs):
        size = last[runs] - part[runs]
        nth = spans(size)
        own[runs] = mix(np.add.reduceat(mix(parts[np.repeat(part[runs], size) + nth] + mix(nth.astype(np.uint64) + np.uint64(1))), np.cumsum(size) - size))
    marked = np.flatnonzero(many & number[part])
    own[marked] = _hash(points, start[part[marked]], end[last[marked] - 1])
    start, head, number, name, inside, shape = start[part], head[part], number[part], name[part], inside[part], shape[part]
    first = np.searchsorted(start, off)
    unit = np.append(False, number[:-1]) & ~head & np.isin(own, _unit_hashes())
    out = own.copy()
    out[number], out[name], out[unit] = NUM, NAME, UNIT
    slot = number | name | unit
    return out, own, slot, shape & ~inside & ~slot, first


_units: list[np.ndarray] = []


def _unit_hashes() -> np.ndarray:
    if not _units:
        pts = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in UNITS]
        _units.append(np.concatenate([_hash(p, np.array([0]), np.array([len(p)])) for p in pts]))
    return _units[0]


def _points(raw: memoryview, off: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    texts_ = [bytes(raw[off[d] : off[d + 1]]).decode() for d in range(i, j)]
    at = np.cumsum([0, *(len(t) + 1 for t in texts_)])
    return np.frombuffer(("\n".join(texts_) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32), at


#: Odd multipliers drawn at random, one for each place of a window: sums of products of word hashes are multilinear hashes.
PLACES = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _salted(word: np.ndarray, place: np.ndarray | int) -> np.ndarray:
    """A word's part in a window's hash, by its place in it."""
    return word * PLACES[place]


def _sum(word: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(start), np.uint64)
    for k in range(n):
        out += _salted(word, k)[start + k]
    return out


def _windows(word: np.ndarray, own: np.ndarray, slot: np.ndarray, either: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, hashes and slots (a row of n for each) of the windows of n words within [lo, hi) that are of a kind.

    SEED: windows with no more slots than words; RAW: those with more, by their own words; LONG: windows with so many slots that seeds
    miss some, but not without any word. A window has a hash for each reading of its words that may be slots.
    """
    count = np.maximum(hi - lo - n + 1, 0)
    p = np.repeat(lo, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    if not len(p):
        return p, np.zeros(0, np.uint64), np.zeros((0, n), bool)
    s, a = np.append(0, np.cumsum(slot)), np.append(0, np.cumsum(either))
    sure, maybe = s[p + n] - s[p], a[p + n] - a[p]
    if kind == RAW:
        p = p[2 * (sure + maybe) > n]
        return p, mix(_sum(own, p, n) + np.uint64(n + 1000)), np.zeros((len(p), n), bool)
    few, most = (0, n // 2) if kind == SEED else (SEED_WORDS // 2 + 1, n - 1)
    could = (sure <= most) & (sure + maybe >= few)
    p, sure, maybe = p[could], sure[could], maybe[could]
    h = _sum(word, p, n)
    slots, eithers = (np.lib.stride_tricks.sliding_window_view(x, n) for x in (slot, either))
    out = [(p[ok], h[ok], slots[p[ok]]) for ok in [sure >= few]]
    for k in range(1, int(maybe.max(initial=0)) + 1):
        rows = np.flatnonzero(maybe == k)
        if not len(rows):
            continue
        at = np.nonzero(eithers[p[rows]])[1].reshape(-1, k)
        swap = _salted(NAME, at) - _salted(word[p[rows][:, None] + at], at)
        for mask in range(1, 1 << k):
            bits = [i for i in range(k) if mask >> i & 1]
            ok = (sure[rows] + len(bits) >= few) & (sure[rows] + len(bits) <= most)
            if not ok.any():
                continue
            r = rows[ok]
            m = slots[p[r]].copy()
            for i in bits:
                m[np.arange(len(r)), at[ok, i]] = True
            out.append((p[r], h[r] + swap[ok][:, bits].sum(1, dtype=np.uint64), m))
    p, h, m = (np.concatenate(x) for x in zip(*out, strict=True))
    return p, mix(h + np.uint64(n)), m


def _lists(value: np.ndarray, p: np.ndarray, mask: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """For each window, the values of its slots by place; order is enough as templates are equal."""
    if not len(p):
        return pa.array([], pa.list_(kind))
    v = np.lib.stride_tricks.sliding_window_view(value, n)[p][mask]
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(mask.sum(1))), pa.int32()), pa.array(v, kind))


ITEM = "item_id long, ih long, words long, counted long, n_windows long, size long, kind long, h long, ipos long, need long, islots array<long>, isure array<boolean>"


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Windows of all items; a first word that could be a name counts as either. ``need``: bits of the words of a window that count."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(column(b, "text"))
            hashes = text_hashes(b)
            for i, item in enumerate(column(b, "item_id").to_pylist()):
                points, at = _points(memoryview(data), off, i, i + 1)
                word, own, slot, either, first = template(points, at)
                words = len(word)
                if not words:
                    continue
                either[0] = not slot[0]
                lo, hi = np.array([0]), np.array([words])
                seed, long = min(SEED_WORDS, window, words), min(window, words)
                made = [(n, kind, *_windows(word, own, slot, either, lo, hi, n, kind)) for n, kind in ((seed, SEED), (seed, RAW), (long, LONG))]
                # Where no window has a word, any numbers and names would do: such places count only if there are no others.
                counts = np.zeros(words, bool)
                for n, kind, p, _, _ in made:
                    if kind != RAW:
                        counts[(p[:, None] + np.arange(n)).ravel()] = True
                if not counts.any():
                    counts[:] = True
                for n, kind, p, h, m in made:
                    k = len(p)
                    need = (counts[p[:, None] + np.arange(n)] << np.arange(n)).sum(1)
                    fixed = [pa.array([item] * k, pa.int64()), *(pa.array(np.full(k, v, np.int64)) for v in (hashes[i], words, counts.sum(), words - seed + 1, n, kind))]
                    own_, sure = _lists(own.view(np.int64), p, m, n, pa.int64()), _lists(~either, p, m, n, pa.bool_())
                    yield pa.record_batch([*fixed, pa.array(h.view(np.int64)), pa.array(p.astype(np.int64)), pa.array(need.astype(np.int64)), own_, sure], names=[f.split()[0] for f in ITEM.split(", ")])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(rows, ITEM)


class Filter:
    """Which hashes may be wanted: exactly those of few, else those with a bit in a bitmap; the join decides."""

    def __init__(self, hashes: DataFrame):
        few = [r["h"] for r in hashes.limit(FILTER_HASHES + 1).collect()]
        self.wanted = np.unique(np.array(few, np.int64).view(np.uint64)) if len(few) <= FILTER_HASHES else None
        if self.wanted is None:
            n = hashes.count()
            self.bits = min(FILTER_BITS, max(20, (16 * n).bit_length()))
            at = F.shiftrightunsigned("h", 64 - self.bits)
            # A row for each byte of the bitmap that has a bit.
            got = hashes.groupBy(F.shiftright(at, 3).alias("byte")).agg(F.bit_or(F.expr(f"shiftleft(1, int(shiftrightunsigned(h, {64 - self.bits}) & 7))")).alias("on")).toPandas()
            self.map = np.zeros(1 << self.bits - 3, np.uint8)
            self.map[got["byte"].to_numpy()] = got["on"].to_numpy()
        else:
            self.map = np.zeros(1 << 20, bool)
            self.map[self.wanted >> np.uint64(44)] = True

    def passing(self, h: np.ndarray) -> np.ndarray:
        if self.wanted is None:
            place = h >> np.uint64(64 - self.bits)
            return np.flatnonzero(self.map[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
        ok = np.flatnonzero(self.map[h >> np.uint64(44)])
        return ok[np.isin(h[ok], self.wanted)]


def document_windows(docs: DataFrame, sizes: list[tuple[int, int]], wanted: Filter) -> DataFrame:
    """(doc_id, did, th, h, dpos, dslots) of all windows of the given sizes and kinds whose hash may be wanted."""
    spark: SparkSession = docs.sparkSession
    held = spark.sparkContext.broadcast(wanted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            did, th = ids(column(b, "doc_id")), text_hashes(b)
            data, off = utf8(column(b, "text"))
            for i, j in doc_chunks(off, 1 << 17):
                points, at = _points(memoryview(data), off, i, j)
                word, own, slot, either, first = template(points, at)
                for n, kind in sizes:
                    p, h, m = _windows(word, own, slot, either, first[:-1], first[1:], n, kind)
                    ok = held.value.passing(h)
                    p, h, m = p[ok], h[ok], m[ok]
                    if not len(p):
                        continue
                    d = np.searchsorted(first, p, "right") - 1
                    yield pa.record_batch([column(b, "doc_id").take(pa.array(i + d)), pa.array(did[i + d]), pa.array(th[i + d]), pa.array(h.view(np.int64)), pa.array(p - first[d]), _lists(own.view(np.int64), p, m, n, pa.int64())], names=["doc_id", "did", "th", "h", "dpos", "dslots"])

    return docs.mapInArrow(rows, "doc_id long, did long, th long, h long, dpos long, dslots array<long>")


def _agreeing(run: list[dict]) -> list[dict]:
    """Windows of a run whose slots agree: none if a value of the item stands for two of the document.

    A word that opens a sentence need not be a name: if all places of a value are such, a second value is an edit, and only its windows go.
    """
    seen: dict[int, set[int]] = defaultdict(set)
    firm: set[int] = set()
    for w in run:
        for i, d, sure in zip(w["islots"], w["dslots"], w["isure"], strict=True):
            if sure or i != d:
                seen[i].add(d)
            if sure:
                firm.add(i)
    torn = {i for i, d in seen.items() if len(d) > 1}
    if torn & firm:
        return []
    return [w for w in run if not any(i in torn and i != d for i, d in zip(w["islots"], w["dslots"], strict=True))]


def judge(words: int, counted: int, seed: int, rows: list[dict], coverage: float) -> tuple[float, int, bool] | None:
    """(share of the item's words, windows found, whether no slot differs) at the best place of a document, or None.

    Windows belong to one place if their alignments differ by at most half the item's length, as left-out or added words shift them.
    """
    by_delta: dict[int, list[dict]] = defaultdict(list)
    for r in rows:
        by_delta[r["dpos"] - r["ipos"]].append(r)
    places: dict[int, list[dict]] = defaultdict(list)
    for delta, found in by_delta.items():
        found.sort(key=lambda r: r["ipos"])
        run: list[dict] = []
        reach = -1
        good: list[dict] = []
        for r in found:
            if run and r["ipos"] > reach:
                good += _agreeing(run)
                run = []
            reach = max(reach, r["ipos"] + r["size"]) if run else r["ipos"] + r["size"]
            run.append(r)
        good += _agreeing(run)
        for place in (2 * (delta // words), 2 * ((delta + words // 2) // words) + 1):
            places[place] += good
    best = None
    for good in places.values():
        held = {r["ipos"] + k for r in good for k in range(r["size"]) if r["need"] >> k & 1}
        if len(held) < coverage * counted:
            continue
        exact = all(i == d for r in good for i, d in zip(r["islots"], r["dslots"], strict=True))
        now = (len(held) / counted, len({r["ipos"] for r in good if r["size"] == seed}), exact)
        best = now if best is None else (max(best[0], now[0]), max(best[1], now[1]), best[2] or exact)
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, n_found, n_windows, exact, did, th): items found in documents; ``exact`` if no slot differs."""
    tune(docs.sparkSession)
    items = item_windows(benchmark, window)
    sizes = [(r["size"], r["kind"]) for r in items.select("size", "kind").distinct().orderBy("size", "kind").limit(3 * window).collect()]  # three kinds a size at most
    found = document_windows(texts(docs), sizes, Filter(items.select("h").distinct())).join(items, "h")
    at = ["doc_id", "did", "th", "item_id", "ih", "words", "counted", "n_windows"]
    hit = F.struct("ipos", "dpos", "size", "need", "islots", "isure", "dslots")
    pairs = found.groupBy(*at).agg(F.collect_set(hit).alias("hits"))
    # Fewer windows than these cannot hold enough words.
    pairs = pairs.where(F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["size"]) >= F.col("counted") * coverage)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in range(b.num_rows):
                doc, did, th, item, _, words, counted, n, hits = (c[r].as_py() for c in b.columns)
                got = judge(words, counted, words - n + 1, hits, coverage)
                if got:
                    out.append((doc, item, got[0], got[1], n, got[2], did, th))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(FOUND.names, o, strict=True)) for o in out], schema=FOUND)

    return pairs.mapInArrow(rows, "doc_id long, item_id long, coverage double, n_found long, n_windows long, exact boolean, did long, th long")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, **params: float) -> DataFrame:
    """``docs`` without the documents in which an item is found."""
    keys, keyed = identified(docs)
    bad = leaks(docs, benchmark, **params).select("did", "th").distinct().toDF(*keys)
    return keyed.join(bad, keys, "left_anti").select(*docs.columns)

"""Toxicity by Levenshtein automata intersected with a lexicon trie, and context-window scores.

The lexicon is learned from labelled rows: all words, and word beginnings (for inflected forms), that occur in toxic documents and
hardly elsewhere, and not by chance. Its trie is intersected with the Levenshtein automaton of each term's allowance (one edit from
four letters, two from eight, a swap is one) and made deterministic as texts need it, so one table walk per word finds exact and
misspelled terms; words with letters drawn out, and words that signs mask or split, are walked too. What stands around a
hit (quotation marks, reporting words, address) makes its context score, which separates quotation from abuse;
a logistic model over a document's hits, exact or misspelled, quoted or not, gives the score.

Learning uses at most ``FIT_ROWS`` labelled rows, those of least hash; every document is scored whole.

Defined results: a null or empty text has no hits and the score of a document without hits; a doc_id with contradicting labels counts as
unlabelled; without labels every score is 0; rows that repeat get equal scores; an empty table gives an empty table; other
columns pass through ``score`` and columns named like its results are replaced.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph.llm.common import column, doc_chunks, texts, tune, utf8
from quarrygraph.llm.quality_mil import THRESHOLD, fit_rows, held_out

FIT_ROWS = 15_000
#: Documents a term is in at least, and the greatest chance that a term is in as many toxic ones by accident.
LEAST, CHANCE = 3, 0.001
#: Letters of a word from which one edit is allowed, where no other allowance is given.
FUZZY_FROM = 5
STEMS = (4, 5, 6)
WINDOW = 60
#: Marks and words that introduce quoted speech.
QUOTES = "\"“”„«»‘’"
REPORTING = ("said", "says", "called", "wrote", "quote", "quoted", "word", "term", "slur", "reported", "dit", "mot", "dijo", "palabra", "sagte", "wort")


def _lower(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _letters() -> np.ndarray:
    """Which code points of the basic plane are parts of words; those beyond it count as letters."""
    return np.array([chr(i).isalnum() or i == 95 for i in range(65536)] + [True])


LETTER = _letters()
_BLANK = np.array([chr(i).isspace() for i in range(65536)] + [False])


def words_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(points):
        z = np.zeros(0, np.int64)
        return z, z
    w = np.concatenate([[False], LETTER[np.minimum(points, 65536)], [False]])
    return np.flatnonzero(w[1:-1] & ~w[:-2]), np.flatnonzero(w[1:-1] & ~w[2:]) + 1


def loose(term: str, stem: bool) -> int:
    """Edits of a term that still are the term: one from four letters and two from eight; beginnings of words need a letter more."""
    return (len(term) >= 4 + stem) + (len(term) >= 8 + stem)


class Automaton:
    """Deterministic automaton of all terms within their edit allowances; its states are made when a text first needs them.

    A sign inside a word stands for one letter or none.
    """

    #: States that are kept; with more, all are made anew, so memory is bounded however many terms there are.
    MOST = 200_000

    def __init__(self, terms: list[tuple[str, bool]], allowance: Callable[[str, bool], int], swaps: bool):
        """terms: (text, whether any ending may follow)."""
        self.swaps = swaps
        self.trie: list[dict[str, int]] = [{}]
        self.ends: dict[int, bool] = {}
        self.allow = [0]
        self.exact: dict[int, int] = {}
        for t, stem in terms:
            node, k = 0, allowance(t, stem)
            self.allow[0] = max(self.allow[0], k)
            for ch in t:
                if ch not in self.trie[node]:
                    self.trie[node][ch] = len(self.trie)
                    self.trie.append({})
                    self.allow.append(0)
                node = self.trie[node][ch]
                self.allow[node] = max(self.allow[node], k)
            self.ends[node] = self.ends.get(node, False) or stem
            self.exact[node] = max(self.exact.get(node, 0), k)
        self.letters = sorted({c for t in self.trie for c in t})
        self.longest = max((len(t) for t, _ in terms), default=0)
        n = len(self.letters)
        self.symbol = np.where(LETTER, n, n + 1).astype(np.int32)
        for i, c in enumerate(self.letters):
            self.symbol[min(ord(c), 65536)] = i
        self._clear()

    @classmethod
    def of(cls, terms: list[tuple[str, bool]], allowance: Callable[[str, bool], int] | None = None, swaps: bool = False) -> Automaton:
        return cls(terms, allowance or (lambda t, _: int(len(t) >= FUZZY_FROM)), swaps)

    def _clear(self) -> None:
        """State 0 is dead, state 1 the start."""
        start = self._closed({(0, ""): 0})
        self.sets: list[tuple] = [(), start]
        self.number = {(): 0, start: 1}
        self.step = np.full((1024, len(self.letters) + 2), -1, np.int32)
        self.step[0] = 0
        self.accept = np.full(1024, -1, np.int8)
        self.accept[1] = self._accepts(start)

    def _accepts(self, states: tuple) -> int:
        # A term's own allowance may be less than that of a longer term through its node.
        return min((e for (node, mode), e in states if mode in ("", "free") and node in self.ends and e <= self.exact[node]), default=-1)

    def _closed(self, states: dict[tuple[int, str], int]) -> tuple:
        todo = list(states.items())
        while todo:  # an edit that leaves out a letter of the term
            (node, mode), e = todo.pop()
            for child in self.trie[node].values() if not mode else ():
                if e + 1 <= self.allow[child] and states.get((child, ""), 9) > e + 1:
                    states[child, ""] = e + 1
                    todo.append(((child, ""), e + 1))
        for (node, mode), e in list(states.items()):
            if not mode and self.ends.get(node) and e <= self.exact[node] and states.get((node, "free"), 9) > e:
                states[node, "free"] = e
        return tuple(sorted(states.items()))

    def _next(self, state: int, symbol: int) -> int:
        n = len(self.letters)
        ch = self.letters[symbol] if symbol < n else ""
        sign = symbol == n + 1
        out: dict[tuple[int, str], int] = {}

        def put(node: int, mode: str, e: int) -> None:
            if e <= self.allow[node] and out.get((node, mode), 9) > e:
                out[node, mode] = e

        for (node, mode), e in self.sets[state]:
            if mode == "free":
                put(node, mode, e)
            elif mode:  # the second letter of a swap
                if ch == mode:
                    put(node, "", e)
            else:
                put(node, "", e + (not sign))
                for c, child in self.trie[node].items():
                    put(child, "", e + (c != ch and not sign))
                    if self.swaps and ch and c != ch and ch in self.trie[child]:
                        put(self.trie[child][ch], c, e + 1)
        key = self._closed(out)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.sets)
            self.sets.append(key)
            if to >= len(self.step):
                self.step = np.concatenate([self.step, np.full_like(self.step, -1)])
                self.accept = np.concatenate([self.accept, np.full_like(self.accept, -1)])
            self.accept[to] = self._accepts(key)
        self.step[state, symbol] = to
        return to

    def match(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Edits of the best term for each word, -1 for none; all words walk together."""
        if len(self.sets) > self.MOST:
            self._clear()
        state = np.ones(len(start), np.int32)
        live, at = np.arange(len(start)), start
        sym = self.symbol[np.minimum(points, 65536)]
        out = np.full(len(start), -1, np.int8)
        while len(live):
            over = at >= end[live]
            out[live[over]] = self.accept[state[live[over]]]
            live, at = live[~over], at[~over]
            now, read = state[live], sym[at]
            to = self.step[now, read]
            new = np.flatnonzero(to < 0)
            if len(new):
                for pair in set(zip(now[new].tolist(), read[new].tolist(), strict=True)):
                    self._next(*pair)
                to = self.step[now, read]
            state[live] = to
            alive = to > 0
            live, at = live[alive], at[alive] + 1
        return out


def spots(automaton: Automaton, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and edits of all that matches: words, words with letters drawn out, and words that signs mask or split."""
    start, end = words_of(points)
    edits = automaton.match(points, start, end)
    if not len(start):
        return start, end, edits
    drawn = np.flatnonzero((points[2:] == points[1:-1]) & (points[1:-1] == points[:-2]) & LETTER[np.minimum(points[2:], 65536)])
    w = np.unique(np.searchsorted(start, drawn, "right") - 1)
    w = w[edits[w] < 0]
    if len(w):
        short = []
        for i in w:
            x = points[start[i] : end[i]]
            short.append(x[np.append(True, x[1:] != x[:-1])])
        stop = np.cumsum([len(x) for x in short])
        got = automaton.match(np.concatenate(short), np.append(0, stop[:-1]), stop)
        edits[w] = np.where(got >= 0, np.maximum(got, 1), -1)
    hit = edits >= 0
    found = [(start[hit], end[hit], edits[hit])]
    # Runs of words with signs but no space between them, none of them a hit: a sign stands for a letter or for none.
    blank = np.append(0, np.cumsum(_BLANK[np.minimum(points, 65536)]))
    tied = np.append((blank[start[1:]] == blank[end[:-1]]) & ~hit[1:] & ~hit[:-1], False)
    letters = np.append(0, np.cumsum(end - start))
    i = j = np.flatnonzero(tied)
    taken = np.zeros(len(start), bool)
    masked = []
    while len(i):
        j = j + 1
        n = letters[j + 1] - letters[i]
        ok = n <= automaton.longest + 2
        i, j, n = i[ok], j[ok], n[ok]
        got = np.full(len(i), -1)
        long = n >= 3
        got[long] = automaton.match(points, start[i[long]], end[j[long]])
        masked += [(a, b) for a, b in zip(i[got == 0].tolist(), j[got == 0].tolist(), strict=True)]
        on = tied[j]
        i, j = i[on], j[on]
    keep = []
    for a, b in sorted(masked, key=lambda x: (x[0] - x[1], x[0])):
        if not taken[a : b + 1].any():
            taken[a : b + 1] = True
            keep.append((a, b))
    if keep:
        a, b = np.array(keep).T
        found.append((start[a], end[b], np.ones(len(a), np.int8)))
    s, e, k = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(s, kind="stable")
    return s[order], e[order], k[order]


@dataclass
class Model:
    automaton: Automaton
    #: Misspelling-like words that clean documents use.
    innocent: set[str] = field(default_factory=set)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES + 1))


N_FEATURES = 8


def hits(model: Model, text: str) -> list[tuple[str, int, float]]:
    """(word, edits, context score) of each hit; 1 is plain use, 0 is a quotation."""
    points = _lower(text)
    start, end, edits = spots(model.automaton, points)
    if not len(start):
        return []
    low = points.tobytes().decode("utf-32-le", "surrogatepass")
    out = []
    for i in range(len(start)):
        s, e = int(start[i]), int(end[i])
        word = low[s:e]
        if edits[i] and word in model.innocent:
            continue
        before, after = low[max(0, s - WINDOW) : s], low[e : e + WINDOW]
        quoted = any(q in before[-24:] for q in QUOTES) and any(q in after[:24] for q in QUOTES)
        told = any(w in REPORTING for w in before.replace(":", " ").split()[-4:])
        out.append((word, int(edits[i]), 1.0 - 0.6 * quoted - 0.4 * told))
    return out


def document_features(found: list[tuple[str, int, float]], size: int) -> list[float]:
    plain = [c for _, e, c in found if not e]
    near = [c for _, e, c in found if e]
    return [float(max(plain, default=0) > 0.5), np.log1p(sum(plain)), float(bool(near) and max(near) > 0.5), np.log1p(sum(near)), float(bool(found)), np.log1p(sum(1 - c for _, _, c in found)), np.log1p(1000 * sum(c for _, _, c in found) / (size + 50)), float(len({w for w, _, _ in found}) > 1)]


def _terms(docs: DataFrame, sample: DataFrame) -> list[tuple[str, bool]]:
    """Words and stems that mark toxic documents, by document frequency over the sample."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: dict[tuple[str, bool], list[int]] = defaultdict(lambda: [0, 0])
            for text, y in zip(column(b, "text").to_pylist(), column(b, "y").to_pylist(), strict=True):
                points = _lower(text or "")
                low = points.tobytes().decode("utf-32-le", "surrogatepass")
                words = {low[s:e] for s, e in zip(*(x.tolist() for x in words_of(points)), strict=True)}
                for t in {(w, False) for w in words if 3 <= len(w) <= 24} | {(w[:n], True) for w in words for n in STEMS if len(w) > n}:
                    count[t][y] += 1
            yield pa.record_batch([pa.array([t for t, _ in count], pa.string()), pa.array([s for _, s in count], pa.bool_()), pa.array([c[0] for c in count.values()], pa.int64()), pa.array([c[1] for c in count.values()], pa.int64())], names=["t", "stem", "neg", "pos"])

    one = docs.join(sample, "doc_id")
    total = sample.groupBy("y").count().collect()
    n = {r["y"]: r["count"] for r in total}
    if len(n) < 2:
        return []
    counted = one.mapInArrow(rows, "t string, stem boolean, neg long, pos long").groupBy("t", "stem").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    share = n[1] / (n[0] + n[1])
    # At least 50 times as frequent among toxic documents, and not by chance.
    good = counted.where((F.col("pos") >= LEAST) & (F.col("pos") / n[1] > 50 * (F.col("neg") + 0.2) / n[0])).collect()  # the vocabulary of toxic fit rows at most
    top = [r for r in good if by_chance(r["pos"], r["neg"], share) < CHANCE]
    stems = {r["t"]: r["pos"] for r in top if r["stem"]}
    # The shortest clean stem stands for its extensions, and a word is a stem's work where the stem is much more frequent.
    best_stems = {t for t in stems if not any(t[:k] in stems for k in range(3, len(t)))}
    words = {r["t"]: r["pos"] for r in top if not r["stem"]}
    by_stem: dict[str, list[int]] = defaultdict(list)
    for w, pos in words.items():
        for k in STEMS:
            by_stem[w[:k]].append(pos)
    chosen = [(t, True) for t in sorted(best_stems) if not by_stem[t] or stems[t] > 1.5 * max(by_stem[t])]
    # Words of a chosen stem are terms as well, as a whole word has the larger allowance.
    return chosen + [(w, False) for w in sorted(words)]


def by_chance(pos: int, neg: int, share: float) -> float:
    """The chance that of a term's documents as many are toxic, or more, if the term has nothing to do with it."""
    n = pos + neg
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + (n - k) * math.log(share) + k * math.log1p(-share)) for k in range(neg + 1))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = FIT_ROWS) -> Model | None:
    docs = texts(docs)
    sample = F.broadcast(fit_rows(labels, "toxic", usable, rows))  # rows * 12 bytes at most
    terms = _terms(docs, sample)
    if not terms:
        return None
    model = Model(Automaton(terms, loose, True))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(y, i, len(t or ""), *map(list, zip(*(hits(sent.value, t or "") or [("", -1, 0.0)]), strict=True))) for i, y, t in zip(column(b, "doc_id").to_pylist(), column(b, "y").to_pylist(), column(b, "text").to_pylist(), strict=True)]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.float64())]
            if out:
                yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["y", "doc_id", "size", "words", "edits", "ctx"])

    got = docs.join(sample, "doc_id").mapInArrow(find, "y int, doc_id long, size long, words array<string>, edits array<int>, ctx array<double>").toPandas().sort_values("doc_id")
    found = [[(w, e, c) for w, e, c in zip(*r, strict=True) if e >= 0] for r in zip(got["words"], got["edits"], got["ctx"], strict=True)]
    y = got["y"].to_numpy(float)
    seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for f, v in zip(found, y, strict=True):
        for w in {w for w, e, _ in f if e}:
            seen[w][int(v)] += 1
    model.innocent = {w for w, (neg, pos) in seen.items() if neg and neg * 3 >= pos}
    x = np.array([document_features([h for h in f if not (h[1] and h[0] in model.innocent)], n) for f, n in zip(found, got["size"], strict=True)])
    model.weights = logistic(x, y)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-6), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> DataFrame:
    """``docs`` with score, predicted and hits (distinct words found)."""
    tune(docs.sparkSession)
    docs = docs.drop("score", "predicted", "hits")
    model = fit(docs, labels, ~held_out(F.col("doc_id"), 3, 1) if usable is None else usable)
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double, predicted int, hits array<string>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            n = b.num_rows
            x, terms = np.zeros((n, N_FEATURES)), [[] for _ in range(n)]
            if m is not None:
                data, off = utf8(column(b, "text"))
                raw = memoryview(data)
                for i, j in doc_chunks(off, 1 << 18):
                    # One walk over many documents finds those with any hit; only these are looked at closely.
                    for d in suspects(m, raw, off, i, j):
                        text = bytes(raw[off[d] : off[d + 1]]).decode()
                        f = hits(m, text)
                        x[d], terms[d] = document_features(f, len(text)), sorted({w for w, _, _ in f})
            out = 1 / (1 + np.exp(-np.clip(x @ m.weights[:-1] + m.weights[-1], -30, 30))) if m is not None else np.zeros(n)
            yield pa.record_batch([*b.columns, pa.array(out), pa.array((out >= THRESHOLD).astype(np.int32)), pa.array(terms, pa.list_(pa.string()))], names=[*names, "score", "predicted", "hits"])

    return docs.mapInArrow(rows, schema)


def suspects(m: Model, raw: memoryview, off: np.ndarray, i: int, j: int) -> list[int]:
    texts_ = [bytes(raw[off[d] : off[d + 1]]).decode().lower() for d in range(i, j)]
    size = np.array([len(t) + 1 for t in texts_])
    points = np.frombuffer(("\n".join(texts_) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    found = spots(m.automaton, points)[0]
    return sorted({i + int(d) for d in np.searchsorted(np.cumsum(size), found, "right")})

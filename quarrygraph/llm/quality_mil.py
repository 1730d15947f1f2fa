"""Quality by attention-based multiple-instance learning.

A document is a bag of passages (lines, cut every ``PASSAGE`` bytes). Each passage is encoded by a small
network over statistics of its characters and words; a gated attention layer, learned from document labels only, weighs the
passages; the weighted sum is scored. All passages of the whole text take part.

The model is fitted on at most ``FIT_ROWS`` labelled rows, those of least hash, and on at most ``FIT_PASSAGES`` passages of each, evenly
spread over the text, so that the driver holds a bounded table (100 MB); every document is scored whole.

Defined results: a null or empty text is one empty passage and gets a score like any other; a doc_id with contradicting
labels counts as unlabelled; without any labels every score is 0.5; rows that repeat get equal scores; an empty table
gives an empty table; other columns pass through ``score`` and columns named like its results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph.llm.common import column, doc_chunks, mix, texts, tune, utf8, word_hashes, word_spans

PASSAGE = 384
FIT_ROWS, FIT_PASSAGES = 6000, 200
HIDDEN, GATE, EPOCHS, BATCH = 16, 12, 12, 64
THRESHOLD = 0.7

_CLASS = np.zeros(256, np.uint8)
_GROUPS = [range(65, 91), range(97, 123), range(48, 58), (32, 9, 10, 11, 12, 13), b".,;:'\"()-", b"!?", b"#$%&*@^~+=_\\/", b"|<>{}[]`", range(128, 192), range(192, 256)]
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _i + 1
_N_CLASS = len(_GROUPS) + 1
N_FEATURES = _N_CLASS + 9


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values over [edges[i], edges[i + 1])."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def passages(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of all passages, and each passage's document; every document has one at least."""
    lo, hi = off[0], off[-1]
    lines = np.flatnonzero(data[lo:hi] == 10) + lo + 1
    edges = np.unique(np.concatenate([off, lines]))
    gap = np.diff(edges)
    parts = np.maximum(1, -(-gap // PASSAGE))
    start = np.repeat(edges[:-1], parts)
    n = np.arange(len(start)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = start + n * PASSAGE
    empty = np.flatnonzero(off[1:] == off[:-1])
    doc = np.searchsorted(off, start, "right") - 1
    start, doc = np.append(start, off[empty]), np.append(doc, empty)
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    return start, doc


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of statistics for each passage, and each passage's document."""
    start, doc = passages(data, off)
    lo = int(off[0])
    end = np.append(start[1:], off[-1])
    # An empty document's passage starts where the next one does and so has no bytes.
    edges = np.append(start, off[-1]) - lo
    cls = _CLASS[data[lo : int(off[-1])]]
    n = np.maximum(end - start, 1).astype(float)
    out = np.zeros((len(start), N_FEATURES))
    of = np.repeat(np.arange(len(start)) * _N_CLASS, np.diff(edges)) + cls
    out[:, :_N_CLASS] = np.bincount(of, minlength=len(start) * _N_CLASS).reshape(-1, _N_CLASS) / n[:, None]
    ws, we, _ = word_spans(data, off)
    if len(ws):
        h = word_hashes(data, ws, we)
        at = np.searchsorted(ws - lo, edges)
        words = np.diff(at)
        w = np.maximum(words, 1).astype(float)
        owner = np.repeat(np.arange(len(start)), words)
        again = np.append(False, (h[1:] == h[:-1]) & (owner[1:] == owner[:-1]))
        key = mix(h + mix(owner.astype(np.uint64)))
        pair = np.append(key[:1], mix(key[1:] + h[:-1] * np.uint64(3)))
        k = _N_CLASS
        out[:, k] = _sums(again, at) / w
        out[:, k + 1] = _distinct(key, owner, at) / w
        out[:, k + 2] = _distinct(pair, owner, at) / w
        out[:, k + 3] = np.log1p(_sums(we - ws, at) / w)
        first, last = cls[ws - lo], cls[we - 1 - lo]
        out[:, k + 4] = _sums((first == 1) | (first == 10), at) / w
        out[:, k + 5] = _sums((last > 6) & (last < 9), at) / w
        out[:, k + 6] = _sums((last == 6), at) / w
        out[:, k + 7] = _sums((we - ws) == 1, at) / w
        out[:, k + 8] = np.log1p(words)
    return out, doc


def _distinct(key: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
    order = np.argsort(key, kind="stable")
    s, o = key[order], owner[order]
    new = np.append(True, (s[1:] != s[:-1]) | (o[1:] != o[:-1]))
    return np.bincount(o[new], minlength=len(at) - 1)


class Model:
    """Encoder, gated attention and scorer; ``forward`` works on many bags at once."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.std = mean, std
        self.w = {"W": r.normal(0, d**-0.5, (d, HIDDEN)), "b": np.zeros(HIDDEN), "V": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "a": r.normal(0, GATE**-0.5, GATE), "u": r.normal(0, HIDDEN**-0.5, HIDDEN), "c": np.zeros(1)}

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Scores of bags that start at ``first`` in x, and what ``backward`` needs."""
        w = self.w
        x = np.clip((x - self.mean) / self.std, -6, 6)
        h = np.tanh(x @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * s) @ w["a"]
        size = np.diff(np.append(first, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), size))
        att = e / np.repeat(np.add.reduceat(e, first), size)
        z = np.add.reduceat(h * att[:, None], first)
        return 1 / (1 + np.exp(-np.clip(z @ w["u"] + w["c"], -30, 30))), (x, h, t, s, att, z, size)

    def backward(self, y: np.ndarray, p: np.ndarray, first: np.ndarray, kept: tuple) -> dict[str, np.ndarray]:
        w, (x, h, t, s, att, z, size) = self.w, kept
        d = (p - y) / len(y)
        dz = np.repeat(d, size)[:, None] * w["u"]
        datt = (dz * h).sum(1)
        de = att * (datt - np.repeat(np.add.reduceat(att * datt, first), size))
        dt, ds = de[:, None] * w["a"] * s * (1 - t**2), de[:, None] * w["a"] * t * s * (1 - s)
        dh = (dz * att[:, None] + dt @ w["V"].T + ds @ w["U"].T) * (1 - h**2)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "a": (t * s * de[:, None]).sum(0), "u": z.T @ d, "c": np.array([d.sum()])}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int = 11) -> Model:
        r = np.random.default_rng(seed)
        size = np.diff(np.append(first, len(x)))
        m, v = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2))
        step = 0
        for _ in range(EPOCHS):
            order = r.permutation(len(first))
            for i in range(0, len(order), BATCH):
                take = order[i : i + BATCH]
                rows = np.repeat(first[take], size[take]) + np.arange(size[take].sum()) - np.repeat(np.cumsum(size[take]) - size[take], size[take])
                f = np.cumsum(size[take]) - size[take]
                p, kept = self.forward(x[rows], f)
                step += 1
                for k, g in self.backward(y[take], p, f, kept).items():
                    g = g + 1e-4 * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit_rows(labels: DataFrame, label: str, usable: Column, most: int) -> DataFrame:
    """(doc_id, y) of at most ``most`` labelled rows, those of least hash."""
    one = labels.where(usable & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("y"), F.max(label).alias("z"))
    return one.where("y = z").select("doc_id", F.col("y").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = FIT_ROWS) -> Model | None:
    sample = F.broadcast(fit_rows(labels, "quality", usable, rows))  # rows * 12 bytes at most

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            data, off = utf8(column(b, "text"))
            x, doc = features(data, off)
            size = np.bincount(doc, minlength=b.num_rows)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
            taken = np.minimum(size, FIT_PASSAGES)
            # Of n passages, those where the count of taken ones goes up.
            keep = (nth + 1) * taken[doc] // size[doc] > nth * taken[doc] // size[doc]
            parts = pa.array([v.tobytes() for v in np.split(x[keep].astype(np.float32), np.cumsum(taken)[:-1])], pa.binary())
            yield pa.record_batch([column(b, "doc_id"), column(b, "y"), parts], names=["doc_id", "y", "x"])

    got = texts(docs).join(sample, "doc_id").mapInArrow(encode, "doc_id long, y int, x binary").toPandas()
    if not len(got) or got["y"].nunique() < 2:
        return None
    got = got.sort_values(["doc_id", "x"]).drop_duplicates("doc_id")
    each = [np.frombuffer(v, np.float32).reshape(-1, N_FEATURES) for v in got["x"]]
    x = np.concatenate(each)
    first = np.cumsum([0, *map(len, each)])[:-1]
    return Model(x.mean(0, dtype=float), x.std(0, dtype=float) + 1e-3).fit(x, first, got["y"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> DataFrame:
    """``docs`` with score and predicted. ``usable`` says which rows of ``labels`` may be learned from (by default all but the held-out fold)."""
    tune(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    model = fit(docs, labels, ~held_out(F.col("doc_id"), 4, 2) if usable is None else usable)
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double, predicted int"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(column(b, "text"))
            out = np.full(b.num_rows, 0.5)
            for i, j in doc_chunks(off, 1 << 20) if held.value is not None else ():
                x, doc = features(data, off[i : j + 1])
                out[i:j] = held.value.forward(x, np.flatnonzero(np.append(True, doc[1:] != doc[:-1])))[0]
            yield pa.record_batch([*b.columns, pa.array(out), pa.array((out >= THRESHOLD).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.mapInArrow(rows, schema)

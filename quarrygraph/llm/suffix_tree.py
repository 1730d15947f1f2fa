"""Substring dedup over words by prefix-partitioned suffix trees.

Words are the runs of ``[^\\x20\\x09-\\x0D]``, unchanged. Suffixes that could repeat (see ``windows``) are partitioned by a part of
variable length, from the suffix's start through its minimiser and beyond where that alone would not fit memory. In each group a
path-compressed suffix tree is built top-down over the real words, cut at ``window`` words; the suffixes below internal nodes of
that depth are the repeats.

Defined results: a null or empty text has no words, nothing removed, and the hash of the empty string; a text
shorter than a window loses nothing; rows that repeat a text (or a whole row) are documents of their own,
so all their windows repeat; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarrygraph.llm.common import word_hashes, word_spans
from quarrygraph.llm.windows import Kind, apply_spans

WINDOW = 35


def word_symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(data, off)
    return word_hashes(data, starts, ends), first, starts, ends


def word_numbers(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers, equal exactly where the words are."""
    each = [c.split() for c in contexts]
    words = pa.array([w for c in each for w in c], pa.large_binary()).dictionary_encode()
    return words.indices.to_numpy(), np.cumsum([0, *map(len, each)])[:-1]


def deep_leaves(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which leaves hang below an internal node as deep as the rows are long, in the suffix tree of each group.

    Nodes are made top-down, level by level. A node is a set of leaves; its depth is the first symbol at which they differ, so its
    edge is as long as can be; below it leaves part by the symbol at its depth, and single ones are done with.
    """
    n, depth = rows.shape
    out = np.zeros(n, bool)
    live = np.argsort(group, kind="stable")
    g = group[live]
    while len(live):
        start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        size = np.diff(np.append(start, len(g)))
        keep = np.repeat(size > 1, size)
        live, size = live[keep], size[size > 1]
        if not len(live):
            break
        start = np.cumsum(size) - size
        own = rows[live]
        same = own == np.repeat(own[start], size, axis=0)
        differ = np.where(same.all(1), depth, same.argmin(1))
        node = np.minimum.reduceat(differ, start)
        deep = np.repeat(node >= depth, size)
        out[live[deep]] = True
        rest = ~deep
        sym = own[rest, np.repeat(node, size)[rest]]
        live, g = live[rest], np.repeat(np.arange(len(size)), size)[rest]
        order = np.lexsort((sym, g))
        live, g, sym = live[order], g[order], sym[order]
        if len(g):
            g = np.cumsum(np.append(0, (g[1:] != g[:-1]) | (sym[1:] != sym[:-1])))
    return out


def subtrees(sym: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    return deep_leaves(sym[start[:, None] + np.arange(length)], group)


def kind(window: int = WINDOW) -> Kind:
    return Kind(window, max(1, window * 16 // 35), lambda raw: b" ".join(raw.split()), word_symbols, lambda sym: sym, bytes.split, b" ".join, word_numbers, subtrees)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by one space)."""

    def digest(doc_id: int | None, words: list[bytes], s: np.ndarray, e: np.ndarray) -> tuple:
        kept = [w for x, y in zip(np.append(0, e), np.append(s, len(words)), strict=True) for w in words[x:y]] if len(s) else words
        text = b" ".join(kept)
        return doc_id, len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode()

    return apply_spans(docs, kind(window), digest, {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.string()})

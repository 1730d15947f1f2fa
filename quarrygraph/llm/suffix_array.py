"""Substring dedup over bytes by deep-shallow suffix sorting.

Texts are UTF-8 bytes. The suffixes that could repeat (see ``windows``), cut at ``window`` bytes, are sorted group by group: multikey
partitioning by symbols of eight bytes orders them to a shallow depth, and blind tries order those that are still tied.
Neighbours in that order that share ``window`` bytes are repeats.

Defined results: a null text is empty; a text shorter than a window loses nothing; rows that repeat a text are
documents of their own, so all their windows repeat; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarrygraph.llm.common import mix
from quarrygraph.llm.windows import Kind, apply_spans

WINDOW = 200
#: Bytes that multikey partitioning looks at before blind tries take over.
SHALLOW = 32
#: A fixed random value for each byte, for the hashes that choose minimisers.
BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def byte_symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, None, None]:
    return data, off, None, None


def byte_numbers(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(contexts) + bytes(8), np.uint8), np.cumsum([0, *map(len, contexts)])[:-1]


def places(length: int) -> np.ndarray:
    """Where the symbols of a suffix start; the last one may lie over the one before it."""
    return np.unique(np.append(np.arange(0, max(1, length - 7), 8), max(0, length - 8)))


def blind_tries(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in order, group by group, and the symbols each shares with the one before it (0 for a group's first).

    Suffixes go into a group's trie in batches. A batch meets one leaf of its subtree, and each suffix is compared with that leaf only: the
    first symbol that differs, and its value, name the branch it goes to; suffixes of one branch are the next batch.
    A node keeps only its depth and the symbols of its branches, and equal suffixes end at the leaf.
    """
    n, depth = rows.shape
    order = np.argsort(group, kind="stable")
    shared = np.zeros(n, np.int64)
    at = np.arange(n)
    g = group[order]
    while len(at):
        start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        size = np.diff(np.append(start, len(g)))
        keep = np.repeat(size > 1, size)
        at, size = at[keep], size[size > 1]
        if not len(at):
            break
        start = np.cumsum(size) - size
        own = rows[order[at]]
        leaf = np.repeat(own[start], size, axis=0)
        differs = own != leaf
        skip = np.where(differs.any(1), differs.argmax(1), depth)
        pick = np.minimum(skip, depth - 1)
        sym = own[np.arange(len(at)), pick]
        side = np.where(skip == depth, 0, np.where(sym < leaf[np.arange(len(at)), pick], -1, 1))
        # Left of the leaf those that part from it early come first, right of it last.
        near = np.where(side > 0, -skip, skip)
        sym = np.where(side == 0, 0, sym)
        batch = np.repeat(np.arange(len(size)), size)
        by = np.lexsort((sym, near, side, batch))
        moved = order[at[by]]
        skip, side, sym, batch = skip[by], side[by], sym[by], batch[by]
        order[at] = moved
        new = np.append(True, (batch[1:] != batch[:-1]) | (side[1:] != side[:-1]) | (skip[1:] != skip[:-1]) | (sym[1:] != sym[:-1]))
        head = np.append(True, batch[1:] != batch[:-1])
        inner = new & ~head
        shared[at[inner]] = np.minimum(skip[inner], skip[np.flatnonzero(inner) - 1])
        equal = ~new & (side == 0)
        shared[at[equal]] = depth
        g = np.cumsum(new)
        go = side != 0
        at, g = at[go], g[go]
    return order, shared


def deep_shallow(data: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, group by group, and how many of their symbols each shares with the one before it. ``data`` ends with eight spare bytes."""
    word = np.ndarray((len(data) - 7,), ">u8", data.tobytes(), strides=(1,))
    at = places(length)

    def symbol(of: np.ndarray, k: int) -> np.ndarray:
        got = word[start[of] + at[k]].astype(np.uint64)
        return got >> np.uint64(8 * (8 - length)) if length < 8 else got

    order = np.argsort(group, kind="stable")
    shared = np.zeros(len(order), np.int64)
    live, g = np.arange(len(order)), group[order]
    shallow = min(SHALLOW // 8, len(at))
    for k in range(shallow):
        live, g = _tied(live, g)
        if not len(live):
            return order, shared
        sym = symbol(order[live], k)
        by = np.lexsort((sym, g))
        order[live] = order[live[by]]
        sym = sym[by]
        tied = np.append(False, (g[1:] == g[:-1]) & (sym[1:] == sym[:-1]))
        shared[live[tied]] = k + 1
        g = np.cumsum(~tied)
    live, g = _tied(live, g)
    if shallow < len(at) and len(live):
        members = order[live]
        rows = word[start[members][:, None] + at[shallow:]].astype(np.uint64)
        by, more = blind_tries(rows, g)
        order[live] = members[by]
        inside = np.append(False, g[1:] == g[:-1])
        shared[live[inside]] = shallow + more[inside]
    return order, shared


def _tied(live: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose group has others."""
    if not len(live):
        return live, g
    edge = np.append(True, g[1:] != g[:-1])
    alone = edge & np.append(edge[1:], True)
    return live[~alone], g[~alone]


def repeated(data: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes share ``length`` bytes with a neighbour in the order of their group."""
    order, shared = deep_shallow(data, start, group, length)
    as_before = shared == len(places(length))
    out = np.zeros(len(start), bool)
    out[order] = as_before | np.append(as_before[1:], False)
    return out


def kind(window: int = WINDOW) -> Kind:
    return Kind(window, max(1, window * 64 // 200), bytes, byte_symbols, lambda data: BYTE[data], bytes, bytes, byte_numbers, repeated)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""

    def digest(doc_id: int | None, raw: bytes, s: np.ndarray, e: np.ndarray) -> tuple:
        kept = b"".join(raw[x:y] for x, y in zip(np.append(0, e), np.append(s, len(raw)), strict=True)) if len(s) else raw
        return doc_id, len(raw), len(raw) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), kept

    columns = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}
    return apply_spans(docs, kind(window), digest, columns)

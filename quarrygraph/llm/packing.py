"""Best-fit packing of token sequences by bulk-synchronous rounds.

Documents are tokenised, closed with an end id, and cut into pieces of at most ``capacity`` ids. In each round gaps and pieces are
range-sorted by size, and every range is swept from the largest to the smallest: a piece takes its successor among the gaps, the smallest one it
fits; where several pieces have the same successor, ranks decide, the largest piece first. What a range leaves is paired with what
other ranges leave in the same way, by prefix sums over the ranges. Gaps are updated, and the next round follows until all pieces are placed;
pieces that fit no gap open sequences. A state of few rows is finished by the same rounds in one task.

Defined results: a null or empty text is the end id alone; rows that repeat are packed as rows of their own; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.llm.common import column, materialize, release, texts, tune

CAPACITY, END_ID = 1024, 2
#: Characters sent to the tokenizer at once.
TOKENIZE_CHARS = 1 << 19
#: Pieces and gaps that one task takes through all their rounds.
TASK_ROWS = 20_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: How byte-level BPE splits a text, and the characters for which all regular-expression engines agree about that (white
#: space and printable ASCII, and the letters and signs from U+00A1 up to Cyrillic).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = re.compile(r"[\t\n\x0b\x0c\r\x20-\x7e\xa1-\u052f]*")
#: Characters of a run without white space from which the tokenizer itself is asked.
LONG_RUN = re.compile(r"\S{5000}")


def byte_alphabet() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte: itself if printable, else the next one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a tokenizer file. A plain byte-level BPE whose merges are in the order of its ids is also run by a faster library, which gives
    the same ids for texts of ``PLAIN`` characters without special tokens; all other texts go to the tokenizer itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.quick, self.special = None, ()
        spec = json.loads(Path(path).read_text())
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        odd = spec.get("normalizer") or spec.get("post_processor") or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not odd:
            self.special = tuple(t["content"] for t in spec.get("added_tokens", []))
            byte, vocab = byte_alphabet(), model["vocab"]
            merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
            if all(vocab.get(x + y) == 256 + i for i, (x, y) in enumerate(merged)):
                import tiktoken

                ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in self.special}
                self.quick = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts_: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts_)
        rest = []
        for i, t in enumerate(texts_):
            if self.quick is not None and PLAIN.fullmatch(t) and not any(s in t for s in self.special) and not LONG_RUN.search(t):
                out[i] = self.quick.encode_to_numpy(t, allowed_special=set(), disallowed_special=())
            else:
                rest.append(i)
        for i, e in zip(rest, self.whole.encode_batch_fast([texts_[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        return out


_loaded: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def pieces_of(docs: DataFrame, capacity: int, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoder(tokenizer)
        for b in batches:
            docs_, texts_ = column(b, "doc_id").to_pylist(), [x or "" for x in column(b, "text").to_pylist()]
            i = 0
            while i < len(texts_):
                j, size = i, 0
                while j < len(texts_) and (j == i or size + len(texts_[j]) <= TOKENIZE_CHARS):
                    size += len(texts_[j])
                    j += 1
                out: list[tuple] = []
                for doc, got in zip(docs_[i:j], encoder.ids(texts_[i:j]), strict=True):
                    ids = np.append(got, np.uint32(end_id)).astype("<u4")
                    raw, first = memoryview(ids.tobytes()), len(ids) % capacity or min(capacity, len(ids))
                    edge = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (s, e) in enumerate(zip(edge, edge[1:], strict=False)):
                        out.append((doc, k, s, e - s, zlib.crc32(raw[4 * s : 4 * e])))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
                i = j

    return texts(docs).mapInArrow(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep(kind: list[int], size: list[int], id_: list[int]) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Of gaps (kind 0) and pieces (1) from the largest to the smallest, gaps first among equals: pairs (piece, gap) of places, and the pieces and
    gaps that are left. A piece takes its successor, the smallest gap it fits that no larger piece has taken: the last one seen."""
    open_: list[int] = []
    pairs, alone = [], []
    for i, k in enumerate(kind):
        if not k:
            open_.append(i)
        elif open_:
            pairs.append((i, open_.pop()))
        else:
            alone.append(i)
    return pairs, alone, open_


_SWEPT = {"part": pa.int32(), "kind": pa.int32(), "size": pa.int32(), "id": pa.int64(), "mate": pa.int64(), "gap": pa.int32(), "nth": pa.int32()}


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sweep over one range: its pairs, and numbered, what other ranges may pair."""
    t = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if t is None:
        return
    kind, size, id_ = (t[x].to_pylist() for x in ("kind", "size", "id"))
    pairs, alone, open_ = sweep(kind, size, id_)
    part = TaskContext.get().partitionId()
    rows = [(part, 1, size[i], id_[i], id_[g], size[g], None) for i, g in pairs]
    rows += [(part, 1, size[i], id_[i], None, None, n) for n, i in enumerate(alone)]
    rows += [(part, 0, size[g], id_[g], None, None, n) for n, g in enumerate(open_)]
    for i in range(0, len(rows), 8192):
        yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*rows[i : i + 8192], strict=True), _SWEPT.values(), strict=True)], names=list(_SWEPT))


def _finished(capacity: int):
    """All rounds of a state that fits one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, size, id_ = ([x for c in each for x in c] for each in zip(*([b.column(i).to_pylist() for i in range(3)] for b in batches), strict=True)) if (batches := list(batches)) else ([], [], [])
        state = list(zip(kind, size, id_, strict=True))
        out: list[tuple[int, int, int]] = []
        while any(k for k, _, _ in state):
            state.sort(key=lambda x: (-x[1], x[0], x[2]))
            pairs, alone, open_ = sweep(*(list(c) for c in zip(*state, strict=True)))
            out += [(state[i][2], state[g][2], capacity - state[g][1]) for i, g in pairs]
            n = 0 if pairs else -(-sum(state[i][1] for i in alone) // capacity)
            out += [(state[i][2], state[i][2], 0) for i in alone[:n]]
            least = min((state[i][1] for i in alone[n:]), default=capacity + 1)
            rest = [(0, state[g][1] - state[i][1], state[g][2]) for i, g in pairs] + [state[g] for g in open_] + [(0, capacity - state[i][1], state[i][2]) for i in alone[:n]]
            state = [x for x in rest if x[1] >= least] + [state[i] for i in alone[n:]]
        if out:
            yield pa.record_batch([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], names=["pid", "sid", "at"])

    return run


def best_fit(pieces: DataFrame, capacity: int) -> DataFrame:
    """(pid, sid, at) of pieces (pid, length): the sequence and the place there, by bulk-synchronous rounds; a sequence is named by its first piece."""
    spark = pieces.sparkSession
    # No two of the pieces over half a sequence fit one, so each opens its own.
    placed = [pieces.where(F.col("length") > capacity // 2).selectExpr("pid", "pid as sid", "0L as at")]
    small = F.col("length") <= capacity // 2
    state = pieces.select(small.cast("int").alias("kind"), F.when(small, F.col("length")).otherwise(capacity - F.col("length")).cast("int").alias("size"), F.col("pid").alias("id"))
    state = materialize(state.where("size > 0"))
    order = [F.desc("size"), F.asc("kind"), F.asc("id")]
    while state.count() > TASK_ROWS:
        swept = materialize(state.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_swept, "part int, kind int, size int, id long, mate long, gap int, nth int"))
        # One row a range: how many pieces and gaps it leaves, and so how many gaps are open before it.
        left = sorted(tuple(r) for r in swept.where("mate is null").groupBy("part").agg(F.sum("kind"), F.sum(1 - F.col("kind"))).collect())
        before = np.cumsum([0, *(g - p for _, p, g in left)])[:-1].tolist()
        names = "part int, pieces long, before long"
        offsets = F.broadcast(spark.createDataFrame([(part, p, b) for (part, p, _), b in zip(left, before, strict=True)], names))
        # What is left pairs across ranges like brackets: a gap opens a level and a piece closes it. A range crosses a level at most once each
        # way, so a level has two rows a range at most, and the row before a piece is its gap.
        level = F.expr("if(kind = 1, before - nth, before - pieces + nth + 1)").alias("level")
        levels = swept.where("mate is null").join(offsets, "part").select("part", "kind", "size", "id", level)
        w = Window.partitionBy("level").orderBy("part", F.desc("kind"))
        by = materialize(levels.select("kind", "size", "id", "level", F.lag("kind").over(w).alias("k"), F.lag("id").over(w).alias("mate"), F.lag("size").over(w).alias("gap"), F.lead("kind").over(w).alias("next")))
        pairs = swept.where("mate is not null").select("id", "size", "mate", "gap").unionByName(by.where("kind = 1 and k = 0").select("id", "size", "mate", "gap"))
        alone = by.where("kind = 1 and k is null")
        got = alone.agg(F.sum("size").alias("total"), F.min("size").alias("least")).first()
        # Where no piece fits any gap, as many sequences as the rest needs are opened by the largest pieces; alone ones have levels 0, -1, ...
        n = 0 if got.total is None or not pairs.isEmpty() else -(-got.total // capacity)
        opening = alone.where(f"-level < {n}")
        placed += [pairs.selectExpr("id as pid", "mate as sid", f"bigint({capacity} - gap) as at"), opening.selectExpr("id as pid", "id as sid", "0L as at")]
        if got.least is None:
            state = state.limit(0)
            break
        gaps = pairs.selectExpr("0 as kind", "gap - size as size", "mate as id").unionByName(by.where("kind = 0 and next is null").select("kind", "size", "id")).unionByName(opening.selectExpr("0 as kind", f"{capacity} - size as size", "id"))
        # A gap below all pieces stays as it is.
        after = materialize(gaps.where(f"size >= {got.least}").unionByName(alone.where(f"-level >= {n}").select("kind", "size", "id")))
        release(spark, state)
        state = after
    placed.append(state.coalesce(1).mapInArrow(_finished(capacity), "pid long, sid long, at long"))
    out = placed[0]
    for x in placed[1:]:
        out = out.unionByName(x)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    tune(docs.sparkSession)
    pieces = materialize(pieces_of(docs, capacity, tokenizer or default_tokenizer(), end_id).withColumn("pid", F.monotonically_increasing_id()))
    placed = best_fit(pieces.select("pid", "length"), capacity)
    return pieces.join(placed, "pid").selectExpr("doc_id", "piece", "start", "length", "ids_crc32", "sid as sequence_id", "at as offset")

"""Reversible line dedup: sharded cuckoo filters over exact reference-count tables.

A line's key is the line stripped of white space at both ends with A-Z lower-cased. ``LineIndex`` counts, for each key
(by a 128-bit hash), the documents that hold it and the largest doc_id among them. The filter of a shard
holds the keys whose count has reached the threshold: inserting documents inserts keys that reach it, deleting documents
deletes keys that fall below it, so the index after any insertions and deletions equals one built afresh.

Defined results: a null or empty text is one empty line; rows that repeat a doc_id count as documents of their
own and share its fate; a null doc_id keeps a line only if no document with an id has it; an empty table gives an empty
table; other columns pass through ``dedup_lines`` and are ignored by the index. A shard's filter goes to the keys of that shard, by broadcast
or by a shuffle, and the exact table decides about the keys that pass.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.llm.common import NULL_ID, WS, column, ids, materialize, mix, release, texts, tune, unused

MIN_CHARS, MIN_DOCS = 40, 5
#: Filters of all shards together beyond this many bytes are not broadcast; they go to their keys by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Keys a shard should hold; an index of twice as many is dealt anew.
SHARD_KEYS = 200_000
#: Parts of a shard's keys in a shuffle, each with its own copy of the filter, so that a line of very many documents is no hot group.
PARTS = 32


class CuckooFilter:
    """16-bit fingerprints in buckets of four; supports deletion. Full, it asks for a larger one by returning False."""

    def __init__(self, capacity: int, slots: np.ndarray | None = None):
        n = 1 << max(2, int(capacity / (4 * 0.8)).bit_length())
        self.slots = np.zeros((n, 4), np.uint16) if slots is None else slots.copy()

    @classmethod
    def of(cls, blob: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(blob, np.uint16).reshape(-1, 4))

    def blob(self) -> bytes:
        return self.slots.tobytes()

    def _where(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = key.view(np.uint64)
        mask = np.uint64(len(self.slots) - 1)
        print_ = ((key >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        a = mix(key) & mask
        return print_, a.astype(np.int64), (a ^ (mix(print_.astype(np.uint64)) & mask)).astype(np.int64)

    def contains(self, key: np.ndarray) -> np.ndarray:
        p, a, b = self._where(key)
        return (self.slots[a] == p[:, None]).any(1) | (self.slots[b] == p[:, None]).any(1)

    def insert(self, key: np.ndarray) -> bool:
        p, a, b = self._where(key)
        mask = len(self.slots) - 1
        for f, i, j in zip(p.tolist(), a.tolist(), b.tolist(), strict=True):
            for at in (i, j):
                free = np.flatnonzero(self.slots[at] == 0)
                if len(free):
                    self.slots[at, free[0]] = f
                    break
            else:
                for kick in range(500):
                    f, self.slots[i, kick % 4] = int(self.slots[i, kick % 4]), f
                    i ^= int(mix(np.array([f], np.uint64))[0]) & mask
                    free = np.flatnonzero(self.slots[i] == 0)
                    if len(free):
                        self.slots[i, free[0]] = f
                        break
                else:
                    return False
        return True

    def delete(self, key: np.ndarray) -> None:
        p, a, b = self._where(key)
        for f, i, j in zip(p.tolist(), a.tolist(), b.tolist(), strict=True):
            for at in (i, j):
                found = np.flatnonzero(self.slots[at] == f)
                if len(found):
                    self.slots[at, found[0]] = 0
                    break


def key_of(line: str, min_chars: int) -> bytes | None:
    line = line.strip(WS)
    return line.encode().lower() if len(line) >= min_chars else None


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS, passing: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(hi, lo, did): the distinct long keys of each row, or such as pass."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            did = ids(column(b, "doc_id"))
            hash_, owner = [], []
            for i, text in enumerate(column(b, "text").to_pylist()):
                if not text or len(text) < min_chars:
                    continue
                found = {xxhash.xxh3_128_digest(k) for line in text.split("\n") if len(line) >= min_chars and (k := key_of(line, min_chars))}
                hash_.extend(found)
                owner.extend([i] * len(found))
            if owner:
                h = np.frombuffer(b"".join(hash_), ">i8").reshape(-1, 2).astype(np.int64)
                out = pa.record_batch([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(did[owner])], names=["hi", "lo", "did"])
                yield out if passing is None else out.filter(pa.array(passing(h[:, 0], h[:, 1])))

    return texts(docs).mapInArrow(rows, "hi long, lo long, did long")


class LineIndex:
    """Reference counts ``refs(shard, hi, lo, n, keeper)``, ``filters(shard, filter)`` and, if reversible, ``postings(hi, lo, did)``."""

    def __init__(self, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, reversible: bool = True):
        self.min_chars, self.min_docs, self.reversible = min_chars, min_docs, reversible
        self.refs: DataFrame | None = None
        self.postings: DataFrame | None = None
        self.filters: DataFrame | None = None
        self.shards = 0

    def insert(self, docs: DataFrame) -> LineIndex:
        tune(docs.sparkSession)
        keys = line_keys(docs, self.min_chars)
        if self.reversible:
            keys = materialize(keys)
            self.postings = keys if self.postings is None else self.postings.unionByName(keys)
        return self._merge(keys.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("did").alias("keeper")))

    def delete(self, docs: DataFrame) -> LineIndex:
        """Take documents out again, given as they were inserted. Keepers of the keys they held are chosen anew."""
        if not self.reversible or self.postings is None or self.refs is None:
            raise ValueError("only a reversible, filled index can delete")
        gone = materialize(line_keys(docs, self.min_chars))
        minus = gone.groupBy("hi", "lo", "did").agg(F.count("*").alias("m"))
        counted = self.postings.groupBy("hi", "lo", "did").agg(F.count("*").alias("c"))
        left = counted.join(minus, ["hi", "lo", "did"], "left").selectExpr("hi", "lo", "did", "c - coalesce(m, 0) as c").where("c > 0")
        self.postings = materialize(left.selectExpr("hi", "lo", "did", "explode(array_repeat(1, int(c))) as x").drop("x"))
        touched = gone.groupBy("hi", "lo").agg((-F.count("*")).alias("n"))
        keepers = self.postings.join(touched.select("hi", "lo"), ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.max("did").alias("keeper"))
        return self._merge(touched.join(keepers, ["hi", "lo"], "left"), replace=True)

    def _merge(self, delta: DataFrame, replace: bool = False) -> LineIndex:
        if self.refs is None:
            merged = delta.selectExpr("hi", "lo", "n", "keeper", "0L as was")
        else:
            old = self.refs.selectExpr("hi", "lo", "n as was", "keeper as kept")
            keeper = "if(n is null, kept, keeper)" if replace else "greatest(keeper, kept)"
            merged = old.join(delta, ["hi", "lo"], "full").selectExpr("hi", "lo", "coalesce(was, 0) + coalesce(n, 0) as n", f"{keeper} as keeper", "coalesce(was, 0) as was").where("n > 0 or was > 0")
        # A key below the threshold can matter only to a later insertion, so an index built once drops it.
        merged = materialize(merged if self.reversible else merged.where(f"n >= {self.min_docs}"))
        release(merged.sparkSession)
        want = max(1, merged.where(f"n >= {self.min_docs}").count() // SHARD_KEYS)
        if want >= 2 * self.shards:
            self.shards, self.filters = want, None
        shard = F.pmod(F.col("hi"), F.lit(self.shards)).cast("int").alias("shard")
        self.refs = merged.where("n > 0").select(shard, "hi", "lo", "n", "keeper")
        turned = merged.where(f"(n >= {self.min_docs}) <> (was >= {self.min_docs})" if self.filters is not None else f"n >= {self.min_docs}").select(shard, "lo", (F.col("n") >= self.min_docs).alias("up"))
        self.filters = materialize(self._turn(turned))
        return self

    def _turn(self, turned: DataFrame) -> DataFrame:
        """The filters after the keys that crossed the threshold went in or out; a full one is built anew from the exact table."""
        schema, least = "shard int, filter binary", self.min_docs

        def fresh(shard: int, lo: np.ndarray) -> pd.DataFrame:
            room = max(64, len(lo))
            while not (f := CuckooFilter(room)).insert(lo):
                room *= 2
            return pd.DataFrame({"shard": [shard], "filter": [f.blob()]})

        if self.filters is None:
            return turned.groupBy("shard").applyInPandas(lambda k, x: fresh(k[0], x["lo"].to_numpy()), schema)
        now = self.refs.where(F.col("n") >= least).select("shard", "lo")
        held = self.filters.join(now.groupBy("shard").agg(F.collect_list("lo").alias("all")), "shard", "full")

        def update(k: tuple, x: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            everything = np.array([] if not len(own) or own["all"].iloc[0] is None else own["all"].iloc[0], np.int64)
            if not len(own) or own["filter"].iloc[0] is None:
                return fresh(k[0], everything)
            f = CuckooFilter.of(own["filter"].iloc[0])
            f.delete(x.loc[~x["up"].astype(bool), "lo"].to_numpy(np.int64))
            if not f.insert(x.loc[x["up"].astype(bool), "lo"].to_numpy(np.int64)):
                return fresh(k[0], everything)
            return pd.DataFrame({"shard": [k[0]], "filter": [f.blob()]})

        return turned.groupBy("shard").cogroup(held.groupBy("shard")).applyInPandas(update, schema)

    def drops(self, docs: DataFrame) -> DataFrame:
        """(did, keys array<struct<hi,lo>>): the keys whose lines each document loses."""
        size = self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
        if size <= BROADCAST_BYTES:
            filters = {r["shard"]: CuckooFilter.of(bytes(r["filter"])) for r in self.filters.collect()}
            held, shards = docs.sparkSession.sparkContext.broadcast(filters), self.shards

            def passing(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
                ok = np.zeros(len(hi), bool)
                of = hi % shards
                for s in np.unique(of):
                    if s in held.value:
                        ok[of == s] = held.value[s].contains(lo[of == s])
                return ok

            keys = line_keys(docs, self.min_chars, passing)
        else:
            keys = self._passing_by_shard(line_keys(docs, self.min_chars))
        exact = self.refs.where(F.col("n") >= self.min_docs).select("hi", "lo", "keeper")
        return keys.join(exact, ["hi", "lo"]).where("did <> keeper").groupBy("did").agg(F.collect_set(F.struct("hi", "lo")).alias("keys"))

    def _passing_by_shard(self, keys: DataFrame) -> DataFrame:
        """The keys that pass the filter of their shard: a task reads a filter and then the keys sorted behind it, one batch at a time."""
        part = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
        none = F.lit(None).cast("long")
        own = keys.select(F.pmod("hi", F.lit(self.shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("did"), F.lit(PARTS)).cast("int").alias("part"), F.lit(None).cast("binary").alias("filter"), "hi", "lo", "did")
        sent = self.filters.select("shard", part, "filter").select("shard", "part", "filter", none.alias("hi"), none.alias("lo"), none.alias("did"))

        def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, None
            for b in batches:
                blob = b.column(2)
                group = [(s, p) for s, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                ok = np.zeros(b.num_rows, bool)
                i = 0
                while i < b.num_rows:
                    if blob[i].is_valid:
                        at, held = group[i], CuckooFilter.of(blob[i].as_py())
                        i += 1
                        continue
                    j = i + 1
                    while j < b.num_rows and group[j] == group[i]:
                        j += 1
                    if at == group[i]:  # else no key of that shard is held by enough documents
                        ok[i:j] = held.contains(b.column(4).slice(i, j - i).to_numpy())
                    i = j
                yield b.select(["hi", "lo", "did"]).filter(pa.array(ok))

        both = own.unionByName(sent).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("filter").isNull())
        return both.mapInArrow(passing, "hi long, lo long, did long")

    def dedup(self, docs: DataFrame) -> DataFrame:
        """``docs`` with n_lines, n_dropped and kept_text (null where nothing goes); columns of these names are replaced."""
        docs, drops, least = docs.drop("n_lines", "n_dropped", "kept_text"), self.drops(docs), self.min_chars
        own, lost = unused(docs, "__did"), unused(docs, "__keys")
        joined = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID).cast("long"))).join(drops.select(F.col("did").alias(own), F.col("keys").alias(lost)), own, "left").drop(own)
        names = [f.name for f in docs.schema]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_lines long, n_dropped long, kept_text string"

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                total, gone, kept = [], [], []
                for text, keys in zip(column(b, "text").to_pylist(), column(b, lost).to_pylist(), strict=True):
                    lines = (text or "").split("\n")
                    total.append(len(lines))
                    if not keys:
                        gone.append(0)
                        kept.append(None)
                        continue
                    bad = {struct.pack(">qq", k["hi"], k["lo"]) for k in keys}
                    stay = []
                    for line in lines:
                        k = key_of(line, least)
                        if k is None or xxhash.xxh3_128_digest(k) not in bad:
                            stay.append(line)
                    gone.append(len(lines) - len(stay))
                    kept.append("\n".join(stay))
                cols = [b.column(b.schema.get_field_index(n)) for n in names]
                yield pa.record_batch([*cols, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[*names, "n_lines", "n_dropped", "kept_text"])

        return joined.mapInArrow(rows, schema)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text, from an index over these very documents."""
    return LineIndex(min_chars, min_docs, reversible=False).insert(docs).dedup(docs)


def digest(df: DataFrame) -> DataFrame:
    kept = F.coalesce(F.col("kept_text"), F.col("text"), F.lit(""))
    return df.select("doc_id", "n_lines", "n_dropped", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))

"""Exact dedup by deterministic block naming.

A text without its white space is cut into blocks of ``BLOCK`` bytes. Distinct blocks, sorted within
hash partitions, get integer names; then adjacent names are paired and distinct pairs named, again and
again, until a document has one name. Names are injective in every round, so equal (rounds, name) means
equal texts, without any chance of a collision.

A block gets a number in each task, and travels to the task that names it once for each task (once a batch where more than
``KNOWN`` others came between); its places stay behind and are joined with the name by that number. So a block that a third of all
documents share is a row a task, not a row a document.

Defined results: null counts as empty, and all empty texts are equal; among equal texts the row with the most code
points in its original stays, then the smallest doc_id (null last), then the first row read; rows that repeat
are rows of their own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.llm.common import WS, column, materialize, release, spans, texts, tune, utf8

BLOCK = 1024
#: Bits of a counter beside a partition's number in a name or row number.
COUNTER = 36
#: Blocks whose numbers a task remembers: 4 MB.
KNOWN = 4096
_META = "doc_id long, chars long, sha string"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bid, block, places): each distinct block of a batch once, with where it stands; a row's first place carries the row's facts.
    A block that the task has sent with that number before is null."""
    uid = bid = TaskContext.get().partitionId() << COUNTER
    known: dict[bytes, int] = {}
    space = WS.encode()
    for b in batches:
        data, off = utf8(column(b, "text"))
        raw = data.tobytes()
        flat = [raw[off[i] : off[i + 1]].translate(None, space) for i in range(len(off) - 1)]
        if not flat:
            continue
        size = np.array([len(x) for x in flat])
        sha = np.array([hashlib.sha256(x).hexdigest() for x in flat], object)
        n = np.maximum(1, -(-size // BLOCK))
        row, i = np.repeat(np.arange(len(n)), n), spans(n)
        base = np.cumsum(size) - size
        ends = np.append(0, base[row] + np.minimum((i + 1) * BLOCK, size[row]))
        blocks = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(b"".join(flat))])
        coded = blocks.dictionary_encode()
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        row, i = row[order], i[order]
        rest = i > 0
        chars = pc.fill_null(pc.utf8_length(column(b, "text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        doc = pc.take(column(b, "doc_id"), pa.array(row))
        place = pa.StructArray.from_arrays(
            [pa.array(uid + row), pa.array(i), pa.array(n[row]), pc.if_else(pa.array(rest), pa.scalar(None, pa.int64()), doc), pa.array(chars[row], mask=rest), pa.array(sha[row], pa.string(), mask=rest)],
            names=["uid", "i", "n", "doc_id", "chars", "sha"],
        )
        edge = np.append(np.flatnonzero(np.append(True, np.diff(code[order]) != 0)), len(order))
        bids, sent = [], []
        for block in coded.dictionary.to_pylist():
            if block in known:
                known[block] = known.pop(block)  # the last one used
                sent.append(None)
            else:
                known[block] = bid
                bid += 1
                sent.append(block)
                if len(known) > KNOWN:
                    del known[next(iter(known))]
            bids.append(known[block])
        yield pa.record_batch([pa.array(bids), pa.array(sent, pa.binary()), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), place)], names=["bid", "block", "places"])
        uid += len(n)


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the distinct blocks of a sorted partition."""
    name, last = (TaskContext.get().partitionId() << COUNTER) - 1, None
    for b in batches:
        if not b.num_rows:
            continue
        block = b.column(1)
        new = np.ones(b.num_rows, bool)
        new[1:] = pc.not_equal(block.slice(1), block.slice(0, len(block) - 1)).to_numpy(zero_copy_only=False)
        new[0] = last is None or block[0].as_py() != last
        last = block[len(block) - 1].as_py()
        names = name + np.cumsum(new)
        name = int(names[-1])
        yield pa.record_batch([b.column(0), pa.array(names)], names=["bid", "name"])


def identities(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, chars, sha, level, name): equal (level, name) exactly where the texts are equal. Written to the shared folder."""
    spark = docs.sparkSession
    tune(spark)
    blocks = texts(docs).mapInArrow(_blocks, f"bid long, block binary, places array<struct<uid:long,i:long,n:long,{_META.replace(' ', ':').replace(',:', ',')}>>")
    blocks = materialize(blocks)
    names = blocks.where("block is not null").select("bid", "block").repartition("block").sortWithinPartitions("block").mapInArrow(_names, "bid long, name long")
    named = materialize(blocks.select("bid", "places").join(names, "bid").selectExpr("inline(places)", "name"))
    release(spark, blocks)
    level, cur, done, old = 0, named.select("uid", "i", "n", "name"), [named.where("n = 1").selectExpr("uid", "0 as level", "name")], []
    most = named.agg(F.max("n")).first()[0] or 1
    while most > 1:
        level, most = level + 1, -(-most // 2)
        pairs = cur.where("n > 1").groupBy("uid", F.expr("i div 2").alias("i"), F.expr("(n + 1) div 2").alias("n")).agg(F.max(F.expr("if(i % 2 = 0, name, null)")).alias("a"), F.coalesce(F.max(F.expr("if(i % 2 = 1, name, null)")), F.lit(-1)).alias("b"))
        names = materialize(pairs.select("a", "b").distinct().sortWithinPartitions("a", "b").withColumn("name", F.monotonically_increasing_id()))
        cur = materialize(pairs.join(names, ["a", "b"]).select("uid", "i", "n", "name"))
        release(spark, names)
        done.append(cur.where("n = 1").selectExpr("uid", f"{level} as level", "name"))
        old.append(cur)
    final = done[0]
    for d in done[1:]:
        final = final.unionByName(d)
    out = materialize(named.where("i = 0").select("uid", "doc_id", "chars", "sha").join(final, "uid"))
    release(spark, named, *old)
    return out


def exact_groups(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    ident = identities(docs)
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("best")
    groups = materialize(ident.groupBy("level", "name").agg(F.count("*").alias("group_size"), best))
    return ident.join(groups, ["level", "name"]).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), F.col("sha").alias("text_sha256"))

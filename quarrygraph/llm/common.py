"""Shared plumbing of the training-data operators.

Materialised tables go below the folder named by ``spark.checkpoint.dir``, which driver and
executors share; a folder of our own is made only where that setting is absent (tests).
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.ship import ship

#: White space of every contract here: space and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"
#: Stands for a null doc_id in join keys; the text hash beside it keeps it apart from a real one.
NULL_ID = -(2**63)
_written: dict[str, SparkSession] = {}


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small, as a batch of long documents must fit beside the JVM heap, and send executors this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))
    ship(spark)


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quarrygraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarrygraph/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._quarrygraph_path = path
    return out


def release(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, and let Spark drop the shuffle files of finished phases."""
    for df in frames:
        path = getattr(df, "_quarrygraph_path", None)
        if path and _written.pop(path, None):
            _delete(spark, path)
    gc.collect()
    spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session is gone; nothing is left to delete with
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text) with nothing else, whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with lines behind it what no column of ``df`` is called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and the n + 1 offsets into them. Null counts as empty."""
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) else "")
    arr = arr.cast(pa.large_binary())
    off = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8) if len(arr) else np.zeros(1, np.int64)
    data = arr.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def ids(arr: pa.Array) -> np.ndarray:
    return pc.fill_null(arr, NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows out of sorted batches that never cut a group of equal ``keys``; each row is copied once."""
    held: list[pa.Table] = []
    n = 0
    last: list = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if n >= rows:
            same = np.ones(t.num_rows, bool)
            for k, v in zip(keys, last, strict=True):
                same &= pc.equal(t[k], v).to_numpy(zero_copy_only=False)
            cut = t.num_rows if same.all() else int(same.argmin())
            if cut < t.num_rows:
                yield pa.concat_tables([*held, t.slice(0, cut)]).combine_chunks()
                held, n, t = [], 0, t.slice(cut)
        held.append(t)
        n += t.num_rows
        last = [t[k][t.num_rows - 1] for k in keys]
    if n:
        yield pa.concat_tables(held).combine_chunks()


def spans(sizes: np.ndarray) -> np.ndarray:
    """0..sizes[0]-1, 0..sizes[1]-1, ... in one array."""
    sizes = np.asarray(sizes, np.int64)
    total = int(sizes.sum())
    return np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chained(h: np.ndarray, start: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` (``most`` at most) consecutive values of ``h`` from each start; not linear in any of them."""
    out = mix(np.asarray(size).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for k in range(most):
        on = size > k
        if on.all():
            out = mix(out + h[start + k])
        else:
            out[on] = mix(out[on] + h[start[on] + k])
    return out


#: Span hashes are polynomials over the field of this prime (a Mersenne prime), at a fixed point drawn at random.
PRIME = np.uint64(2**61 - 1)
POINT = 0x16B7D1E9A35C8F27
_LOW31 = np.uint64(2**31 - 1)
_LOW30 = np.uint64(2**30 - 1)


def folded(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products in the field of ``PRIME``."""
    ah, al, bh, bl = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    mid = ah * bl + al * bh
    return folded(np.uint64(2) * ah * bh + (mid >> np.uint64(30)) + ((mid & _LOW30) << np.uint64(31)) + al * bl)


#: Symbols that one step of ``span_hashes`` looks at.
STEP = 1 << 15
_powers: dict[int, np.ndarray] = {}


def powers(point: int) -> np.ndarray:
    """The first ``STEP`` powers of a point."""
    if point not in _powers:
        out = np.ones(1, np.uint64)
        while len(out) < STEP:
            out = np.concatenate([out, times(out, np.uint64(pow(point, len(out), int(PRIME))))])
        _powers[point] = out
    return _powers[point]


def span_hashes(sym: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    """64-bit hashes of spans of symbols below 2**bits, the same wherever a span stands; spans are in order and do not overlap."""
    out = np.zeros(len(starts), np.uint64)
    size = ends - starts
    most = min(STEP, 1 << (32 - bits))  # sums of longer spans would overflow
    for i in np.flatnonzero(size > most):
        out[i] = xxhash.xxh3_64_intdigest(sym[starts[i] : ends[i]].tobytes())
    short = np.flatnonzero(size <= most)
    starts, ends = starts[short], ends[short]
    up, down = powers(POINT), powers(pow(POINT, -1, int(PRIME)))
    low, high = up & _LOW31, up >> np.uint64(31)
    i = 0
    while i < len(short):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + STEP, "right")))
        x = sym[lo : int(ends[j - 1])].astype(np.uint64) + np.uint64(1)
        a, b = np.zeros(len(x) + 1, np.uint64), np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * low[: len(x)], out=a[1:])
        np.cumsum(x * high[: len(x)], out=b[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        a, b = a[e] - a[s], folded(b[e] - b[s])
        # b stands 31 bits higher.
        b = (b >> np.uint64(30)) + ((b & _LOW30) << np.uint64(31))
        out[short[i:j]] = times(folded(folded(a) + b), down[s])
        i = j
    return mix(out + np.uint64(0x9E3779B97F4A7C15))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all runs without white space, no run crossing a document, and the first word of each document (n + 1)."""
    lo, hi = int(off[0]), int(off[-1])
    d = data[lo:hi]
    n = len(d)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~_SPACE[d]
    cut = np.zeros(n + 1, bool)
    cut[off - lo] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    return starts + lo, ends + lo, np.searchsorted(starts, off - lo)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    return span_hashes(data, starts, ends, 8)


def doc_chunks(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes; a longer document stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)

"""Shared pieces of the training-data operators: tables written in the shared
folder, vectorised word hashing, and connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import os
import re
import tempfile
import time
import uuid
import weakref
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text hashed at one go; temporaries are some ten times that.
SLICE_BYTES = 1 << 19
#: Up to so many edges one task runs union-find; beyond, star contraction over all executors.
LOCAL_EDGES = 400_000

#: Bytes of an Arrow batch that a Python worker takes at a time, about; one row is never split.
BATCH_BYTES = 16 << 20
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: A shuffled partition of prepared rows has about so many bytes.
PARTITION_BYTES = 32 << 20

_shipped: set[str] = set()
_written: list[tuple[weakref.ref, str]] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers when they cannot import it by path, and bound the bytes of an
    Arrow batch, where the session leaves that bound at its default: a batch of 10,000 long texts is large."""
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, BATCH_BYTES)
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p}
    if app in _shipped or str(root) in known or os.path.realpath(os.getcwd()) == str(root):
        return
    _shipped.add(app)
    to = Path(tempfile.mkdtemp()) / "sieveloom.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in (root / "sieveloom").rglob("*.py"):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(to))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and there are no other hosts."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        base = sc.getCheckpointDir()
    if base is None:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='sieveloom-')}"
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: lineage ends
    there, so that a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sieveloom-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    if not _written:
        atexit.register(drop_written)
    _written.append((weakref.ref(spark), path))
    return spark.read.schema(schema).parquet(path)


def partitions(df: DataFrame, times: float = 1.0) -> int:
    """How many partitions a shuffle of `times` the bytes of df should have: the session's number, or more for a large table."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(min(size, 1 << 60) * times) // PARTITION_BYTES)


def dealt(df: DataFrame, like: DataFrame, *keys: str, times: float = 1.0) -> DataFrame:
    """df dealt by keys, with all rows of a key in one partition: as many partitions as `like` calls for where that is more
    than the session's number; else the session's number, of which adaptive execution puts small ones together, so that
    a small table is a few files."""
    n = partitions(like, times)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


def release(spark: SparkSession) -> None:
    """Drop the shuffle files of finished steps now: Spark does so once their plans are collected, which the driver
    otherwise does when its own memory runs short, however full the executors' disks are."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def drop_written() -> None:
    """Remove the tables that cut() wrote; call it when their results are no longer needed."""
    while _written:
        ref, path = _written.pop()
        spark = ref()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; its folder goes with the cluster's clean-up
            return


def _trim() -> None:
    """Give the memory this process no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run):
    """A function on Arrow batches, whose worker gives its free memory back at the end of the task: Spark keeps idle
    workers for the next one, and each would else hold on to some hundred MB that none of them uses."""

    def to_the_end(batches):
        try:
            yield from run(batches)
        finally:
            _trim()

    return to_the_end


# ---- word hashing -------------------------------------------------------------------------

#: Words of more bytes are hashed by blake2b; shorter ones by a random number for each place and byte.
LONG = 48
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(0, 2**64, LONG * 256, dtype=np.uint64)
_STEP = 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, … count[0] of them, then those of the next."""
    total = int(count.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(count) - count
    return np.repeat(first - before, count) + np.arange(total)


def word_spans(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes as an array, and the start and end of each run that holds no ASCII white space."""
    a = np.frombuffer(buf, np.uint8)
    if not len(a):
        return a, np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.diff(np.concatenate([[False], ~_SPACE[a], [False]]).astype(np.int8))
    return a, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, none of them empty. Two given words of up to LONG bytes agree
    with probability 2**-64 over the choice of the table, whatever their structure."""
    size = ends - starts
    out = np.empty(len(starts), np.uint64)
    short = size <= LONG
    all_short = bool(short.all())
    s, n = (starts, size) if all_short else (starts[short], size[short])
    if len(s):
        before = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(before, n)
        sums = np.add.reduceat(_TABLE[(place << 8) + a[place + np.repeat(s, n)]], before)
        if all_short:
            return mix(sums)
        out[short] = mix(sums)
    for i in np.flatnonzero(~short).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(a[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words; entry i starts at word i. For short runs only: beyond a thousand
    words, sums of powers modulo 2**64 no longer tell all sequences apart."""
    n = len(words)
    if n < k or not k:
        return np.empty(0, np.uint64)
    out, size, part, width, left = None, 0, words, 1, k
    while True:  # runs of 1, 2, 4, … words, put together to k
        if left & 1:
            m = n - size - width + 1
            out = part[:m] if out is None else out[:m] + part[size : size + m] * np.uint64(pow(_STEP, size, 1 << 64))
            size += width
        left >>= 1
        if not left:
            return mix(out + np.uint64(k))
        part = part[:-width] + part[width:] * np.uint64(pow(_STEP, width, 1 << 64))
        width *= 2


def slices(texts: list, limit: int = SLICE_BYTES):
    """(first, last) index pairs that cut a list of bytes into runs of about `limit` bytes."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def word_hashes(text: bytes) -> np.ndarray:
    """The hashes of a text's words, from pieces of about SLICE_BYTES that end at white space."""
    out, at = [], 0
    while at < len(text):
        cut_at = _BLANK.search(text, at + SLICE_BYTES) if len(text) - at > SLICE_BYTES else None
        end = cut_at.start() if cut_at else len(text)
        out.append(span_hashes(*word_spans(text[at:end])))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def hashed_docs(texts: list[bytes], lower: bool = False):
    """For each run of texts: (first index, word hashes, borders); text first+j has the
    words borders[j]:borders[j+1]. Words are runs without the six ASCII white-space bytes.
    Temporaries are some ten times SLICE_BYTES, or the longest word, however long a text is."""
    for lo, hi in slices(texts):
        part = texts[lo:hi]
        if len(part) == 1:
            words = word_hashes(part[0].lower() if lower else part[0])
            yield lo, words, np.array([0, len(words)])
            continue
        buf = b"\n".join(part)
        a, s, e = word_spans(buf.lower() if lower else buf)
        at = np.cumsum([0] + [len(t) + 1 for t in part])
        yield lo, span_hashes(a, s, e), np.searchsorted(s, at)


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column as bytes; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


# ---- connected components -----------------------------------------------------------------


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, path = self.up, []
        while (p := up.get(x, x)) != x:
            path.append(x)
            x = p
        for y in path:
            up[y] = x
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True


def _union(batches):
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
    nodes = list(forest.up)
    yield pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array([forest.find(x) for x in nodes], pa.int64())], names=["node", "component"]
    )


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) for every node of `edges` (two long columns); component is the
    smallest node that can be reached. Null ends and loops are ignored. Edges that come from
    a function on Arrow batches are best cut() before: else each task has two Python workers.

    First every task contracts its own edges to stars. A graph of at most `local_edges`
    edges after that is finished by one task; a larger one by alternating large-star and
    small-star steps, each a grouped minimum and a join."""
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u != v")
    e = cut(e.mapInArrow(lean(_union), "u long, v long").where("u != v"))
    if e.count() <= local_edges:
        return cut(e.repartition(1).mapInArrow(lean(_union), "node long, component long"))
    last = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        e = cut(e.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u != v").distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == last:
            break
        last = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return cut(stars.union(stars.select("component", "component").distinct()))

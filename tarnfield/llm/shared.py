"""What the training-data operators share: the shared folder, and vectorised word splitting.

Python operators work on Arrow batches. A text column arrives as one contiguous
UTF-8 buffer; words are found and hashed with NumPy over that buffer, so no
Python string is made for a word.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import inspect
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WS = "[ \\t-\\r]+"
NOT_WS = "[^ \\t-\\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one vectorised pass works on; a longer text is a pass of its own.
PASS_BYTES = 1 << 20
BATCH_ROWS = 2000
#: Paths of working tables, in the order they were asked for.
WORK: list[str] = []


#: While a working table is written: Arrow batches of few rows, as texts are long and a batch is held in both the JVM
#: and Python; and shuffle files that go when the write is done, as nothing reads them again.
WHILE_WRITING = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir or the context's checkpoint folder.

    Where neither is set, one process that is driver and executor alike makes a folder of its own; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tarnfield-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


@contextlib.contextmanager
def set_for(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings, which are as they were afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def work_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tarnfield/{uuid.uuid4().hex}/{name}"
    WORK.append(path)
    return path


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes working tables that nothing reads any more, in whatever file system they are."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path).getParent()
        where.getFileSystem(conf).delete(where, True)


#: Seconds between the driver's collections, at least, and when it last collected.
COLLECT_EVERY = 5.0
_COLLECTED = [0.0]


def collect_garbage(spark: SparkSession) -> None:
    """Has the driver collect its garbage now and then: only then does Spark drop the broadcasts and shuffle files of steps that are done,
    and else the heap of a job of many steps grows as far as it may."""
    if time.monotonic() - _COLLECTED[0] >= COLLECT_EVERY:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _COLLECTED[0] = time.monotonic()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    with set_for(spark, WHILE_WRITING):
        df.write.parquet(path)
    collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path)


def stored_alone(df: DataFrame, name: str, since: int) -> DataFrame:
    """df stored; the working tables asked for since WORK had `since` entries go, as df needs them no more."""
    out = stored(df, name)
    gone = WORK[since:-1]
    remove(df.sparkSession, gone)
    del WORK[since:-1]
    return out


def discard(spark: SparkSession, since: int, *names: str) -> None:
    """Removes the working tables of these names that were asked for since WORK had `since` entries: nothing reads them any more."""
    gone = [p for p in WORK[since:] if p.rpartition("/")[2] in names]
    remove(spark, gone)
    WORK[since:] = [p for p in WORK[since:] if p not in gone]


def fresh(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no column of that name (Spark does not tell upper from lower case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. Texts of ASCII only take the JVM's fast path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def over_arrow(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """df.mapInArrow(run, schema) for columns of any name: within, they are numbered, as mapInArrow can't resolve a name with a dot."""
    numbered = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=numbered.names)

    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(renamed, numbered).toDF(*schema.names)


def blocks_of(spark: SparkSession) -> int:
    """How many blocks a table is dealt into: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


# ---------------------------------------------------------------- NumPy over Arrow buffers

_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _RNG.integers(1, 2**62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_RNG.integers(1, 2**60, dtype=np.uint64)) * 8 + 5
BASE_INV = pow(BASE, -1, 2**64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling; kept for the passes that follow."""
    have = _POWERS.get(base)
    if have is not None and len(have) >= n:
        return have[:n]
    size = 1 << max(n - 1, 1).bit_length()
    out = np.ones(size, np.uint64)
    filled, step = 1, base
    while filled < size:
        out[filled : 2 * filled] = out[:filled] * np.uint64(step)
        step, filled = step * step % 2**64, 2 * filled
    if size <= 4 * PASS_BYTES:
        _POWERS[base] = out
    return out[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums: the hash of data[a:b] is (s[b]-s[a]) * BASE_INV**a."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(BASE, len(data)), out=out[1:])
    return out


#: What empties a cache that an operator keeps in a worker for its own later tasks.
CACHES: dict[str, Callable[[], None]] = {}


def forget(user: str) -> None:
    """Empties the worker's caches but for those of the module `user`."""
    _POWERS.clear()
    for owner, empty in CACHES.items():
        if owner != user:
            empty()


def tidy(run: Callable) -> Callable:
    """run, after which the worker gives unused memory back: Spark keeps workers for tasks of other operators."""

    def released() -> None:
        forget(run.__module__)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def streamed(*args):
            yield from run(*args)
            released()

        return streamed

    def finished(out: pa.Table) -> pa.Table:
        released()
        return out

    # Spark counts a grouped function's parameters
    if len(inspect.signature(run).parameters) == 2:
        return lambda left, right: finished(run(left, right))
    return lambda table: finished(run(table))


@dataclass
class Words:
    """Words of a pass over some texts. doc: index of each word's text within the pass."""

    first: int
    n_docs: int
    data: np.ndarray
    bounds: np.ndarray  # n_docs + 1 byte offsets into data; texts are separated by one space
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    counts: np.ndarray  # words in each text


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks)
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if offs is not None and len(texts) else np.zeros(len(texts) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def passes(offsets: np.ndarray, size: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `size` bytes each."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def words(texts: pa.Array, lower: bool = True, size: int = PASS_BYTES) -> Iterator[Words]:
    """Words `[^\\x20\\x09-\\x0D]+` of every text, a pass at a time."""
    data, offsets = buffers(texts)
    for a, b in passes(offsets, size):
        n = b - a
        lens = offsets[a + 1 : b + 1] - offsets[a:b]
        bounds = np.zeros(n + 1, np.int64)
        np.cumsum(lens + 1, out=bounds[1:])
        buf = np.full(bounds[-1], 0x20, np.uint8)
        raw = data[offsets[a] : offsets[b]]
        at = np.ones(len(buf), bool)
        at[bounds[1:] - 1] = False
        buf[at] = LOWERED[raw] if lower else raw
        inside = ~IS_SPACE[buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[0::2], edge[1::2]
        sums = prefix_hash(buf)
        h = mix((sums[end] - sums[start]) * powers(BASE_INV, len(buf) + 1)[start])
        doc = np.searchsorted(bounds, start, "right") - 1
        yield Words(a, n, buf, bounds, start, end, doc, h, np.bincount(doc, minlength=n))


def rolled(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows that lie within one text, and the word at which each begins."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    at = np.flatnonzero(doc[: len(h) - k + 1] == doc[k - 1 :])
    return out[at], at


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, shingle hash) of every text's distinct k-word shingles, sorted; a text of fewer words has its whole sequence."""
    h, at = rolled(w.hash, w.doc, k)
    doc = w.doc[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        first = np.concatenate([[0], np.cumsum(w.counts)])
        whole = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = w.counts[short] > i
            whole[has] = mix(whole[has] * np.uint64(0x9E3779B97F4A7C15) + w.hash[first[short[has]] + i])
        h = np.concatenate([h, mix(whole + w.counts[short].astype(np.uint64))])
        doc = np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


# ---------------------------------------------------------------- packed arrays


def packed(x: np.ndarray, rising: bool = False) -> bytes:
    """Numbers as byte planes under Zstandard; rising ones as differences."""
    x = np.ascontiguousarray(x)
    if rising:
        x = np.diff(x, prepend=x.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def unpacked(b: bytes, kind: type, rising: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    x = np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if rising else x


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches laid together, or cut, to batches of about `rows` rows."""
    held, n = [], 0
    for batch in batches:
        for a in range(0, len(batch), rows):
            part = batch.slice(a, rows)
            held.append(part)
            n += len(part)
            if n >= rows:
                yield pa.concat_batches(held)
                held, n = [], 0
    if n:
        yield pa.concat_batches(held)


# ---------------------------------------------------------------- blocks of ascending ids


def id_bounds(documents: DataFrame, blocks: int) -> list[int]:
    """At most blocks - 1 ids that cut the table into ranges of about as many rows."""
    if blocks < 2:
        return []
    probs = [i / blocks for i in range(1, blocks)]
    return sorted({int(x) for x in documents.where("doc_id is not null").select(F.col("doc_id").cast("double").alias("doc_id")).approxQuantile("doc_id", probs, 0.25 / blocks)})


def ordered_block(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds are at most doc_id, by binary search: blocks rise with the id. A null id is in the last block."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    table = F.array(*[F.lit(b).cast("long") for b in bounds])
    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda lo, s: F.when(F.get(table, lo + s - 1) <= doc_id.cast("long"), lo + s).otherwise(lo))
    return F.when(doc_id.isNull(), F.lit(len(bounds))).otherwise(found)

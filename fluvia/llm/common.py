"""Helpers shared by the training-data operators: shared storage, Arrow batches, Bloom filters."""

from __future__ import annotations

import atexit
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one string column that a Python worker handles at a time.
SLICE_BYTES = 2 << 20
#: A Bloom filter never has more bits (32 MB), whatever the data.
MAX_BLOOM_BITS = 1 << 28

_made: dict[str, SparkSession] = {}
_memos: dict[str, dict] = {}


def memo(name: str | None) -> dict:
    """What a Python worker remembers for the operator ``name`` between its tasks. A worker serves several
    operators one after the other; the others' memories are given up, so that one is held at a time.
    A dictionary in a memory is emptied, as others can hold it too."""
    for other in [k for k in _memos if k != name]:
        for held in _memos.pop(other).values():
            if isinstance(held, dict):
                held.clear()
    return {} if name is None else _memos.setdefault(name, {})


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured and driver
    and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    root = f"{root.rstrip('/')}/fluvia-{spark.sparkContext.applicationId}"
    if root not in _made:
        _made[root] = spark
    return root


@atexit.register
def _remove_made() -> None:
    for root, spark in _made.items():
        jvm = spark.sparkContext._jvm
        if spark.sparkContext._jsc is None or jvm is None:
            continue
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _safe_names(df: DataFrame, used: tuple[str, ...]) -> list[str]:
    columns = df.columns
    return [c if c in used and columns.index(c) == k else f"x{k}" for k, c in enumerate(columns)]


def safe(df: DataFrame, *used: str) -> DataFrame:
    """``df`` with the columns ``used`` under their own names and all others as x0, x1 and so on, by position:
    no name of the caller's, however it is spelled, can meet one that an operator makes. A name of
    ``used`` that two columns have means the first; names that differ in case are different ones."""
    return df.toDF(*_safe_names(df, used))


def restored(df: DataFrame, like: DataFrame, *used: str) -> DataFrame:
    """The columns of ``like`` from what was made of ``safe(like, *used)``, under their own names again."""
    return df.select(*_safe_names(like, used)).toDF(*like.columns)


def tidy() -> None:
    """Gives what a task has freed back to the system, as idle workers stay."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


#: Rows that Spark hands to a Python worker at once: texts can be long, so that its own 10,000 may not fit.
BATCH_ROWS = 2000
#: Bytes of such a batch, if it has more than one row: on both sides a batch is held whole.
BATCH_BYTES = 4 << 20


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with batches of BATCH_ROWS rows and about BATCH_BYTES at most (settings of the session);
    use with ``transform``."""
    spark = df.sparkSession
    conf, bytes_of = spark.conf, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    rows, size = (f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes"))
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))
    if not 0 < bytes_of(conf.get(size)) <= BATCH_BYTES:
        conf.set(size, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in parts of about ``limit`` bytes in ``column``: small batches are
    put together, large ones are cut; a part has one row at least."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, base + limit - size, side="right"))
            if stop == start and not held:
                stop = start + 1
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1] - base)
            start = stop
            if start < batch.num_rows or size >= limit:
                yield joined(held)
                held, size = [], 0
    if held:
        yield joined(held)
    held = []
    tidy()


def merged(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Small batches of numbers put together to about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= rows:
            yield joined(held)
            held, size = [], 0
    if held:
        yield joined(held)
    held = []
    tidy()


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def texts(array: pa.Array) -> list[str]:
    """Strings of a column; null counts as empty."""
    return pc.fill_null(array, "").to_pylist()


def raw(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return pc.fill_null(array.cast(pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()), b"").to_pylist()


def lower_ascii(col):
    """``col`` with A-Z lower-cased and nothing else; plain lower-casing is the same for ASCII texts, and quicker."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _positions(h: np.ndarray, bits: int, hashes: int = 4) -> list[np.ndarray]:
    """The bit numbers of 64-bit hashes, by double hashing."""
    h = h.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [(h + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(hashes)]


class Bloom:
    """A Bloom filter over the 64-bit hashes of a DataFrame's rows, held in 32 MB at most.

    It only ever saves work: what it lets through is checked exactly afterwards, so a full filter
    costs time, never rows. With more than 67 million keys there is none, and every row is let through.
    """

    def __init__(self, keys: DataFrame, key_hash, max_bits: int = MAX_BLOOM_BITS):
        """``key_hash``: a bigint column of ``keys``, such as ``F.xxhash64(...)``."""
        spark = keys.sparkSession
        n = keys.count()
        self.bits, self.shared = 0, None
        if 4 * n > max_bits:
            return  # so many keys would set nearly all bits: everything is let through, at no cost
        bits = 1 << 16
        while bits < 12 * n and bits < max_bits:
            bits *= 2

        def words(batches):
            for b in batches:
                h = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                at = np.concatenate(_positions(h, bits)) if len(h) else np.zeros(0, np.uint64)
                word, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
                value = np.zeros(len(word), np.uint64)
                np.bitwise_or.at(value, inverse, np.uint64(1) << (at & np.uint64(63)))
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], ["word", "value"])

        found = keys.select(key_hash.cast("bigint").alias("h")).transform(in_arrow, words, "word bigint, value bigint").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
        array = np.zeros(bits >> 6, np.uint64)
        array[found.column("word").to_numpy()] = found.column("value").to_numpy().view(np.uint64)
        self.bits, self.shared = bits, spark.sparkContext.broadcast(array.tobytes())

    def test(self):
        """A function from int64 hashes to booleans, for use in a Python worker."""
        return tester(self.bits, self.shared)

    def may_hold(self, key_hash):
        """A boolean column: false only for rows that the keys surely lack. Only the hash goes to Python."""
        bits, shared = self.bits, self.shared
        if not bits:
            return F.lit(True)

        @F.pandas_udf("boolean")
        def may_hold(h: pd.Series) -> pd.Series:
            return pd.Series(tester(bits, shared)(h.to_numpy(np.int64)))

        return may_hold(key_hash.cast("bigint"))


def tester(bits: int, shared) -> Callable[[np.ndarray], np.ndarray]:
    if not bits:
        return lambda h: np.ones(len(h), bool)
    array = np.frombuffer(shared.value, np.uint64)

    def test(h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in _positions(h.view(np.uint64), bits):
            out &= (array[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out

    return test


def gathered(pool: np.ndarray, start: np.ndarray, size: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The runs ``pool[start[c] : start[c] + size[c]]`` of all ``code``, one after the other."""
    n = size[code]
    total = np.cumsum(n)
    at = np.repeat(start[code] - (total - n), n)
    at += np.arange(len(at))
    return pool[at]


def id_lists(flat: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """A list<int32> array of ``n`` ids for each row."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(flat.astype("<i4")))


def id_bytes(ids: pa.ListArray) -> list[bytes]:
    """The reverse of :func:`id_lists`; null counts as no ids."""
    ids = ids.cast(pa.list_(pa.int32()))
    offsets = ids.offsets.to_numpy()
    values = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False).tobytes()
    return [b"" if gone else values[4 * a : 4 * b] for a, b, gone in zip(offsets[:-1], offsets[1:], ids.is_null().to_pylist(), strict=True)]

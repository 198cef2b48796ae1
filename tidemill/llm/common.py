"""Helpers that the corpus operators share: the shared folder, written intermediate tables, text as bytes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that have been written and not deleted yet, with their sessions.
_WRITTEN: dict[str, SparkSession] = {}
#: Spark deletes the shuffle files of a query as soon as it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)
    return f"file://{own}"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; it goes when the Python process ends."""
    path = f"{shared_dir(spark)}/tidemill/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back.

    This cuts the lineage with files that every executor sees, so a lost executor costs no recomputation of what went
    before, and the shuffle files of what went before are no longer needed: Spark deletes them when the write has ended. The
    table goes when the Python process ends, or with drop().
    """
    spark = df.sparkSession
    path = folder(spark, name)
    was = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As stored(), in buckets of the key, by which df is dealt already into shuffle_width() partitions: later joins on the key
    shuffle the other side only."""
    spark = df.sparkSession
    path, table = folder(spark, name), f"tidemill_{uuid.uuid4().hex}"
    n = shuffle_width(spark)
    was = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(table)
    finally:
        spark.conf.set(_CLEAN, was)
    out = spark.table(table)
    out._stored_at, out._table = path, table
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that stored() or bucketed() gave and that nothing reads any more."""
    for table in tables:
        if table is not None:
            if hasattr(table, "_table"):
                table.sparkSession.sql(f"DROP TABLE IF EXISTS {table._table}")
            _delete(table._stored_at)


def _delete(path: str) -> None:
    spark = _WRITTEN.pop(path, None)
    if spark is None:
        return
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended already: nothing is left to ask
        return


@atexit.register
def _delete_all() -> None:
    for path in list(_WRITTEN):
        _delete(path)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32(doc_id as text) mod 4 is 2: such rows are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


# ---- text as bytes -------------------------------------------------------------------------------------------------

_P = 0x100000001B3 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


_POW = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p^i and p^-i modulo 2^64 for i < n."""
    if n > len(_POW.get("up", ())):
        size = 1 << max(16, int(n - 1).bit_length())
        _POW["up"], _POW["down"] = _powers(_P, size), _powers(pow(_P, -1, 2**64), size)
    return _POW["up"], _POW["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes of words: ASCII letters and digits, and all bytes of characters beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one byte array, a zero byte after each; where each begins; how long each is."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths + 1) - lengths - 1
    return np.frombuffer(b"\0".join(texts) + b"\0", np.uint8), starts, lengths


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word in the bytes."""
    is_word = WORD_BYTE[buf].view(np.int8)
    edge = np.diff(is_word, prepend=np.int8(0), append=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return begin, end, np.zeros(0, np.uint64)
    up, down = powers(len(buf) + 1)
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    return begin, end, mix((total[end] - total[begin]) * down[begin])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application: their workers import it by name."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        package = Path(__file__).resolve().parent.parent
        archive = os.path.realpath(os.path.join(tempfile.mkdtemp(), f"{package.name}.zip"))
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(archive)


#: Bytes of an Arrow batch, about: texts may be long, so a number of rows is no bound.
BATCH_BYTES = "4m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def batches(spark: SparkSession) -> None:
    """Prepare a session for Python stages: the package is sent, and Arrow batches are bounded by bytes. The bound is the
    same for all operators, so it doesn't matter which of several lazy plans runs first."""
    ship(spark)
    spark.conf.set(_BATCH, BATCH_BYTES)


# ---- what stays with a Python worker -------------------------------------------------------------------------------

_HELD: dict = {}
_OWNER: list[str] = [""]


def held(key, make: Callable):
    """What an operator has loaded in this worker, for its next tasks: until another operator's task begins here."""
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def begin(owner: str) -> None:
    """A task of this operator begins. Workers are used again by all operators, so what another one has left goes, and its
    memory goes back to the system: else an executor needs the sum of what its operators need, not the most."""
    if _OWNER[0] == owner:
        return
    _OWNER[0] = owner
    _HELD.clear()
    _POW.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def alone(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, in a worker that holds nothing of other operators (those of other modules)."""
    owner = run.__module__

    def begun(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(owner)
        return run(parts)

    return begun

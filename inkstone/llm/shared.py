"""The folder that all executors share: written tables that cut lineage, and files that tasks map into memory.

The cluster names the folder in ``spark.checkpoint.dir``. Where that is unset and Spark runs in one process (tests), a
temporary folder is made; elsewhere an unset folder is an error, since a machine-local one would be lost with its
executor.
"""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def one_process(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def folder(spark: SparkSession) -> str:
    """The shared folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not one_process(spark):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="shared-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Arrow batches of at most about ``size`` bytes: each is held by the executor's JVM and by its Python worker, some of
    them more than once. A session that sets smaller ones keeps them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).strip().lower().rstrip("b")
    if not now.isdigit() or int(now) > size:
        spark.conf.set(key, size)


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it is removed when the driver ends, or by ``discard``."""
    small_batches(spark)
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, path)
    return path


def remove(uri: str) -> None:
    """Deletes a folder of the shared store, if it is there."""
    if path := local(uri):
        shutil.rmtree(path, ignore_errors=True)
        return
    from pyarrow import fs

    try:
        store, path = fs.FileSystem.from_uri(uri)
        store.delete_dir(path)
    except OSError:  # not there, or gone with its store
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, on any number of machines."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again.staged_at = path
    return again


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes staged tables and folders of files whose consumers have been written: nothing reads them again, and no lost
    executor makes a task read them. The shuffles that fed them go with the driver's garbage, and executors give back what
    their heaps no longer hold: a heap that has grown under one stage would else leave the workers of the next no room."""
    for t in tables:
        remove(t if isinstance(t, str) else t.staged_at)
    if one_process(spark):  # no executors beside the driver, whose heap is the user's
        return
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


def repeated_ids(docs: DataFrame, name: str) -> KeySet:
    """The ids that more than one row has."""
    from pyspark.sql import functions as F

    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).dropna()
    return KeySet.write(ids.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), name)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def local(uri: str) -> str | None:
    """The path of a ``file:`` URI or of a plain path; None for other file systems."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def put(uri: str, data: bytes) -> None:
    """Writes a file whole: a second attempt at the same task replaces it by the same bytes."""
    if path := local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as f:
        f.write(data)


_read: OrderedDict[str, np.ndarray] = OrderedDict()
#: Bytes of files that a worker keeps where the store cannot be mapped; the least recently used go first.
KEPT_BYTES = 128 << 20


def mapped(uri: str) -> np.ndarray:
    """The bytes of a file: mapped anew each time where the store allows it, so that a worker holds no file of an earlier
    stage; else read and kept for a while."""
    if path := local(uri):
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    if uri not in _read:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with store.open_input_file(path) as f:
            _read[uri] = np.frombuffer(f.read(), np.uint8)
        while len(_read) > 1 and sum(x.nbytes for x in _read.values()) > KEPT_BYTES:
            _read.popitem(last=False)
    _read.move_to_end(uri)
    return _read[uri]


def read_ranges(uri: str, starts: np.ndarray, sizes: np.ndarray) -> Iterator[bytes]:
    """Some ranges of the bytes of a file."""
    if path := local(uri):
        with open(path, "rb", buffering=0) as f:
            for a, n in zip(starts.tolist(), sizes.tolist()):
                f.seek(a)
                yield f.read(n)
        return
    whole = mapped(uri)
    for a, n in zip(starts.tolist(), sizes.tolist()):
        yield whole[a : a + n].tobytes()


def existing(uri: str) -> np.ndarray:
    """``mapped``, or no bytes where there is no such file (a shard without rows has none)."""
    try:
        return mapped(uri)
    except FileNotFoundError:
        return np.zeros(0, np.uint8)


def parts(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """How many shards a shuffle of about the size of ``df`` takes: the session's number of partitions, or more for
    larger input. Beyond 4096 it grows as the square root, so that the blocks of an all-to-all shuffle stay large."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size if size < 1 << 60 else 0  # an unknown size is given as a huge one
    return parts_of(known, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), bytes_each)


def parts_of(size: int, least: int, bytes_each: int = 16 << 20) -> int:
    """How many shards ``size`` bytes take, ``least`` or more; see ``parts``."""
    n = size // bytes_each
    return max(least, n if n <= 4096 else int(64 * n**0.5))


def by_shard(df: DataFrame, shards: int) -> DataFrame:
    """``df`` with each value of ``shard`` in a partition of its own: hashed, some partitions would take several shards and the
    largest would be several times the mean. A group by ``shard`` then needs no other shuffle."""
    from pyspark.sql import functions as F

    return df.repartitionById(shards, F.col("shard"))


class KeySet:
    """Integers in sorted files of the shared folder: tasks map the files and search them, so nothing is broadcast."""

    def __init__(self, path: str, shards: int) -> None:
        self.path, self.shards = path, shards

    @classmethod
    def write(cls, keys: DataFrame, name: str) -> KeySet:
        """From the one bigint column of ``keys``; nulls are dropped, repeats count once."""
        from pyspark.sql import functions as F

        spark, (column,) = keys.sparkSession, keys.columns
        shards = parts(keys, 32 << 20)
        path = fresh(spark, name)

        def save(table: pa.Table) -> pa.Table:
            shard = table["shard"][0].as_py()
            put(f"{path}/{shard}", np.unique(table["key"].to_numpy()).tobytes())
            return pa.table({"shard": pa.array([shard], pa.int32())})

        keyed = keys.select(F.col(column).cast("bigint").alias("key")).dropna()
        keyed.withColumn("shard", F.pmod(F.col("key"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(save, "shard int").count()
        return cls(path, shards)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """For each key (int64), whether it is in the set."""
        shard, out = np.mod(keys, self.shards), np.zeros(len(keys), bool)
        for s in np.unique(shard):
            at = np.flatnonzero(shard == s)
            own = existing(f"{self.path}/{s}").view(np.int64)
            if len(own):
                i = np.minimum(np.searchsorted(own, keys[at]), len(own) - 1)
                out[at] = own[i] == keys[at]
        return out


class PairMap:
    """(key, value) rows of bigints in sorted files of the shared folder, to be searched by key."""

    def __init__(self, path: str, shards: int) -> None:
        self.path, self.shards = path, shards

    @classmethod
    def write(cls, rows: DataFrame, name: str) -> PairMap:
        """From the two bigint columns of ``rows``, without nulls; repeated rows count once."""
        from pyspark.sql import functions as F

        shards = parts(rows, 32 << 20)
        path = fresh(rows.sparkSession, name)

        def save(table: pa.Table) -> pa.Table:
            shard = table["shard"][0].as_py()
            k, v = table["k"].to_numpy(), table["v"].to_numpy()
            order = np.lexsort((v, k))
            put(f"{path}/{shard}", np.concatenate([k[order], v[order]]).tobytes())
            return pa.table({"shard": pa.array([shard], pa.int32())})

        named = rows.toDF("k", "v").distinct()
        named.withColumn("shard", F.pmod(F.col("k"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(save, "shard int").count()
        return cls(path, shards)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``keys``, value) of every row whose key is among ``keys``."""
        from .blobs import ranges

        shard, at_, values = np.mod(keys, self.shards), [], []
        for s in np.unique(shard):
            at = np.flatnonzero(shard == s)
            own = existing(f"{self.path}/{s}").view(np.int64)
            k, v = own[: len(own) // 2], own[len(own) // 2 :]
            lo, hi = np.searchsorted(k, keys[at], "left"), np.searchsorted(k, keys[at], "right")
            at_.append(np.repeat(at, hi - lo))
            values.append(v[ranges(lo, hi - lo)])
        if not at_:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, value = np.concatenate(at_), np.concatenate(values)
        order = np.lexsort((value, place))
        return place[order], value[order]


class Counts:
    """How often each 64-bit hash occurs, for those that occur twice or more, in sorted files of the shared folder."""

    def __init__(self, path: str, shards: int) -> None:
        self.path, self.shards = path, shards

    def shard(self, hashes: np.ndarray) -> np.ndarray:
        """Ranges of hashes, so that sorted ones are close to each other within a shard."""
        return ((hashes >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int32)

    def save(self, shard: int, hashes: np.ndarray, counts: np.ndarray) -> int:
        """Adds up the counts of equal hashes and writes the shard; gives how many it keeps."""
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, int)
        total = np.add.reduceat(counts, first) if len(first) else counts
        hashes, total = hashes[first][total > 1], total[total > 1]
        put(f"{self.path}/{shard}", hashes.tobytes() + total.astype(np.uint64).tobytes())
        return len(hashes)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The count of each hash; 1 for those not kept."""
        shard, out = self.shard(hashes), np.ones(len(hashes), np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in range(self.shards):
            at = order[cuts[s] : cuts[s + 1]]
            own = existing(f"{self.path}/{s}").view(np.uint64) if len(at) else ()
            if len(own):
                k, v = own[: len(own) // 2], own[len(own) // 2 :]
                i = np.minimum(np.searchsorted(k, hashes[at]), len(k) - 1)
                out[at] = np.where(k[i] == hashes[at], v[i].astype(np.int64), 1)
        return out

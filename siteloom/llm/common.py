"""What the corpus operators share: scratch tables, hashing of words and a streaming group reader."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java's smallest long stands for a null id inside the operators, so that null ids join and sort like any other.
NULL_ID = -(2**63)
#: Rows that go to a Python worker at a time.
BATCH = "1000"

_made: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir, which every executor can read.

    Only a session of one machine (a local master) may lack the setting: it gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _made:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="checkpoint-")
            sc.setCheckpointDir(base)
        path = f"{base.rstrip('/')}/siteloom-{uuid.uuid4().hex}"
        _made[sc.applicationId] = path
        atexit.register(_remove, spark, path)
    return _made[sc.applicationId]


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession) -> None:
    """From here on BATCH rows go to a Python worker at a time: texts are long, and Spark's 10000 rows would not stay small.

    The setting is read when a plan runs, which is after an operator has returned it, so it stays for the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def _collect_garbage(spark: SparkSession) -> None:
    """Lets the driver's JVM collect its garbage once its heap has grown over half of what it may have.

    Plans, events and broadcasts of steps that are over are garbage, but the JVM takes more memory before it looks for old
    garbage, and a broadcast stays on driver and executors until it does. A collection gives back what the heap does not need.
    """
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > runtime.maxMemory() // 2:
        spark.sparkContext._jvm.java.lang.System.gc()


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared scratch folder and read again: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    small_batches(spark)
    df.write.parquet(path)
    _collect_garbage(spark)
    again = spark.read.schema(df.schema).parquet(path)
    again.scratch_path = path
    return again


def release(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing will read again, so that the disk holds one step's tables and not all steps'."""
    for table in tables:
        _remove(table.sparkSession, table.scratch_path)


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it if df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_or_null(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


class WordHash(dict):
    """64-bit hashes of words, remembered; forgets all when it holds `most` words, so that memory stays bounded."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = WordHash()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def whole_groups(batches, keys: list[str]):
    """Yields pandas frames that hold only whole groups of `keys`, from batches sorted by them; a group may span batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        last = batch[keys].iloc[-1].to_numpy()
        tail = (batch[keys].to_numpy() == last).all(axis=1)
        cut = len(batch) - int(tail[::-1].argmin() if not tail.all() else len(batch))
        if cut == 0:
            if held and not (held[-1][keys].iloc[-1].to_numpy() == last).all():
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(batch)
            continue
        yield pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
        held = [batch.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def runs(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where each group of a sorted frame begins, and its length at the end."""
    values = frame[keys].to_numpy()
    new = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
    return np.concatenate(([0], new, [len(frame)]))

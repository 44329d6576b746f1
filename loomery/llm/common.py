"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = 0xFFFFFFFFFFFFFFFF


#: Folders of sessions that name none, by application.
_OWN: dict[str, str] = {}
#: Rows of keys that are broadcast at most; more are joined by shuffling.
BROADCAST_KEYS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of its own only for a local session that names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="loomery-")
        found = _OWN[context.applicationId]
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomery/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    for tables in _SCRATCH:
        tables.append(out)
    return out


#: What is materialized while a scratch is open.
_SCRATCH: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables materialized inside are deleted at the end, but for those handed to the function it gives."""
    tables, kept = [], []
    _SCRATCH.append(tables)
    try:
        yield lambda df: kept.append(df) or df
    finally:
        _SCRATCH.remove(tables)
    released(*(t for t in tables if not any(t is k for k in kept)))


def released(*tables: DataFrame) -> None:
    """Deletes materialized tables that no result reads any more."""
    for t in tables:
        if path := getattr(t, "written_to", None):
            spark = t.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def near(side: DataFrame, rows: int) -> DataFrame:
    """``side`` of ``rows`` rows of a few bytes each: broadcast if it is small, else left to a shuffle."""
    return F.broadcast(side) if rows <= BROADCAST_KEYS else side


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id and hash of the text (d, t) are in ``gone``, a materialized table."""
    return docs.join(near(gone, gone.count()), F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("t")), "left_anti")


def words_between(text: Column, separators: str) -> Column:
    """The pieces between runs of ``separators``, in order. Splitting is linear in the text; extracting all matches
    of the opposite pattern copies the text for each."""
    return F.array_remove(F.split(text, separators), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit integers (wrapping arithmetic)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> xxhash64, remembered; emptied at a fixed size so that memory stays bounded."""

    LIMIT = 400_000

    def __init__(self, limit: int = LIMIT):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def bounded_batches(spark: SparkSession) -> None:
    """Rows that go to Python at a time: few enough for texts of megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")

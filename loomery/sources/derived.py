"""Tables that are derived once from others and kept beside them, in a folder that all executors share."""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, else the warehouse; a local session without either has one of its own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    if context.master.split("[")[0] != "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="loomery-derived-")
    return _OWN[context.applicationId]


def cut(rows: DataFrame) -> DataFrame:
    """``rows`` once computed and written to the checkpoint folder, so that later plans read them instead of making them again."""
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_root(rows.sparkSession))
    return rows.checkpoint()


def state_of(spark: SparkSession, paths: list[str]) -> str:
    """Changes with the names, lengths or times of the files in ``paths``."""
    out, path = [], spark._jvm.org.apache.hadoop.fs.Path
    for p in sorted(paths):
        fs = path(p).getFileSystem(spark._jsc.hadoopConfiguration())
        found = fs.listStatus(path(p)) if fs.exists(path(p)) else []
        out += [f"{x.getPath()}|{x.getLen()}|{x.getModificationTime()}" for x in found]
    return hashlib.sha256("\n".join(sorted(out)).encode()).hexdigest()[:32]


#: Changes when derived tables are made otherwise or get other columns.
FORMAT = 4


def folder_of(spark: SparkSession, name: str, paths: list[str]) -> str:
    """Where what is derived from ``paths`` under ``name`` is kept, whatever their state."""
    key = hashlib.sha256("\n".join([str(FORMAT), name, *sorted(paths)]).encode()).hexdigest()[:32]
    return f"{shared_root(spark)}/loomery-derived/{name}-{key}"

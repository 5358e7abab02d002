"""The folder that driver and executors share, and tables written there to cut lineage.

Tables are removed when the driver's process ends; until then plans may read them.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Setting that names the shared folder.
SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one of our own in local mode, and an error on a cluster."""
    at = spark.conf.get(SETTING, None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{SETTING} must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="lexaudit-")
        _written.append((spark, _own[app]))
    return _own[app]


def written(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """df as a table in the shared folder, laid out by columns if any are named, read again: lineage is cut there and lost executors lose nothing.

    Its files are compressed, often a hundredfold, so their size says nothing of the rows: joins with it are by shuffle,
    as a table taken for small by its files would go to the driver and into every task.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns).hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to several tasks a core, for work in Python on rows that are small in their files and would be few tasks as read."""
    sc = df.sparkSession.sparkContext
    return df.repartition(max(4 * sc.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def whole_groups(batches: Iterable[pa.RecordBatch], by: str, at_once: int) -> Iterator[pa.Table]:
    """Batches whose groups stand together as tables of so many rows, a group never cut."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= at_once:
            t = pa.Table.from_batches(held).combine_chunks()
            own = t.column(by).combine_chunks().dictionary_encode().indices.to_numpy()
            whole = int(np.searchsorted(own, own[-1]))  # the last group may go on
            held = t.slice(whole).to_batches()
            yield t.slice(0, whole)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def scratch(spark: SparkSession, tag: str) -> str:
    """The path of a new folder in the shared folder, removed when the driver ends; nothing is made yet."""
    path = f"{shared_dir(spark)}/lexaudit/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def land(spark: SparkSession, source: str, target: str) -> None:
    """Moves a finished folder to a place that a stream watches, so that it sees all files or none."""
    fs, to = file_system(spark, target)
    fs.mkdirs(to.getParent())
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(source), to):
        raise OSError(f"{source} could not be moved to {target}")


@contextlib.contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for the block; those before come back after it.  A streaming query keeps those of its start."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@atexit.register
def remove_written() -> None:
    """Removes all tables written so far; plans that read them cannot run any more."""
    while _written:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):  # the JVM may have ended before; then the folder's owner removes it
            fs, at = file_system(spark, path)
            fs.delete(at, True)

"""Lineage cuts that survive the loss of executors.

Intermediate results are written as Parquet to the folder that the session names in
``spark.checkpoint.dir`` and read back, so a later failure never needs the earlier stages.
A machine-local folder is only used where the setting is absent, as in tests.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, or a temporary one on a local master without the setting."""
    global _local
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="oriel-")
        atexit.register(shutil.rmtree, _local, ignore_errors=True)
    return "file://" + _local


def materialise(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, with the same columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    own = _scratch.get()
    if own is not None:
        own.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folders: set[str]) -> None:
    jvm = spark.sparkContext._jvm
    for name in folders:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _folders(df: DataFrame) -> set[str]:
    return {f.rpartition("/")[0] for f in df.inputFiles()}


def release(*frames: DataFrame) -> None:
    """Deletes the files of materialised frames that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, _folders(df))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """On leaving it deletes all that was materialised inside in this thread, but for the frames given to the
    function that it yields. What is kept belongs to the scratch around it, if there is one."""
    outer, kept = _scratch.get(), set()
    mark = _scratch.set([])

    def keep(df: DataFrame) -> DataFrame:
        kept.update(x.rstrip("/").rpartition("/")[2] for x in _folders(df))
        return df

    try:
        yield keep
    finally:
        made = _scratch.get()
        _scratch.reset(mark)
        stay = [x for x in made if x.rpartition("/")[2] in kept]
        if outer is not None:
            outer.extend(stay)
        _delete(spark, set(made) - set(stay))

"""The shared folder: scratch tables, and binary files that executors write and range-read.

Scratch lives below ``spark.checkpoint.dir`` of the session. Only where that is unset and Spark runs in one process, as in tests, a
folder of this library is used; on a cluster without the setting nothing is written. Files are opened through ``pyarrow.fs``, so any scheme that it
knows (file, hdfs, s3, gs) works on executors; paths are always full URIs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.runtime import shared_folder

def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder URI in the shared folder of the cluster."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a Parquet table in the shared folder: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by ``written`` once nothing reads it any more."""
    spark, path = df.sparkSession, getattr(df, "_scratch_path", None)
    if path:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def freed(spark: SparkSession) -> None:
    """Let go of plans that are done: Spark deletes their shuffle files as soon as the driver has collected its garbage."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def opened(uri: str):
    """(filesystem, path) for a full URI; works on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def picked(df: DataFrame, **names: str) -> DataFrame:
    """Columns by their exact names, renamed; whatever other columns are called, even the same but for case or with dots."""
    at = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return at.select(*[F.col(f"c{df.columns.index(name)}").alias(new) for new, name in names.items()])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or where a column has it, the first of name_1, name_2 and so on that is free; case does not tell names apart."""
    taken = {c.lower() for c in df.columns}
    return next(x for i in range(len(taken) + 1) if (x := f"{name}_{i}" if i else name).lower() not in taken)


def in_task(spark: SparkSession, job):
    """The value of ``job()``, a small bounded computation, run in one task: linear algebra gets one thread there and can be retried."""
    import pickle

    def run(batches):
        import pandas as pd

        for _ in batches:
            pass
        yield pd.DataFrame({"out": [pickle.dumps(job())]})

    return pickle.loads(spark.range(0, 1, 1, 1).mapInPandas(run, "out binary").first()["out"])


#: How to empty the caches of this process, by the operator they belong to.
CACHES: dict[str, Callable[[], None]] = {}


def begin(operator: str) -> None:
    """At the start of a task: a worker that served other operators lets go of what they cached (tokenizers, word hashes), which it would keep for good."""
    for name, empty in CACHES.items():
        if name != operator:
            empty()
    give_back()


def give_back() -> None:
    """At the end of a task: return memory that the worker no longer uses to the system, as the next stage may need it for the JVM."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass

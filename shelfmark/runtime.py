"""Making the package importable in Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Rows of an Arrow batch where the session leaves Spark's default: texts can be long, and a worker holds a batch several times over.
BATCH_ROWS = "1000"
_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shipped(spark: SparkSession) -> SparkSession:
    """Send the package's modules to the executors once a Spark context, so that their Python workers can import it."""
    context = spark.sparkContext
    if spark.conf.get(_ROWS_KEY) == "10000":
        spark.conf.set(_ROWS_KEY, BATCH_ROWS)
    if not getattr(context, "_shelfmark_shipped", False):
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="shelfmark-")) / "shelfmark_code.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        context.addPyFile(str(target))
        context._shelfmark_shipped = True
    return spark


#: Where scratch goes, until the process ends, if the session names no shared folder and runs in one process, as in tests.
LOCAL_SCRATCH = "file:///tmp/checkpoints/shelfmark"
_local: set[str] = set()


def materialized(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a Parquet table in the shared folder, so that what reads them several times works them out once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def shared_folder(spark: SparkSession) -> str:
    """The URI of the folder that driver and executors share, without a slash at its end."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is unset: executors and the driver need a folder that they share")
        root = f"{LOCAL_SCRATCH}/{spark.sparkContext.applicationId}"
        if root not in _local:
            _local.add(root)
            atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
    if "://" not in root:
        root = f"file://{root}" if not root.startswith("file:") else root.replace("file:", "file://", 1)
    return root.rstrip("/")

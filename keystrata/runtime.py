"""What a job needs from its session: shared scratch space and this package on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SCRATCH = "_keystrata_scratch"
_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}


#: Arrow batches to and from Python hold this much unless the session says otherwise; Spark's own bound of
#: 64 MB is held several times over by a task and its worker.
ARROW_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package once per application, so that Python operators import there, and
    bound the bytes of Arrow batches where the session has no bound of its own."""
    sc = spark.sparkContext
    if ARROW_BYTES[0] not in spark.conf.getAll:
        spark.conf.set(*ARROW_BYTES)
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="keystrata-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "keystrata.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder_name, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder_name, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="keystrata-")
        atexit.register(shutil.rmtree, _own_dirs[app][7:], ignore_errors=True)
    return _own_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/keystrata/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: lineage ends at replicated files,
    so a lost executor costs a re-read and not a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    frame = spark.read.schema(df.schema).parquet(path)
    frame.__dict__[_SCRATCH] = path
    return frame


def discard(*frames: DataFrame | None) -> None:
    """Delete the files of materialized frames that nothing will read any more; other frames are left alone."""
    for frame in frames:
        path = frame.__dict__.pop(_SCRATCH, None) if frame is not None else None
        if path:
            delete_path(frame.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

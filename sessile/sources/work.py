"""The session's folder in the one that the cluster shares, and tables written there to end a lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def session_folder(spark: SparkSession) -> str:
    """Removed when the driver ends; in a temporary folder only where none is set, on one machine."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    known = sc._sessile_tables = getattr(sc, "_sessile_tables", {})
    if shared not in known:
        known[shared] = f"{shared or tempfile.mkdtemp(prefix='sessile-')}/tables-{uuid.uuid4().hex}"
        atexit.register(_remove, sc, known[shared])
    return known[shared]


def _remove(sc: SparkContext, path: str) -> None:
    if sc._jsc is not None:  # a session that was stopped has no way to its files any more
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark removes the shuffle files of a query as it ends, where this is set.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialised(frame: DataFrame, name: str, last: bool = False) -> DataFrame:
    """The frame written once and read back: what reads it again does not compute it again, on any machine.

    last: nothing else reads what the frame was shuffled for, so these files go as soon as it is written.
    """
    path, conf = new_folder(frame.sparkSession, name), frame.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    if last:
        conf.set(_CLEANUP, "true")
    try:
        frame.write.parquet(path)
    finally:
        if last:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    out = frame.sparkSession.read.schema(frame.schema).parquet(path)
    out._sessile_path = path
    return out


def discarded(frame: DataFrame) -> None:
    """Removes the files of a frame that materialised has made, and that nothing reads any more."""
    _remove(frame.sparkSession.sparkContext, frame._sessile_path)

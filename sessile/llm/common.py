"""Shared pieces of the operators: table access, the shared work folder, sizes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters outside this ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only when it was counted and has at most so many rows.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """This session's folder in the one that the cluster shares, removed when the driver ends; a temporary one only
    where none is set (tests, one machine)."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    known = sc._sessile_work = getattr(sc, "_sessile_work", {})
    if shared not in known:
        known[shared] = f"{shared or tempfile.mkdtemp(prefix='spark-work-')}/sessile-{uuid.uuid4().hex}"
        atexit.register(_remove, sc, known[shared])
    return known[shared]


def _remove(sc: SparkContext, path: str) -> None:
    if sc._jsc is not None:  # a session that was stopped has no way to its files any more
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends here and its size is known."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def text_or_empty() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def joined_small(left: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join with a side that is broadcast if it has few rows, counted here, and shuffled otherwise."""
    n = small.count() if rows is None else rows
    return left.join(F.broadcast(small) if n <= BROADCAST_ROWS else small, on, how)


def hash60(*cols: Column) -> Column:
    """60 bits of an MD5 as a long; SQL engines give the same."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def fold(doc_id: Column, n: int) -> Column:
    """The fold of a row: CRC-32 of its id as text, modulo n. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, for clusters where it is not installed."""
    sc = spark.sparkContext
    if not getattr(sc, "_sessile_sent", False):
        package = Path(__file__).resolve().parents[1]
        path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="sessile-")), "sessile.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(path)
        sc._sessile_sent = True


def give_back() -> None:
    """Return what this process has freed to the system: after a fit with large arrays, and at the end of a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def in_slices(batches: Iterator[pa.RecordBatch], rows: int, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows and about so many bytes at most."""
    for batch in batches:
        step = max(1, min(rows, rows if batch.nbytes <= size else batch.num_rows * size // batch.nbytes))
        for at in range(0, max(batch.num_rows, 1), step):
            yield batch.slice(at, step)


class ArrowRows:
    """A frame whose batches reach Python functions in parts of bounded size, so that long texts fit a worker's memory."""

    def __init__(self, df: DataFrame, rows: int) -> None:
        self.df, self.rows = df, rows

    def mapInArrow(self, function: Callable, schema: str) -> DataFrame:  # noqa: N802
        rows = self.rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                yield from function(in_slices(batches, rows))
            finally:
                give_back()  # a worker that waits for its next task keeps little

        return self.df.mapInArrow(run, schema)


#: Spark's own setting for rows of an Arrow batch, and ours in its place: whole texts in batches of 10,000 rows fill a worker's memory.
DEFAULT_ROWS, BATCH_ROWS = "10000", "1000"


def arrow_rows(df: DataFrame, rows: int = 1000) -> ArrowRows:
    """Make a frame ready for Python functions: at most so many rows at once.

    A session that has Spark's default for rows of an Arrow batch gets BATCH_ROWS, the
    same for all operators; a setting of the user's own stays.
    """
    ship(df.sparkSession)
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if conf.get(key, DEFAULT_ROWS) == DEFAULT_ROWS:
        conf.set(key, BATCH_ROWS)
    return ArrowRows(df, rows)

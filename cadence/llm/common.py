"""Helpers shared by the operators: the shared folder, written tables, columns.

Intermediate results are cut from their lineage by writing them to the folder
that the cluster names in ``spark.checkpoint.dir``, which all executors share,
so a lost executor never costs more than its own running tasks.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BYTES = r"[^\x20\x09-\x0D]+"
_ROOT = "cadence-llm"
#: Spark's setting by which the shuffle files of a write go when it ends, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset a temporary folder serves, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cadence-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{_ROOT}-{spark.sparkContext.applicationId}"


def free(base: str, *frames: DataFrame) -> str:
    """A column name like ``base`` that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


@contextlib.contextmanager
def no_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """Writes and results that are taken inside leave no shuffle files."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


class Workspace:
    """Written tables of one operator call, below the shared folder.

    ``put`` writes a frame, has its shuffle files removed and reads it back, ``drop`` removes a table that no
    later plan reads. What the result still reads stays until the application
    ends or until :func:`clean` is called.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        with no_shuffle_files(self.spark):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Remove everything this application's operators have written."""
    _delete(spark, shared_dir(spark))


def rows_of(batches: Iterator) -> Iterator[dict]:
    """Rows one by one, for tables whose rows are megabytes."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


#: Functions that empty what a module keeps in a worker from task to task.
caches: list = []


def release(keep: bool = False) -> None:
    """Give freed memory back to the system, since idle workers live on; and, but for ``keep``, what operators hold for their own next tasks."""
    if not keep:
        for empty in caches:
            empty()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def apart(docs: DataFrame, ws: Workspace, id_col: str = "doc_id") -> tuple[DataFrame, str | None]:
    """``docs`` and the column that tells its rows apart in the order of ids: None for ``id_col`` itself, where no id is null or comes twice.

    Else rows are sorted by id (null last), then a digest of the text, then as they are read, and written with a number in that order; ranges of
    the sort also split an id, or the rows without one.
    """
    counts = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("ids")).first()
    if counts["n"] == counts["ids"]:
        return docs, None
    no, read = free("_no", docs), free("_read", docs)
    order = [F.asc_nulls_last(id_col), F.xxhash64("text"), F.col(read)]
    rows = docs.withColumn(read, F.monotonically_increasing_id()).repartitionByRange(n_shuffle(docs.sparkSession), *order).sortWithinPartitions(*order)
    return ws.put(rows.withColumn(no, F.monotonically_increasing_id()).drop(read), "apart"), no


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))

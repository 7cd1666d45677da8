"""Session helpers: shared scratch tables, lineage cuts and worker import path."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ROOT = str(Path(__file__).resolve().parents[2])
#: The column that tells rows apart where doc_ids are null or repeated: the file and the row in it.
PLACE, PLACE_TYPE = "umbra_place", "struct<file: string, row: bigint>"
#: A key with more than one of so many rows is hot; at most so many keys can be.
HOT = 4096
#: Rows go to Python workers in batches of about this size, so that few long texts are held at once.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

#: What empties the caches that a worker's tasks share, by the module that has them.
CACHES: dict[str, Callable[[], None]] = {}


def ship(spark: SparkSession) -> None:
    """Lets Python workers started from another directory import this package, and bounds their batches."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    env.setdefault("OMP_NUM_THREADS", "1")  # tasks share the cores already
    spark.conf.set(BATCH, str(BATCH_BYTES))


def release() -> None:
    """Gives free memory back to the system; an idle worker would hold it beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shed(keeps: str | None = None) -> None:
    """Empties the caches that a worker's earlier tasks filled, but for that of the module `keeps`."""
    for name, empty in CACHES.items():
        if name != keeps:
            empty()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str | None = None) -> Callable:
    """A worker's function over batches that releases its memory when a task ends, and before that of other kinds of tasks."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shed(keeps)
        try:
            yield from run(batches)
        finally:
            release()

    return task


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; our own only where none is set and all run on one machine."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = Path(tempfile.gettempdir(), f"umbra-{os.getpid()}").as_uri()
        spark.conf.set("spark.checkpoint.dir", conf)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


def _plain(project) -> bool:
    """Whether a plan's projection only picks columns."""
    items = project.projectList()
    return all(items.apply(i).nodeName() == "AttributeReference" for i in range(items.size()))


class Scratch:
    """Tables of one run under the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as Parquet and reads it back: a lineage cut that survives lost executors."""
        schema = df.schema
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def located(self, df: DataFrame, name: str) -> DataFrame:
        """df with PLACE: the file and the position in it that hold each row, which stay whatever is read again.

        A table whose columns are as they were read has such places; anything else is written first.
        """
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        plan = df._jdf.queryExecution().analyzed()
        while plan.nodeName() in ("Filter", "SubqueryAlias") or (plan.nodeName() == "Project" and _plain(plan)):
            plan = plan.children().head()
        if plan.nodeName() == "LogicalRelation":
            with contextlib.suppress(AnalysisException):  # of files whose rows have no such place
                return df.withColumn(PLACE, place)
        return self.table(df, name).withColumn(PLACE, place)

    def finish(self, df: DataFrame) -> DataFrame:
        """A checkpoint of the run's result, without the run's tables."""
        df = cut(df)
        self.drop()
        return df

    def drop(self, name: str = "") -> None:
        """Deletes a table (or all of the run's) that no later plan reads."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def remainder(column: str, m: int) -> Column:
    """crc32 of the id as text, modulo m."""
    return F.crc32(F.col(column).cast("string")) % m


def keyed_join(rows: DataFrame, keyed: DataFrame, key: str, count: str = "rows") -> DataFrame:
    """rows joined with their key's one row in `keyed`, a written table whose column `count` has the number of rows of each key.

    Hot keys, at most HOT of them whatever the input, are broadcast; so none of them brings its rows into one task.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(keyed.where(F.col(count) * HOT > total).drop(count))
    rest = keyed.where(F.col(count) * HOT <= total).drop(count)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))


def bounded(rows: DataFrame, by: str, order: list[str], size: Column, most: int, total: int) -> list[Row]:
    """Of each value of `by` the first `most` rows, as far as their sizes add up to `total` (one row at least), in the driver."""
    first = W.partitionBy(by).orderBy(*order)
    rows = rows.withColumn("umbra_rank", F.row_number().over(first)).where(F.col("umbra_rank") <= most)
    held = F.sum(size).over(W.partitionBy(by).orderBy("umbra_rank"))
    return rows.withColumn("umbra_held", held).where((F.col("umbra_held") <= total) | (F.col("umbra_rank") == 1)).collect()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

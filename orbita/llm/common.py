"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from orbita import ship

#: Rows in one Arrow batch: long texts make batches of 10,000 rows too large for a worker.
BATCH_ROWS = 512
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def compact(spark: SparkSession) -> None:
    """Have executors collect their garbage and give what is free of their heaps back to the system.

    A heap that one step has stretched otherwise stays as large beside the Python workers of the steps after it.
    """
    executors = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # without the driver
    spark.range(executors, numPartitions=executors).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch in this session, never raising a lower setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, a temporary one if all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="orbita-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts lineage, survives lost executors.

    The write's shuffle files are deleted as soon as it is done. What ``forget`` has not deleted goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/orbita-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    where, files = at(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._orbita_path = path
    return out


def at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def forget(*tables: DataFrame) -> None:
    """Delete what ``saved`` wrote, once nothing reads it any more."""
    for df in tables:
        if path := getattr(df, "_orbita_path", None):
            where, files = at(df.sparkSession, path)
            files.delete(where, True)


def prepared(df: DataFrame) -> DataFrame:
    """``df``, once its session is ready for Python on the workers."""
    ship.ensure(df.sparkSession)
    small_batches(df.sparkSession)
    return df


def map_rows(df: DataFrame, columns: list[str], schema: str, work: Callable[[Iterator[list[list]]], Iterator[dict]]) -> DataFrame:
    """mapInArrow over plain lists: ``work`` gets an iterator of [column, ...] lists and yields dicts of lists."""
    picked = prepared(df).select(*columns)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work([c.to_pylist() for c in b.columns] for b in batches):
            yield pa.RecordBatch.from_pydict(out, schema=target)

    return picked.mapInArrow(run, schema)


def crc_text(doc_id: str | Column) -> Column:
    """crc32 of the decimal doc_id; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit("")).cast("binary"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of one key that a task takes; and so many keys are broadcast at most, more are joined by a shuffle.
MANY, BROADCAST_KEYS = 1000, 1_000_000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` left-joined with ``counted``, which has a row for each key and in ``held`` the number of its rows (or more).

    The rows of a key with many are dealt to cells, so that no task holds them all.
    """
    cells = F.greatest(F.lit(1), F.ceil(F.col("held") / MANY)).cast("int")
    heavy = saved(counted.where(F.col("held") > MANY).select(*keys, cells.alias("cells")))
    n = heavy.count()
    if not n:
        return rows.join(counted.drop("held"), keys, "left")
    heavy = F.broadcast(heavy) if n <= BROADCAST_KEYS else heavy
    dealt = rows.join(heavy, keys, "left").withColumn("cell", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("cells", F.lit(1))).cast("int")).drop("cells")
    return dealt.join(counted.withColumn("cell", F.explode(F.sequence(F.lit(0), cells - 1))).drop("held"), [*keys, "cell"], "left").drop("cell")

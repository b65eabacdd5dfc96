"""Shared folders, Arrow batch limits and small helpers of the corpus operators.

Every operator writes its intermediate tables below the folder named by
``spark.checkpoint.dir``, which driver and executors share, so that a lost
executor costs only the tasks it was running.  Work folders are deleted as soon
as the operator's own result table stands; result folders go when the driver's
JVM ends.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; very long texts make a batch end early.
ARROW_ROWS = 2000
ARROW_BYTES = "16m"


#: Of a table's keys, fewer than this many hold more than one part in so many of its rows.
HOT_KEYS = 1000


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, else the context's checkpoint folder; only a local session gets one of its own."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir isn't set: it must name a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="textloom-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def bounded_batches(spark: SparkSession) -> dict[str, str | None]:
    """Limit Arrow batches by rows and bytes; returns the settings as they were."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": ARROW_BYTES}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    return before


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Workspace:
    """A folder of one operator run in the shared root.

    ``save`` writes a table and reads it back, which cuts the lineage there;
    ``finish`` writes the result, deletes the rest, gives the session its Arrow
    settings back and returns the result.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.before = bounded_batches(spark)
        self.path = f"{shared_root(spark)}/textloom-{name}-{uuid.uuid4().hex[:12]}"
        p, fs = _hadoop_path(spark, self.path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None, release: bool = True) -> DataFrame:
        out, schema = self.folder(name), df.schema
        w = df.write.mode("overwrite").option("compression", "zstd")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(out)
        del df
        if release:
            self.release()
        # an empty table leaves no file to read the schema from
        return self.spark.read.schema(schema).parquet(out)

    def release(self) -> None:
        """Let Spark drop shuffle files of plans that have ended."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Delete tables, or parts of them (``table/column=value``)."""
        for name in names:
            p, fs = _hadoop_path(self.spark, self.folder(name))
            fs.delete(p, True)

    def finish(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """Write the result, drop every other table of this run, return the result."""
        out = self.save(df, "result")
        p, fs = _hadoop_path(self.spark, self.path)
        for status in fs.listStatus(p):
            if status.getPath().getName() not in {"result", *keep}:
                fs.delete(status.getPath(), True)
        for k, v in self.before.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)
        return out


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread_join(rows: DataFrame, table: DataFrame, on: Sequence[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``table``, which has one row for each key and, as ``n``, how many rows have it.

    Keys that hold more than ``total / HOT_KEYS`` of the ``total`` rows are fewer than
    ``HOT_KEYS``, so they are broadcast, and no task gathers such a key's rows.
    """
    on = list(on)
    least = total // HOT_KEYS
    hot = table.where(F.col("n") > least)
    near = rows.join(F.broadcast(hot), on)  # under HOT_KEYS rows
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return near.unionByName(rest.join(table.where(F.col("n") <= least), on, how)).drop("n")


def clean(df: DataFrame, **columns: str) -> DataFrame:
    """Only the wanted columns under fixed names, so that other columns can't clash."""
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in columns.items()])


def rows_of(batch: pa.RecordBatch, *names: str):
    """Python lists of the named columns."""
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def to_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )

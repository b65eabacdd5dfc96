"""Reading tables, and writing them to the folder that driver and executors share, to cut a long lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df, written below ``spark.checkpoint.dir`` and read again; the files go when the driver ends."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir isn't set: it must name a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="textloom-"))
        root = sc.getCheckpointDir()
    out = f"{root.rstrip('/')}/textloom-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(out)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.parquet(out)


#: Rows and bytes of one Arrow batch: a chain of Python calls holds several batches of whole texts at a time.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Limits Arrow batches for what runs inside, and gives the session its settings back."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    try:
        for k, v in BATCH.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table; one of fewer files than cores is dealt by its key, since a file of one row group is one task."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df

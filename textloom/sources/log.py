"""Reading and writing the score log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "run_id string, detector string, side string, score double, lang string, note string, at timestamp"
#: Rows that the log keeps.
LAST = 200


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries as JSON lines; the schema is given, so nothing is inferred."""
    return spark.read.schema(ENTRY).json(path)


def latest(log: DataFrame) -> DataFrame:
    """The last rows by time: what the log is meant to hold."""
    return log.orderBy(F.desc("at"), "run_id", "detector").limit(LAST)


def write_csv(log: DataFrame, path: str) -> None:
    """Every field quoted, quotes doubled, nulls empty."""
    text = log.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in log.columns])
    text.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", '""').csv(path)

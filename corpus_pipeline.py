"""A training corpus from ``documents``: filter, dedup exactly, nearly and by passages, pack.

Each stage works on all that its predecessor kept, and its decisions take effect.
A decision is on a row, also where ids repeat or are null: rows have keys of their own.
Null texts are empty, very long texts are taken whole, an empty table stays empty, and
columns named like those of the stages are carried along as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import exact_dedup, jaccard_join, packing, quality, suffix_dedup
from textloom.llm.common import Workspace


#: Least bytes of a passage that is cut where it repeats: 50 words of four letters and a space each.
PASSAGE_BYTES = 250


def _numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key of their own, written so that all readers see the same keys, and the key's name."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    return Workspace(spark, "rows").save(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def _staying(rows: DataFrame, row: str, kept: DataFrame) -> DataFrame:
    """Rows whose key is in ``kept``."""
    return rows.join(kept.select(row), row, "left_semi").drop(row)


def _one_of_each(rows: DataFrame, row: str, groups: DataFrame, group: str, best, first) -> DataFrame:
    """The key of one row of each group: the least or greatest, by ``best``, of (first, id, key)."""
    own = rows.select(row, F.struct(first.alias("first"), "doc_id", row).alias("own"))
    return groups.select(row, group).join(own, row).groupBy(group).agg(best("own").alias("own")).select(F.col(f"own.{row}").alias(row))


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, row = _numbered(spark, docs)
    return _staying(rows, row, quality.classify(spark, rows, labels, row_col=row).where("kept"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each set of equal texts, one row with the greatest id stays; null is less than any."""
    rows, row = _numbered(spark, docs)
    groups = exact_dedup.exact_dedup(spark, rows, id_col=row)
    return _staying(rows, row, _one_of_each(rows, row, groups, "keep_id", F.max, F.col("doc_id").isNotNull()))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component, one row with the least id stays; null is greater than any."""
    rows, row = _numbered(spark, docs)
    groups = jaccard_join.jaccard_join(spark, rows, id_col=row)
    return _staying(rows, row, _one_of_each(rows, row, groups, "component_id", F.min, F.col("doc_id").isNull()))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    cut = suffix_dedup.suffix_dedup(spark, docs, length=PASSAGE_BYTES, keep_text=True, carry=others)
    text = F.col("kept_text")
    own = {"text": text, "n_chars": F.length(text).cast("long")}
    return cut.select(*[own.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs)


STAGES = [
    ("quality", filter_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_passages),
    ("packing", pack),
]

#: Classifier, components and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
        if before:
            ws.drop(before)
        before = name
    return docs

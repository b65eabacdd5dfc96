"""Substring dedup: words covered by a window that also starts in a document of smaller id go.

Pass 1 counts windows in a count-min sketch (``sketch``); the merged sketch
overestimates, so a window it counts once occurs in one document only.  Pass 2
groups only windows estimated repeated, exactly:

* a map task settles its own block of documents first: each distinct window goes
  on once, with the block's smallest document that has it; larger documents of the
  block are already known to repeat it.  So no window has more rows than there are
  blocks, however many documents share it;
* windows travel as packed arrays by hash bucket, and a bucket's task finds the
  smallest document of each;
* verdicts travel as packed arrays by document bucket and meet the texts there.

Null texts have no words.  A null document id counts as larger than all others
(as the largest 64-bit integer does), and equal ids don't repeat each other.  Rows
repeating an id are judged one by one.  Texts shorter than a window are kept whole.
Very long texts are taken whole, as one row of their batch.  An empty table gives no
rows.  Of the input's columns only id and text are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketch
from .common import Workspace, clean, parallelism, rows_of, to_batch
from .windows import WordHasher, utf8, window_hashes, words_of

WINDOW = 13
#: Windows of a block, and windows of corpus for each bucket.
BLOCK = 2_000_000
PER_BUCKET = 1_000_000
#: Bytes of a word and the space after it, to size sketch and buckets.
WORD_BYTES = 6
NULL_ID = np.iinfo(np.int64).max

_PART = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])
_PART_DDL = "kind int, bucket int, payload binary"
_GROUP, _FLAG = 0, 1


def pack_pairs(ids: np.ndarray, *arrays: np.ndarray) -> bytes:
    """Document ids (as a table and indices) with arrays of the same length."""
    table, index = np.unique(ids, return_inverse=True)
    index = index.astype(np.uint16 if len(table) < 1 << 16 else np.uint32)
    head = np.array([len(ids), len(table), index.itemsize], np.int64)
    return b"".join([head.tobytes(), table.tobytes(), index.tobytes(), *(a.tobytes() for a in arrays)])


def unpack_pairs(packed: bytes, *kinds) -> list[np.ndarray]:
    n, size, wide = np.frombuffer(packed, np.int64, 3)
    table = np.frombuffer(packed, np.int64, size, 24)
    at = 24 + 8 * size
    out = [table[np.frombuffer(packed, np.uint16 if wide == 2 else np.uint32, n, at)]]
    at += n * wide
    for kind in kinds:
        out.append(np.frombuffer(packed, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    """Document bucket, as ``bucket_column`` computes it in Spark."""
    return ids % buckets


def bucket_column(column, buckets: int):
    return F.pmod(F.coalesce(column, F.lit(int(NULL_ID))), F.lit(buckets)).cast("int")


def _flags(ids: np.ndarray, h: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    to = bucket_of(ids, buckets)
    order = np.argsort(to, kind="stable")
    to, ids, h = to[order], ids[order], h[order]
    edges = np.flatnonzero(np.diff(to, prepend=-1, append=-1))
    return [(_FLAG, int(to[a]), pack_pairs(ids[a:b], h[a:b])) for a, b in zip(edges, edges[1:])]


def _emit(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 64):
        yield to_batch(_PART, list(zip(*rows[at : at + 64])))


class _Blocks:
    """Windows of the incoming texts, block by block: (hash, hash, document id)."""

    def __init__(self, k: int, wide: bool):
        self.k, self.wide, self.hasher = k, wide, WordHasher()
        self.held: list[tuple] = []
        self.size = 0

    def add(self, batch: pa.RecordBatch) -> None:
        ids, texts = rows_of(batch, "id", "text")
        words, counts = words_of([utf8(t) for t in texts], self.hasher)
        h1, h2, text = window_hashes(words, counts, self.k, self.wide)
        docs = np.array([NULL_ID if i is None else i for i in ids], np.int64)
        self.held.append((h1, h2, docs[text]))
        self.size += len(h1)

    def take(self) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        h1 = np.concatenate([x[0] for x in self.held])
        h2 = np.concatenate([x[1] for x in self.held]) if self.wide else None
        ids = np.concatenate([x[2] for x in self.held])
        self.held, self.size = [], 0
        return h1, h2, ids


def corpus_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def substring_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256 (and kept_text if wanted)."""
    ws = Workspace(spark, "substring")
    docs = clean(docs, id=id_col, text=text_col)
    items = corpus_bytes(docs) / WORD_BYTES
    bits = sketch.bits_for(items)
    buckets = max(parallelism(spark), int(items / PER_BUCKET) + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(window, False)

        def close():
            h, _, ids = blocks.take()
            order = np.lexsort((ids, h))
            h, ids = h[order], ids[order]
            # a document counts once for each of its windows
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])
            return sketch.count_cells(h[new], bits)

        for batch in batches:
            blocks.add(batch)
            if blocks.size >= BLOCK:
                yield close()
        if blocks.held:
            yield close()

    table = sketch.merge(spark, docs.mapInArrow(count, sketch.CELLS_DDL), bits)
    ws.release()

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(window, True)

        def close():
            h1, h2, ids = blocks.take()
            keep = sketch.maybe_repeated(h1, table.value, bits)
            h1, h2, ids = h1[keep], h2[keep], ids[keep]
            order = np.lexsort((ids, h2, h1))
            h1, h2, ids = h1[order], h2[order], ids[order]
            first = np.ones(len(h1), bool)
            first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            least = ids[first][np.cumsum(first) - 1] if len(ids) else ids
            local = ids > least
            rows = _flags(ids[local], h1[local], buckets)
            h1, h2, ids = h1[first], h2[first], ids[first]
            # sorted by hash, so buckets are ranges of it
            to = ((h1 >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
            edges = np.flatnonzero(np.diff(to, prepend=-1, append=-1))
            rows += [(_GROUP, int(to[a]), pack_pairs(ids[a:b], h1[a:b], h2[a:b])) for a, b in zip(edges, edges[1:])]
            return rows

        for batch in batches:
            blocks.add(batch)
            if blocks.size >= BLOCK:
                yield from _emit(close())
        if blocks.held:
            yield from _emit(close())

    parts = ws.save(docs.mapInArrow(candidates, _PART_DDL), "windows", ["kind"])
    table.unpersist()

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close():
            ids, h1, h2 = (np.concatenate(x) for x in zip(*[unpack_pairs(p, np.uint64, np.uint32) for p in held]))
            order = np.lexsort((h2, h1))
            ids, h1, h2 = ids[order], h1[order], h2[order]
            first = np.ones(len(h1), bool)
            first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            least = np.minimum.reduceat(ids, np.flatnonzero(first))[np.cumsum(first) - 1]
            found = ids > least
            return _emit(_flags(ids[found], h1[found], buckets))

        for batch in batches:
            for bucket, payload in zip(*rows_of(batch, "bucket", "payload")):
                if bucket != now and held:
                    yield from close()
                    held = []
                now = bucket
                held.append(payload)
        if held:
            yield from close()

    tasks = parallelism(spark)
    flags = ws.save(parts.where(f"kind = {_GROUP}").select("bucket", "payload").repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(group, _PART_DDL), "flags")
    ws.drop(f"windows/kind={_GROUP}")
    flags = flags.select("bucket", "payload").unionByName(parts.where(f"kind = {_FLAG}").select("bucket", "payload"))

    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * keep_text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, hashes, hasher = None, None, None, WordHasher()
        held: list = []
        for batch in batches:
            out = []
            for bucket, payload, i, text in zip(*rows_of(batch, "bucket", "payload", "id", "text")):
                if bucket != now:
                    now, held, ids = bucket, [], None
                if payload is not None:
                    held.append(unpack_pairs(payload, np.uint64))
                    continue
                if ids is None:
                    ids, hashes = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                    order = np.argsort(ids, kind="stable")
                    ids, hashes, held = ids[order], hashes[order], []
                words = utf8(text).split()
                n = len(words)
                key = NULL_ID if i is None else i
                lo, hi = np.searchsorted(ids, [key, key + 1] if key < NULL_ID else [key, key])
                hi = len(ids) if key == NULL_ID else hi
                if lo < hi and n >= window:
                    h, _, _ = window_hashes(hasher.hashes(words), np.array([n]), window, False)
                    hit = np.flatnonzero(np.isin(h, hashes[lo:hi]))
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, hit, 1)
                    np.add.at(edge, hit + window, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                kept = b" ".join(words)
                row = (i, n, n - len(words), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept.decode("utf-8", "surrogatepass")) if keep_text else row)
            if out:
                yield to_batch(schema, list(zip(*out)))

    texts = docs.select(bucket_column(F.col("id"), buckets).alias("bucket"), F.lit(None).cast("binary").alias("payload"), "id", "text")
    verdicts = flags.select("bucket", "payload", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("text"))
    # verdicts of a bucket come before its texts: nulls sort last in payload's presence
    both = texts.unionByName(verdicts).withColumn("late", F.col("payload").isNull()).repartition(tasks, "bucket").sortWithinPartitions("bucket", "late").drop("late")
    ddl = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return ws.finish(both.mapInArrow(cut, ddl).withColumnRenamed("id", id_col))

"""Exact dedup by an extendible-hash index on shared files.

1. Each map task chains its own equal texts, so that a text held by a third of
   all rows leaves a task as one entry.  Entries (64-bit hash, text, the list of
   row ids) are written to the shared folder.
2. A directory is grown over the hash's leading bits: while a bucket holds more
   distinct keys than its capacity, it splits in two, and the directory doubles
   when the bucket already uses all directory bits.  Counting is distributed; the
   driver holds one integer per directory slot, at most ``2**MAX_DEPTH``.
3. Entries go to the owner tasks of their buckets, each bucket being a range of
   hash values.  An owner reads its ranges in key order, chains entries of equal
   hash and compares their bytes, so two texts that only collide stay apart.
4. Entry ids carry the verdict back to the rows: a join on a unique key.

Null texts count as empty.  Rows with a null id take part; they stay only if all
ids of their group are null.  Of rows repeating one id, one stays.  An empty
table gives an empty result.  Columns beside id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, clean, parallelism, rows_of, to_batch

#: Distinct keys that a bucket holds before it splits.
CAPACITY = 16_384
#: Directory bits; buckets at this depth grow chains in place of splitting.
MAX_DEPTH = 20
#: Bits that one counting pass tells apart.
STEP = 10
#: Text bytes after which a map task hands on its chains.
FLUSH_BYTES = 48 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ENTRY = pa.schema(
    [("entry", pa.int64()), ("h", pa.int64()), ("digest", pa.string()), ("body", pa.binary()), ("ids", pa.list_(pa.int64())), ("max_id", pa.int64()), ("n", pa.int64())]
)
_ENTRY_DDL = "entry long, h long, digest string, body binary, ids array<long>, max_id long, n long"
_VERDICT = pa.schema([("entry", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("winner", pa.bool_())])
_VERDICT_DDL = "entry long, keep_id long, group_size long, winner boolean"


def normalise(text: str | None) -> bytes:
    """Lower-case A-Z only, in UTF-8; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


def _chain_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base, seq = TaskContext.get().partitionId() << 32, 0
    chains: dict[bytes, list] = {}
    held = 0

    def flush():
        nonlocal seq, chains, held
        keys = list(chains)
        for at in range(0, len(keys), 1000):
            part = keys[at : at + 1000]
            ids = [chains[k] for k in part]
            yield to_batch(
                _ENTRY,
                [
                    [base + seq + i for i in range(len(part))],
                    [xxhash.xxh3_64_intdigest(k) - (1 << 63) for k in part],
                    [hashlib.sha256(k).hexdigest() for k in part],
                    part,
                    ids,
                    [max((x for x in v if x is not None), default=None) for v in ids],
                    [len(v) for v in ids],
                ],
            )
            seq += len(part)
        chains, held = {}, 0

    for batch in batches:
        for i, text in zip(*rows_of(batch, "id", "text")):
            key = normalise(text)
            if key in chains:
                chains[key].append(i)
                held += 8
            else:
                chains[key] = [i]
                held += len(key) + 200
        if held > FLUSH_BYTES:
            yield from flush()
    yield from flush()


def _chain_owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in key order; one chain at a time is held: a copy of each distinct text, and entry ids."""
    now, chain, out = None, [], []

    def close():
        for _, entries, most, n in chain:
            # a null id is less than any other; the first entry of several with the largest id wins
            win = min((e for e, m in entries if m == most), default=None)
            out.extend((e, most, n, e == win) for e, _ in entries)

    for batch in batches:
        for entry, h, body, most, n in zip(*rows_of(batch, "entry", "h", "body", "max_id", "n")):
            if h != now:
                close()
                now, chain = h, []
            for link in chain:
                if link[0] == body:
                    link[1].append((entry, most))
                    link[2] = most if link[2] is None else link[2] if most is None else max(link[2], most)
                    link[3] += n
                    break
            else:
                chain.append([body, [(entry, most)], most, n])
        if len(out) >= 2000:
            yield to_batch(_VERDICT, list(zip(*out)))
            out.clear()
    close()
    if out:
        yield to_batch(_VERDICT, list(zip(*out)))


def grow_directory(count, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, step: int = STEP) -> list[tuple[int, int, int]]:
    """Buckets as (prefix, local depth, distinct keys), in key order.

    ``count(depth, prefixes)`` gives the distinct keys by ``depth``-bit prefix below
    the given (prefix, depth) buckets, or all if None.
    """
    done: list[tuple[int, int, int]] = []
    todo, depth = None, 0
    while depth < max_depth:
        fine = min(depth + step, max_depth)
        seen = count(fine, todo)

        def split(prefix: int, local: int, members: dict[int, int]):
            keys = sum(members.values())
            if keys <= capacity or local == fine:
                (done if keys <= capacity or fine == max_depth else over).append((prefix, local, keys))
                return
            halves: tuple[dict[int, int], dict[int, int]] = ({}, {})
            for p, n in members.items():
                halves[p >> (fine - local - 1) & 1][p] = n
            for bit in (0, 1):
                split(prefix << 1 | bit, local + 1, halves[bit])

        over: list[tuple[int, int, int]] = []
        for prefix, local, _ in todo or [(0, 0, 0)]:
            split(prefix, local, {p: n for p, n in seen.items() if p >> (fine - local) == prefix})
        todo, depth = over, fine
        if not todo:
            break
    return sorted(done, key=lambda b: b[0] << (max_depth - b[1]))


def _prefix(bits: int):
    """Leading bits of the hash, as unsigned order."""
    return F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits)


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    ws = Workspace(spark, "exact")
    entries = ws.save(clean(docs, id=id_col, text=text_col).mapInArrow(_chain_locally, _ENTRY_DDL), "entries")
    keys = entries.select("h").distinct()

    def count(bits: int, below):
        got = keys.groupBy(_prefix(bits).alias("p")).agg(F.count("*").alias("n"))
        if below:
            shift = bits - below[0][1]
            got = got.where(F.shiftrightunsigned("p", shift).isin([b[0] for b in below]))
        return {r.p: r.n for r in got.collect()}

    buckets = grow_directory(count, capacity)
    depth = max([b[1] for b in buckets], default=0)
    starts = [(b[0] << (depth - b[1]), i) for i, b in enumerate(buckets)]
    # the directory: slot -> bucket, doubled to the deepest bucket's bits
    slots = [i for (start, i), (end, _) in zip(starts, [*starts[1:], (1 << depth, 0)]) for _ in range(end - start)]
    if depth:
        directory = spark.createDataFrame(list(enumerate(slots)), "slot long, bucket long")
        if len(slots) <= 1 << 16:
            directory = F.broadcast(directory)
        placed = entries.withColumn("slot", _prefix(depth)).join(directory, "slot")
    else:
        placed = entries.withColumn("bucket", F.lit(0).cast("long"))
    owners = min(max(parallelism(spark), 1), max(len(buckets), 1) * 4)
    # buckets are key ranges; a range of few buckets still spreads over owners by its key
    placed = placed.select("bucket", "entry", "h", "body", "max_id", "n").repartition(owners, "bucket", F.pmod("h", F.lit(4)))
    verdicts = ws.save(placed.sortWithinPartitions("bucket", "h", "entry").mapInArrow(_chain_owned, _VERDICT_DDL), "index")
    rows = entries.select("entry", "digest", "ids").join(verdicts, "entry")
    first = F.array_position("ids", F.col("keep_id")) - 1
    first = F.when(F.col("keep_id").isNull(), F.lit(0)).otherwise(first)
    rows = rows.withColumn("at", F.when(F.col("winner"), first).otherwise(F.lit(-1))).select(
        "keep_id", "group_size", "at", "digest", F.posexplode("ids").alias("pos", "doc_id")
    )
    return ws.finish(
        rows.select(
            F.col("doc_id").alias(id_col),
            "keep_id",
            "group_size",
            (F.col("pos") == F.col("at")).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )

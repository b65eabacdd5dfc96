"""Approximate nearest neighbours by a permutation index.

1. Pivots are a bounded sample of distinct vectors, ``PIVOTS`` of them at most: those with
   the least hashes.
2. A vector is represented by its ``NEAREST`` pivots in order of distance, and
   posted, with its ranks, in the inverted file of each.  The inverted files of a
   block of vectors are built once and stored as one row, with the vectors.
3. A query reads the inverted files of its own nearest pivots, some tens out of
   thousands; vectors in none of them are never met.  Candidates are ranked by
   footrule distance: the sum of rank differences, a pivot that either lacks
   counting as rank ``NEAREST``.
4. The best candidates of each block of vectors are scored exactly, in double
   precision, and the best of all blocks are returned.  A block in which a query
   meets no more than a result's vectors is filled up, so no result is short.

Nearness is the largest inner product.  Vectors are first lengthened by one
component to the greatest norm of all, after which the nearest by angle is that of
the largest inner product.

A block's task reads its index row once and takes the queries as they come, so its memory
is bounded by the block.  Equal vectors are one: the index holds a vector's least ids, as many as a result
can use, so a vector that a third of all rows share stays one entry.  Blocks are
dealt by vector, and each gives a bounded number of results per query, so no
inverted file is ever gathered in one task.

Vectors that are null, empty, zero, of another length than most or with null or
non-finite components take no part, neither as queries nor as candidates.  Rows
without an id don't either.  Of rows repeating an id, each counts.  Components are taken
as doubles throughout.  An empty table gives no rows.  Only id and vector are read, so
other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, clean, parallelism, spread_join, to_batch

PIVOTS = 4096
NEAREST = 48
#: Of the candidates of one block, so many times k are scored exactly.
RERANK = 60
#: Vectors of a block and their bytes, at most; queries that a task takes; vectors compared with all pivots at a time.
BLOCK = 8192
BLOCK_BYTES = 32 << 20
QUERIES = 2048
CHUNK = 512
K = 20

_INDEX = pa.schema([("block", pa.int32()), ("vectors", pa.binary()), ("ids", pa.binary()), ("edges", pa.binary()), ("rows", pa.binary()), ("ranks", pa.binary()), ("starts", pa.binary())])
_INDEX_DDL = "block int, vectors binary, ids binary, edges binary, rows binary, ranks binary, starts binary"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dim)


def _lengthen(x: np.ndarray, most: float) -> np.ndarray:
    """One more component, so that all norms are ``most``; queries get zero there."""
    rest = np.sqrt(np.maximum(most * most - np.einsum("ij,ij->i", x, x), 0.0))
    return np.concatenate((x, rest[:, None]), 1)


def permutations(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first."""
    k = min(nearest, len(pivots))
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), CHUNK):
        far = -(x[at : at + CHUNK] @ pivots.T)
        part = np.argpartition(far, k - 1, axis=1)[:, :k]
        order = np.argsort(np.take_along_axis(far, part, 1), axis=1, kind="stable")
        out[at : at + CHUNK] = np.take_along_axis(part, order, 1)
    return out


class InvertedFiles:
    """Postings of a block of vectors: for each pivot, the vectors near it and the pivot's rank there."""

    def __init__(self, n: int, k: int, edges: np.ndarray, rows: np.ndarray, ranks: np.ndarray):
        self.n, self.k, self.edges, self.rows, self.ranks = n, k, edges, rows, ranks

    @classmethod
    def build(cls, perms: np.ndarray, pivots: int) -> InvertedFiles:
        n, k = perms.shape
        flat = perms.ravel()
        order = np.argsort(flat, kind="stable")
        edges = np.searchsorted(flat[order], np.arange(pivots + 1))
        return cls(n, k, edges.astype(np.int64), (order // k).astype(np.int32), (order % k).astype(np.int32))

    def footrule(self, perm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors that share a pivot with one query's permutation, and their distances from it."""
        lists = [slice(lo, hi) for lo, hi in zip(self.edges[perm].tolist(), self.edges[perm + 1].tolist())]
        rows = np.concatenate([self.rows[x] for x in lists])
        theirs = np.concatenate([self.ranks[x] for x in lists])
        mine = np.repeat(np.arange(len(perm)), [x.stop - x.start for x in lists])
        # as if no pivot were shared, all ranks of both sides would differ from the worst
        gain = np.bincount(rows, 2 * self.k - mine - theirs - np.abs(mine - theirs), self.n)
        met = np.flatnonzero(gain)
        return met, self.k * (self.k + 1) - gain[met].astype(np.int64)


def nearest(spark: SparkSession, vectors: DataFrame, queries=None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, pivots: int = PIVOTS, nearest_pivots: int = NEAREST, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score for each query, nearest first, ties to the smaller id.

    ``queries`` is a condition on the column ``id`` (default: ids divisible by 20).
    """
    ws = Workspace(spark, "ann")
    rows = clean(vectors, id=id_col, v=vector_col).withColumn("v", F.col("v").cast("array<double>"))
    fine = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    fine &= F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(fine)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim = sizes[0].d if sizes else 1
    rows = rows.where(F.size("v") == dim).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # one zero
    condition = F.col("id") % 20 == 0 if queries is None else queries

    # equal vectors once, with their least ids; a query leaves itself out, hence one more than k
    least = rows.groupBy("v").agg(F.min("id").alias("head"), F.count("*").alias("n"))
    single = least.where("n = 1").select("v", F.array("head").alias("ids"))
    many = spread_join(rows, least.where("n > 1").select("v", "n"), ["v"], rows.count())
    salted = many.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    for keys in (["v", "salt"], ["v"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
        salted = salted.withColumn("place", place).where(F.col("place") <= k + 1)
    several = salted.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # at most k + 1 ids
    entries = ws.save(single.unionByName(several), "entries")

    norms = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    most = float(entries.agg(F.max(F.sqrt(norms)).alias("m")).first().m or 1.0)
    # a fixed sample, bounded by the number of pivots: least hashes of the vectors, sought among about twice as many
    total = entries.count()
    part = F.pmod(F.xxhash64("v"), F.lit(1 << 32)) < F.lit(int(min(1.0, 2 * pivots / max(1, total)) * (1 << 32)))
    sample = entries.select("v").where(part).orderBy(F.pmod(F.xxhash64("v"), F.lit(1 << 32)), "v").limit(pivots).collect()
    centres = _lengthen(np.array([r.v for r in sample], np.float64).reshape(-1, dim), most)
    shared = spark.sparkContext.broadcast(centres)  # at most PIVOTS vectors
    wanted = rows.where(condition).select(F.col("id").alias("q"), "v")
    wanted = ws.save(wanted, "queries")

    n_blocks = total // max(1, min(BLOCK, BLOCK_BYTES // (8 * dim))) + 1

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close():
            x = np.concatenate([_matrix(b.column(b.schema.get_field_index("v")), dim) for b in held])
            ids = pa.concat_arrays([b.column(b.schema.get_field_index("ids")) for b in held])
            files = InvertedFiles.build(permutations(_lengthen(x, most), shared.value, nearest_pivots), len(shared.value))
            starts = np.cumsum([0, *ids.value_lengths().to_pylist()], dtype=np.int64)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield to_batch(_INDEX, [[now], *([a.tobytes()] for a in (x, flat, files.edges, files.rows, files.ranks, starts))])

        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("block")).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
            for a, b in zip(edges, edges[1:]):
                if keys[a] != now:
                    if held:
                        yield from close()
                    now, held = int(keys[a]), []
                held.append(batch.slice(a, b - a))
        if held:
            yield from close()

    blocks = entries.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(n_blocks)).cast("int"))
    blocks = blocks.repartition(parallelism(spark), "block").sortWithinPartitions("block")
    index = ws.save(blocks.select("block", "v", "ids").mapInArrow(build, _INDEX_DDL), "index")
    # a block's queries are dealt over some tasks, each of which gets the block's index row
    groups = max(1, min(wanted.count() // QUERIES + 1, parallelism(spark) // n_blocks + 1))
    asked = wanted.withColumn("g", F.pmod(F.xxhash64("q", "v"), F.lit(groups)).cast("int"))
    schema = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    parts = [f.name for f in _INDEX][1:]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = shared.value
        width = min(nearest_pivots, len(pivot))
        now = None
        top = rerank * k

        def answer(part: pa.RecordBatch) -> pa.RecordBatch:
            q_ids = part.column(part.schema.get_field_index("q")).to_numpy(zero_copy_only=False).astype(np.int64)
            q = _matrix(part.column(part.schema.get_field_index("v")), dim)
            q_perm = permutations(np.concatenate((q, np.zeros((len(q), 1))), 1), pivot, nearest_pivots)
            out_q, out_v, out_s = [], [], []
            for i in range(len(q)):
                if len(x) <= top:
                    near = np.arange(len(x))
                else:
                    near, far = files.footrule(q_perm[i])
                    if len(near) > top:
                        near = near[np.argpartition(far, top)[:top]]
                    elif len(near) <= k:
                        near = np.union1d(near, np.arange(2 * k + 1))
                score = x[near] @ q[i]
                # equal vectors have several ids; take enough of the best to be sure of k ids
                best = np.lexsort((near, -score))
                if len(best) > k + 1:
                    edge = score[best[k]]
                    best = best[score[best] >= edge]
                found = [(-score[j], v) for j in best.tolist() for v in ids[starts[near[j]] : starts[near[j] + 1]].tolist() if v != q_ids[i]]
                found.sort()
                for s, v in found[:k]:
                    out_q.append(int(q_ids[i]))
                    out_v.append(v)
                    out_s.append(-s)
            return to_batch(schema, [out_q, out_v, out_s])

        for batch in batches:
            keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("block", "g")], 1)
            is_index = batch.column(batch.schema.get_field_index("q")).is_null().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1) | is_index[1:] | is_index[:-1], [True])))
            for a, b in zip(edges, edges[1:]):
                part = batch.slice(a, b - a)
                if is_index[a]:
                    now = tuple(keys[a])
                    raw, ids, post_edges, post_rows, post_ranks, starts = (part.column(part.schema.get_field_index(c))[0].as_buffer() for c in parts)
                    x = np.frombuffer(raw, np.float64).reshape(-1, dim)
                    ids, starts = np.frombuffer(ids, np.int64), np.frombuffer(starts, np.int64)
                    files = InvertedFiles(len(x), width, np.frombuffer(post_edges, np.int64), np.frombuffer(post_rows, np.int32), np.frombuffer(post_ranks, np.int32))
                elif tuple(keys[a]) == now:  # else a block without vectors
                    for at in range(0, part.num_rows, CHUNK):
                        yield answer(part.slice(at, CHUNK))

    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    none = [F.lit(None).cast("binary").alias(c) for c in parts]
    left = index.select("block", every_group.alias("g"), F.lit(None).cast("long").alias("q"), F.lit(None).cast("array<double>").alias("v"), *parts)
    right = asked.select(every_block.alias("block"), "g", "q", "v", *none)
    both = left.unionByName(right).withColumn("late", F.col("q").isNotNull())
    both = both.repartition(parallelism(spark), "block", "g").sortWithinPartitions("block", "g", "late").drop("late")
    found = ws.save(both.mapInArrow(search, "q long, vec_id long, score double"), "found")
    shared.unpersist()
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ws.finish(ranked.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score"))

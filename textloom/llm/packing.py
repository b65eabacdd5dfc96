"""Packing of whole documents into fixed windows by non-negative least squares.

A document's ids (and a closing id) are cut into full windows and a remainder
shorter than a window.  Full windows are sequences as they are.  Remainders are
packed by their histogram of lengths, which has one bin for each length and so
doesn't grow with the corpus:

1. enumerate combinations of up to three lengths that fill a window;
2. solve repeat counts against the histogram by non-negative least squares,
   and round them down to what the histogram holds;
3. pack what is left greedily, longest first; what still fits nowhere is cut to
   fill the slack.  So at most one sequence has padding.

The plan is a list of rank intervals for each length, of at most some thousand
rows, and documents find their places in it by their rank among remainders of
their length.  Ranks come from counts for each map task, so a length that a third
of all documents share is never gathered in one task.

Ids are those of the tokenizers library by default: the vocabulary's special tokens
are found in texts, and none is added.  Null texts count as empty: they hold the
closing id only.  Null or repeated ids of documents are kept as they are.  Very long
texts become many full windows.  An empty table gives no pieces.  Of the input's
columns only id and text are read, so others can't clash.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import ByteBPE, default_path
from .common import Workspace, clean, rows_of, to_batch

WINDOW = 1024
#: Shortest part of a three-part combination comes in steps of this many tokens.
GRID = 64
SWEEPS = 200

_TOKENS = pa.schema(
    [("id", pa.int64()), ("chunk", pa.int64()), ("row", pa.int64()), ("tokens", pa.int64()), ("full_crcs", pa.list_(pa.int64())), ("full_rank", pa.int64()), ("rem_len", pa.int32()), ("rem_rank", pa.int64()), ("rem_crc", pa.int64()), ("rem", pa.binary())]
)
_TOKENS_DDL = "id long, chunk long, row long, tokens long, full_crcs array<long>, full_rank long, rem_len int, rem_rank long, rem_crc long, rem binary"
_PIECE = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("chunk", pa.int64()), ("row", pa.int64())]
)
_PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, chunk long, row long"


def crc(ids: np.ndarray) -> int:
    """CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def combinations(window: int, grid: int = GRID) -> list[tuple[int, ...]]:
    """Up to three lengths, longest first, that fill the window exactly."""
    out = [(window,)] + [(window - a, a) for a in range(1, window // 2 + 1)]
    for c in range(grid, window // 3 + 1, grid):
        out += [(window - c - b, b, c) for b in range(c, (window - c) // 2 + 1)]
    return out


def solve(histogram: np.ndarray, combos: list[tuple[int, ...]], sweeps: int = SWEEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, by coordinate descent."""
    rest = histogram.astype(float).tolist()
    parts = [sorted((n, c.count(n)) for n in set(c)) for c in combos]
    norms = [float(sum(k * k for _, k in p)) for p in parts]
    x = [0.0] * len(combos)
    for _ in range(sweeps):
        moved = 0.0
        for j, p in enumerate(parts):
            step = sum(k * rest[n] for n, k in p) / norms[j]
            if (step := max(step, -x[j])) != 0.0:
                x[j] += step
                for n, k in p:
                    rest[n] -= k * step
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return np.array(x)


def plan(histogram: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int, int, int]], int]:
    """Places for remainders: rows (length, first rank, last rank + 1, cut from, cut length, first sequence, offset).

    Item ``r`` of the ranks goes to sequence ``first sequence + r - first rank``.
    Returns the rows and the number of sequences.
    """
    rows: list[tuple[int, int, int, int, int, int, int]] = []
    sequences = 0
    left = histogram.astype(np.int64).copy()
    taken = np.zeros(len(left), np.int64)
    combos = combinations(window)
    x = solve(left, combos)
    for j in np.argsort(-x, kind="stable"):
        times = int(np.floor(x[j] + 1e-6))
        if times < 1:
            break
        need = defaultdict(int)
        for n in combos[j]:
            need[n] += 1
        times = min([times, *(int(left[n]) // k for n, k in need.items())])
        if times < 1:
            continue
        offset = 0
        for n in combos[j]:
            rows.append((n, int(taken[n]), int(taken[n]) + times, 0, n, sequences, offset))
            taken[n] += times
            left[n] -= times
            offset += n
        sequences += times
    # items by what remains of them: rank intervals (length, cut from, first rank, last rank + 1)
    pool: dict[int, list[tuple[int, int, int, int]]] = {
        n: [(n, 0, int(taken[n]), int(taken[n] + left[n]))] for n in range(1, window + 1) if left[n] > 0
    }

    def count(n: int) -> int:
        return sum(hi - lo for _, _, lo, hi in pool.get(n, ()))

    def take(n: int, times: int, used: int, first: int, offset: int) -> None:
        """Put ``used`` tokens of ``times`` items of size n into the sequences from ``first`` on."""
        rest = []
        while times:
            origin, start, lo, hi = pool[n].pop()
            k = min(times, hi - lo)
            if hi - lo > k:
                pool[n].append((origin, start, lo + k, hi))
            rows.append((origin, lo, lo + k, start, used, first, offset))
            if used < n:
                rest.append((origin, start + used, lo, lo + k))
            first += k
            times -= k
        if not pool[n]:
            del pool[n]
        if rest:
            pool.setdefault(n - used, []).extend(rest)

    while pool:
        sizes = sorted(pool, reverse=True)
        free, parts, uses = window, [], defaultdict(int)
        for n in sizes:
            k = min(free // n, count(n))
            if k:
                parts.append((n, k))
                uses[n] += k
                free -= k * n
        times = min(count(n) // k for n, k in parts)
        cut = 0
        if free:
            # the smallest larger item that remains gives up its beginning
            for n in reversed(sizes):
                spare = count(n) - uses[n]
                if n > free and spare > 0:
                    cut = n
                    times = max(1, min(times, count(n) // (uses[n] + 1)))
                    break
        offset = 0
        for n, k in parts:
            for _ in range(k):
                take(n, times, n, sequences, offset)
                offset += n
        if cut:
            take(cut, times, free, sequences, offset)
        sequences += times
    return rows, sequences


def pack(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, closing_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer or default_path("byte_bpe_50k.json")
    ws = Workspace(spark, "pack")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE.get(path, special=True)
        chunk, row, full = TaskContext.get().partitionId(), 0, 0
        ranks: dict[int, int] = defaultdict(int)
        for batch in batches:
            keys, texts = rows_of(batch, "id", "text")
            out = []
            for key, ids in zip(keys, bpe.encode_batch(texts)):
                ids = np.append(ids, bpe.wide(closing_id))
                n = len(ids) // window
                rem = ids[n * window :]
                crcs = [crc(ids[i * window : (i + 1) * window]) for i in range(n)]
                out.append((key, chunk, row, len(ids), crcs, full, len(rem), ranks[len(rem)], crc(rem), rem.astype("<u4" if bpe.wide is np.uint32 else "<u2").tobytes()))
                row += 1
                full += n
                ranks[len(rem)] += 1
            yield to_batch(_TOKENS, list(zip(*out)) if out else [[]] * len(_TOKENS))

    tokens = ws.save(clean(docs, id=id_col, text=text_col).mapInArrow(tokenise, _TOKENS_DDL), "tokens")
    counts = tokens.groupBy("chunk", "rem_len").agg(F.count("*").alias("n"), F.sum(F.size("full_crcs")).alias("full"))
    counts = ws.save(counts, "counts")
    histogram = np.zeros(window + 1, np.int64)
    for r in counts.where("rem_len > 0").groupBy("rem_len").agg(F.sum("n").alias("n")).collect():  # at most one row per length
        histogram[r.rem_len] = r.n
    rows, sequences = plan(histogram, window)

    # first rank of a task's remainders among all of that length, and of its full windows among all
    by_len = Window.partitionBy("rem_len").orderBy("chunk")
    tasks = counts.groupBy("chunk").agg(F.sum("full").alias("full"))  # one row per map task
    tasks = tasks.select("chunk", F.coalesce(F.sum("full").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full_base"))
    bases = counts.select("chunk", "rem_len", F.coalesce(F.sum("n").over(by_len.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rem_base")).join(tasks, "chunk")

    table: dict[int, list] = defaultdict(list)
    for r in rows:
        table[r[0]].append(r[1:])
    # by length: intervals of ranks without overlap, each with its pieces
    lookup: dict[int, tuple[np.ndarray, list[list]]] = {}
    for n, found in table.items():
        edges = sorted({e for f in found for e in f[:2]})
        cells: list[list] = [[] for _ in edges]
        index = {e: i for i, e in enumerate(edges)}
        for lo, hi, start, used, first, offset in found:
            for i in range(index[lo], index[hi]):
                cells[i].append((start, used, first - lo, offset))
        lookup[n] = (np.array(edges, np.int64), [sorted(c) for c in cells])
    shared = spark.sparkContext.broadcast(lookup)  # at most some thousand intervals, whatever the corpus

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = shared.value
        for batch in batches:
            out = []
            for key, chunk, row, n_tokens, crcs, full, n, rank, whole in zip(*rows_of(batch, "id", "chunk", "row", "tokens", "full_crcs", "full_rank", "rem_len", "rem_rank", "rem_crc")):
                for i, c in enumerate(crcs):
                    out.append((key, i * window, window, c, n_tokens, sequences + full + i, 0, chunk, row))
                if n:
                    edges, cells = lookup[n]
                    base = len(crcs) * window
                    for start, used, shift, offset in cells[int(np.searchsorted(edges, rank, "right")) - 1]:
                        out.append((key, base + start, used, whole if used == n else None, n_tokens, rank + shift, offset, chunk, row))
            if out:
                yield to_batch(_PIECE, list(zip(*out)))

    placed = tokens.drop("rem").join(bases, ["chunk", "rem_len"]).select(
        "id", "chunk", "row", "tokens", "full_crcs", (F.col("full_rank") + F.col("full_base")).alias("full_rank"), "rem_len", (F.col("rem_rank") + F.col("rem_base")).alias("rem_rank"), "rem_crc"
    )
    pieces = ws.save(placed.mapInArrow(place, _PIECE_DDL), "pieces")

    cut_schema = pa.schema([*_PIECE])
    wide = "<u4" if ByteBPE.get(path, special=True).wide is np.uint32 else "<u2"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in _PIECE]
        for batch in batches:
            cols = rows_of(batch, *names, "rem")
            rem = cols.pop()
            cols[3] = [crc(np.frombuffer(r, wide)[(s := start % window) : s + n]) for r, start, n in zip(rem, cols[1], cols[2])]
            yield to_batch(cut_schema, cols)

    cut = pieces.where("ids_crc32 IS NULL").join(tokens.select("chunk", "row", "rem"), ["chunk", "row"])
    cut = cut.select(*[f.name for f in _PIECE], "rem").mapInArrow(sums, _PIECE_DDL)
    both = pieces.where("ids_crc32 IS NOT NULL").unionByName(cut).drop("chunk", "row")
    return ws.finish(both.withColumnRenamed("doc_id", id_col))


def packed_sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence: its pieces in order, tokens held, padded length (a power of two stays as it is)."""
    held = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("tokens"), F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length"))).alias("pieces")
    )
    power = F.col("tokens").bitwiseAND(F.col("tokens") - 1) == 0
    return held.withColumn("padded_to", F.when(power, F.col("tokens")).otherwise(F.lit(WINDOW)))

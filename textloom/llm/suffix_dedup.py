"""Suffix-array dedup: bytes covered by a 400-byte string that starts anywhere else go.

Only suffixes that can matter are sorted:

1. *Anchors.*  Each 400-byte window picks the least 32-byte hash in it, so equal
   windows pick the same place in themselves.  Windows of neighbouring starts with
   one anchor form a segment, about one per 185 bytes.  A merged sketch of anchor
   counts (``sketch``) drops segments whose anchor occurs once; none with a match
   is lost.
2. *Segments.*  Segments left are grouped by a 128-bit digest of the bytes that
   their windows cover.  Those that occur twice are repeated as a whole, which
   settles the inside of long copies and leaves one of each set of equals.  A map
   task hands on equal segments of its own once.
3. *Blocks.*  The segments left are range partitioned by anchor and read in blocks
   of bounded size.  In a block, a difference cover modulo 32 picks sample
   positions, whose strings are ranked by doubling.  Suffixes are sorted a bucket
   at a time by their head and tail; ties, however long, are resolved in one
   comparison of the ranks of two samples at the same distance from both.
4. *Hot anchors.*  An anchor whose segments don't end inside one block hands on
   digests of its windows, each once per block, and these are grouped exactly by
   digest, so its suffixes never have to meet in one task.

Matches never cross documents, since windows don't.  Null texts are empty; texts
under 400 bytes are kept as they are.  Rows repeating an id are told apart by their
texts.  Digests have 128 bits.  Very long texts are winnowed whole, as one row of their
batch, and travel as segments of bounded size.  An empty table gives no rows.  Only id,
text and the columns to carry are read, the latter inside a struct, so names can't clash.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sketch
from .common import Workspace, clean, parallelism, rows_of, to_batch
from .substring_dedup import NULL_ID, bucket_column, bucket_of, corpus_bytes, pack_pairs, unpack_pairs
from .windows import mix, utf8

LENGTH = 400
GRAM = 32
PERIOD = 32
#: Bytes that winnowing takes at once, and that one block of segments holds.
PIECE = 1 << 20
BLOCK = 3 << 20
#: Text whose segments a map task settles together.
LOCAL = 24 << 20
#: Buckets in which a block's suffixes are sorted, one at a time.
SUFFIX_BUCKETS = 4
#: Digests of windows that a block hands on at a time.
DIGESTS = 1 << 16
#: Corpus bytes for each bucket of documents.
PER_BUCKET = 8 << 20

_M = np.uint64(0x9E3779B97F4A7C15)


def difference_cover(period: int) -> list[int]:
    """Residues of which some two have each difference, found greedily."""
    cover, open_ = [0], set(range(1, period))
    while open_:
        cover.append(max(range(period), key=lambda r: len({(s * (r - c)) % period for c in cover for s in (1, -1)} & open_)))
        open_ -= {(a - b) % period for a in cover for b in cover}
    return sorted(cover)


COVER = difference_cover(PERIOD)
#: Distance at which positions of two residues both meet the cover.
SHIFT = np.array([[next(d for d in range(PERIOD) if (i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER) for j in range(PERIOD)] for i in range(PERIOD)], np.int64)


def _words_at(text: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Eight bytes from each position, as integers."""
    view = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    return view.copy() if at is None else view[at]


def winnow(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Segments of the texts, some texts at a time: (first text, text, first window, windows, anchor's hash)."""
    at, held, first = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t)
        at += len(t)
        if at >= PIECE or i == len(texts) - 1:
            if at >= length:
                yield (first, *_winnow(held, length))
            first, held, at = i + 1, [], 0


def _winnow(texts: list[bytes], length: int):
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    w = _words_at(raw)
    n = len(raw) - GRAM + 1
    h = w[:n].copy()
    for j in (8, 16, 24):
        h *= _M
        h ^= h >> np.uint64(29)
        h += w[j : j + n]
    h = mix(h)
    bits = np.uint64(max(1, int(n).bit_length()))
    key = (h >> bits << bits) | np.arange(n, dtype=np.uint64)
    span = length - GRAM + 1
    full = -(-n // span) * span
    grid = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = key
    grid = grid.reshape(-1, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - span + 1], ahead[span - 1 : n])
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    p = np.arange(len(anchor))
    ok = p + length <= (starts + sizes)[text]
    p, anchor, text = p[ok], anchor[ok], text[ok]
    if not len(p):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    first = np.ones(len(p), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    return text[at], p[at] - starts[text[at]], np.diff(at, append=len(p)), h[anchor[at]]


def repeated_suffixes(texts: list[bytes], windows: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, for each of its first windows, the number of its class among all windows given; -1 if alone.

    Windows are suffixes cut at ``length`` bytes; classes are of equal ones.
    """
    raw = np.frombuffer(b"".join(texts) + bytes(GRAM + 8), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    counts = np.array(windows, np.int64)
    p = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    w = _words_at(raw)

    # ranks of sample strings of ``deep`` bytes, by doubling from one period's bytes
    residues = np.array(COVER)
    periods = len(raw) // PERIOD
    sample = (np.arange(periods)[:, None] * PERIOD + residues).ravel()
    sample = sample[sample + PERIOD <= len(raw) - 7]
    name = np.zeros(len(sample), np.int64)
    order = np.lexsort([w[sample + j] for j in range(0, PERIOD, 8)])
    differ = np.zeros(len(sample), bool)
    for j in range(0, PERIOD, 8):
        v = w[sample[order] + j]
        differ[1:] |= v[1:] != v[:-1]
    name[order] = np.cumsum(differ)
    deep = PERIOD
    most = (length - PERIOD) // PERIOD * PERIOD
    while deep < most:
        step = min(deep, most - deep)
        shift = step // PERIOD * len(COVER)
        later = np.zeros(len(name), np.int64)
        later[: len(name) - shift] = name[shift:] + 1
        name = np.unique(name * (len(name) + 2) + later, return_inverse=True)[1].astype(np.int64)
        deep += step
    index = np.full(PERIOD, -1)
    index[residues] = np.arange(len(residues))

    def rank(at: np.ndarray) -> np.ndarray:
        return name[at // PERIOD * len(COVER) + index[at % PERIOD]]

    head = [*range(0, PERIOD, 8)]
    tail = [*range(deep, length - 7, 8), length - 8]
    key = np.zeros(len(p), np.uint64)
    for j in head + tail:
        key *= _M
        key ^= key >> np.uint64(31)
        key += w[p + j]
    key = mix(key)

    out = np.full(len(p), -1, np.int64)
    classes = 0
    for bucket in range(SUFFIX_BUCKETS):
        mine = np.flatnonzero(key % np.uint64(SUFFIX_BUCKETS) == bucket)
        mine = mine[np.argsort(key[mine], kind="stable")]
        while len(mine):
            k = key[mine]
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            group = np.cumsum(new) - 1
            size = np.bincount(group)
            tied = size[group] > 1
            mine, group, new = mine[tied], group[tied], new[tied]
            if not len(mine):
                break
            leader = mine[new][np.cumsum(new) - 1]
            a, b = p[leader], p[mine]
            d = SHIFT[a % PERIOD, b % PERIOD]
            same = rank(a + d) == rank(b + d)
            for j in head + tail:
                same &= w[a + j] == w[b + j]
            number = classes + np.cumsum(new) - 1
            shared = np.bincount(number[same] - classes, minlength=int(new.sum()))
            hit = same & (shared[number - classes] > 1)
            out[mine[hit]] = number[hit]
            classes += int(new.sum())
            mine = mine[~same]  # others of the bucket than the leader's class
    return np.split(out, np.cumsum(counts)[:-1])


_SEGMENT, _FLAG, _DIGEST = 0, 1, 2
_ROW = pa.schema(
    [("kind", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary()), ("d1", pa.int64()), ("d2", pa.int64()), ("anchor", pa.int64()), ("id", pa.int64()), ("text_hash", pa.int64()), ("p", pa.int64()), ("windows", pa.int32()), ("many", pa.bool_())]
)
_ROW_DDL = "kind int, bucket int, payload binary, d1 long, d2 long, anchor long, id long, text_hash long, p long, windows int, many boolean"


def _emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 1000):
        yield to_batch(_ROW, list(zip(*rows[at : at + 1000])))


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _flag_rows(spans: dict[tuple[int, int], list[tuple[int, int]]], buckets: int) -> list[tuple]:
    """Spans to remove, packed by bucket of documents."""
    by: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    for (i, h), found in spans.items():
        for a, b in _merge(found):
            by[int(bucket_of(i, buckets))].append((i, h, a, b))
    out = []
    for bucket, rows in by.items():
        ids, h, a, b = (np.array(x, np.int64) for x in zip(*rows))
        out.append((_FLAG, bucket, pack_pairs(ids, h, a, b), *[None] * 8))
    return out


def _digest_rows(found: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]], bodies: list[bytes], buckets: int, length: int) -> list[tuple]:
    """Digests of windows, each segment's given as (id, text hash, starts in the text, starts in the body, known to be repeated), packed by bucket of digest."""
    if not found:
        return []
    sizes = [len(f[2]) for f in found]
    ids, h = (np.repeat(np.array(x, np.int64), sizes) for x in list(zip(*found))[:2])
    p, known = np.concatenate([f[2] for f in found]), np.concatenate([f[4] for f in found])
    views = [(memoryview(body), f[3].tolist()) for body, f in zip(bodies, found)]
    digests = b"".join(xxhash.xxh3_128_digest(view[j : j + length]) for view, at in views for j in at)
    d1, d2 = np.frombuffer(digests, ">i8").astype(np.int64).reshape(-1, 2).T
    to = d1 % buckets
    order = np.argsort(to, kind="stable")
    edges = np.flatnonzero(np.diff(to[order], prepend=-1, append=-1))
    out = []
    for a, b in zip(edges, edges[1:]):
        at = order[a:b]
        out.append((_DIGEST, int(to[at[0]]), pack_pairs(ids[at], d1[at], d2[at], h[at], p[at], known[at]), *[None] * 8))
    return out


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def suffix_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_text: bool = False, carry: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text if wanted).

    In kept_text, halves of characters that a span cuts through are left out.  Columns
    named in ``carry`` come along as the struct ``carried``.
    """
    ws = Workspace(spark, "suffix")
    whole = docs
    docs = clean(docs, id=id_col, text=text_col)
    size = corpus_bytes(docs)
    bits = sketch.bits_for(size / 64)
    buckets = max(parallelism(spark), int(size / PER_BUCKET) + 1)
    tasks = parallelism(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, _, _, _, h in winnow([utf8(t) for t in batch.column(1).to_pylist()], length):
                held.append(h)
                n += len(h)
            if n > 1 << 20:
                yield sketch.count_cells(np.concatenate(held), bits)
                held, n = [], 0
        if n:
            yield sketch.count_cells(np.concatenate(held), bits)

    table = sketch.merge(spark, docs.mapInArrow(count, sketch.CELLS_DDL), bits)
    ws.release()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list] = {}
        spans: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        read = 0

        def close():
            rows = _flag_rows(spans, buckets)
            for digest, (many, anchor, i, h, p, n, body) in found.items():
                rows.append((_SEGMENT, None, body, *_halves(digest), anchor, i, h, p, n, many))
            found.clear()
            spans.clear()
            return _emit(rows)

        for batch in batches:
            ids, texts = rows_of(batch, "id", "text")
            texts = [utf8(t) for t in texts]
            hashes = [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in texts]
            for base, text, p, n, h in winnow(texts, length):
                keep = sketch.maybe_repeated(h, table.value, bits)
                for t, a, k, anchor in zip((text[keep] + base).tolist(), p[keep].tolist(), n[keep].tolist(), h[keep].view(np.int64).tolist()):
                    end = a + k - 1 + length
                    body = texts[t][a:end]
                    digest = xxhash.xxh3_128_digest(body)
                    doc = (NULL_ID if ids[t] is None else ids[t], hashes[t])
                    old = found.get(digest)
                    if old is None:
                        found[digest] = [False, anchor, *doc, a, k, body]
                    else:
                        if not old[0]:
                            old[0] = True
                            spans[old[2], old[3]].append((old[4], old[4] + old[5] - 1 + length))
                        spans[doc].append((a, end))
            read += sum(map(len, texts))
            if read > LOCAL:
                yield from close()
                read = 0
        yield from close()

    parts = ws.save(docs.mapInArrow(segments, _ROW_DDL), "segments", ["kind"])
    table.unpersist()
    cols = [f.name for f in _ROW][2:]

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by digest: equal segments leave one row, and spans of those that occur twice."""
        spans: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        held, out = [], []

        def close():
            many = len(held) > 1 or held[0][-1]
            for body, _, _, _, i, h, p, n, local in held:
                if many and not local:
                    spans[i, h].append((p, p + n - 1 + length))
            out.append((_SEGMENT, None, *held[0][:-1], many))

        for batch in batches:
            for row in zip(*rows_of(batch, *cols)):
                if held and row[1:3] != held[0][1:3]:
                    close()
                    held = []
                if held and len(held) > 1:
                    row = (None, *row[1:])  # one body is enough
                held.append(row)
            if len(out) > 500:
                yield from _emit(out)
                out = []
            if len(spans) > 20_000:
                yield from _emit(_flag_rows(spans, buckets))
                spans.clear()
        if held:
            close()
        yield from _emit(out + _flag_rows(spans, buckets))

    grouped = parts.where(f"kind = {_SEGMENT}").select(*cols).repartition(tasks, "d1", "d2").sortWithinPartitions("d1", "d2").mapInArrow(same, _ROW_DDL)
    distinct = ws.save(grouped, "distinct", ["kind"])
    ws.drop(f"segments/kind={_SEGMENT}")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by anchor: whole anchors fill a block; anchors at a task's edges, or over a block's size, stay open."""
        held: list[tuple] = []
        size, ending, began = 0, False, True

        def close(first_open: bool, last_open: bool):
            nonlocal held, size
            rows = held
            anchors = [r[3] for r in rows]
            lone = defaultdict(lambda: [0, 0])
            for r in rows:
                lone[r[3]][0] += 1
                lone[r[3]][1] += not r[-1]
            open_ = ({anchors[0]} if first_open else set()) | ({anchors[-1]} if last_open else set())
            use = [r for r in rows if r[3] in open_ or (lone[r[3]][0] > 1 and lone[r[3]][1])]
            held, size = [], 0
            if not use:
                return
            spans: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
            out, bodies, waiting = [], [], 0
            classes = repeated_suffixes([r[0] for r in use], [r[7] for r in use], length)
            told = np.zeros(max(int(found.max(initial=0)) for found in classes) + 1, bool)
            for r, found in zip(use, classes):
                body, _, _, anchor, i, h, p, n, many = r
                if not many:
                    hits = np.flatnonzero(found >= 0)
                    if len(hits):
                        edges = np.flatnonzero(np.diff(hits, prepend=-9) != 1)
                        for a, b in zip(edges, [*edges[1:], len(hits)]):
                            spans[i, h].append((p + int(hits[a]), p + int(hits[b - 1]) + length))
                if anchor in open_:
                    # one window of each class stands for the block's
                    first = np.zeros(len(found), bool)
                    first[np.unique(found, return_index=True)[1]] = True
                    first &= ~told[found]
                    first[found < 0] = True
                    told[found[found >= 0]] = True
                    j = np.flatnonzero(first)
                    out.append((i, h, p + j, j, (found[j] >= 0) | many))
                    bodies.append(body)
                    waiting += len(j)
                    if waiting > DIGESTS:
                        yield from _emit(_digest_rows(out, bodies, buckets, length))
                        out, bodies, waiting = [], [], 0
            yield from _emit(_digest_rows(out, bodies, buckets, length) + _flag_rows(spans, buckets))

        last = None
        for batch in batches:
            for row in zip(*rows_of(batch, *cols)):
                if size > block and held:
                    if row[3] != last:
                        yield from close(began, False)
                        began = False
                    elif held[0][3] == last or size > 2 * block:
                        # an anchor over a block's size: the next block begins with it, too
                        yield from close(True if held[0][3] == last else began, True)
                        began = True
                held.append(row)
                size += len(row[0])
                last = row[3]
        if held:
            yield from close(began, True)

    ranged = distinct.where(f"kind = {_SEGMENT}").select(*cols).repartitionByRange(tasks, "anchor", "d1").sortWithinPartitions("anchor", "d1", "d2")
    solved = ws.save(ranged.mapInArrow(blocks, _ROW_DDL), "solved", ["kind"])
    ws.drop(f"distinct/kind={_SEGMENT}")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digests come by bucket, each at most once from a block."""
        now, held = None, []

        def close():
            kinds = (*[np.int64] * 4, np.uint8)
            ids, d1, d2, h, p, known = (np.concatenate(x) for x in zip(*[unpack_pairs(x, *kinds) for x in held]))
            order = np.lexsort((d2, d1))
            ids, d1, d2, h, p, known = (x[order] for x in (ids, d1, d2, h, p, known))
            first = np.flatnonzero(np.concatenate(([True], (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1]))))
            size = np.diff(first, append=len(d1))
            again = np.repeat((size > 1) | (np.maximum.reduceat(known, first) > 0), size) & (known == 0)
            spans: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
            for i, x, a in zip(ids[again].tolist(), h[again].tolist(), p[again].tolist()):
                spans[i, x].append((a, a + length))
            return _emit(_flag_rows(spans, buckets))

        for batch in batches:
            for bucket, payload in zip(*rows_of(batch, "bucket", "payload")):
                if bucket != now and held:
                    yield from close()
                    held = []
                now = bucket
                held.append(payload)
        if held:
            yield from close()

    met = solved.where(f"kind = {_DIGEST}").select("bucket", "payload").repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, _ROW_DDL)
    met = ws.save(met, "met")
    ws.drop(f"solved/kind={_DIGEST}")

    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * keep_text)
    carried = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, spans = None, {}
        for batch in batches:
            out = []
            for bucket, payload, i, text in zip(*rows_of(batch, "bucket", "payload", "id", "text")):
                if bucket != now:
                    now, spans = bucket, defaultdict(list)
                if payload is not None:
                    for doc, h, a, b in zip(*(x.tolist() for x in unpack_pairs(payload, np.int64, np.int64, np.int64))):
                        spans[doc, h].append((a, b))
                    continue
                raw = utf8(text)
                key = (NULL_ID if i is None else i, xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                gone = _merge(spans.get(key, []))
                kept = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(raw)]))
                row = (i, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept.decode("utf-8", "ignore")) if keep_text else row)
            if out:
                rows = to_batch(schema, list(zip(*out)))
                extra = batch.column(batch.schema.get_field_index("carried")).filter(batch.column(batch.schema.get_field_index("payload")).is_null())
                yield pa.RecordBatch.from_arrays([*rows.columns, extra], names=[*schema.names, "carried"])

    flags = [t.where(f"kind = {_FLAG}").select("bucket", "payload") for t in (parts, distinct, solved, met)]
    verdicts = flags[0].unionByName(flags[1]).unionByName(flags[2]).unionByName(flags[3])
    texts = whole.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), carried.alias("carried"))
    kind = texts.schema["carried"].dataType
    texts = texts.select(bucket_column(F.col("id"), buckets).alias("bucket"), F.lit(None).cast("binary").alias("payload"), "id", "text", "carried")
    verdicts = verdicts.select("bucket", "payload", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast(kind).alias("carried"))
    both = texts.unionByName(verdicts).withColumn("late", F.col("payload").isNull()).repartition(tasks, "bucket").sortWithinPartitions("bucket", "late").drop("late")
    ddl = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text
    out = both.mapInArrow(cut, T.StructType.fromDDL(ddl).add("carried", kind)).withColumnRenamed("id", id_col)
    return ws.finish(out if carry else out.drop("carried"))

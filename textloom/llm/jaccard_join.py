"""Similarity self-join of word-shingle sets, by universe partition and pigeonhole.

Sets with Jaccard similarity of t or more differ in at most
``(1 - t) / (1 + t) * (|r| + |s|)`` elements.  The universe of shingles is hashed into
segments, whose number follows the band of the smaller set's size.  If a larger set
r allots v(i) in {0, 1, 2} to its segments with a sum above that bound, any similar
s differs from it in fewer than v(i) elements in some segment i.  So every set
indexes all its segments, and each set probes some of them: v = 1 looks for an
equal segment, v = 2 also for one that lacks or adds one element (through
one-deletion neighbourhoods).  Allotments are the cheapest ones by an estimate of
list lengths, which avoids empty and short segments.

Before that, a merged sketch (``sketch``) tells shingles that occur in one set
only.  Such a shingle is in no intersection, so it counts as a difference
already (which lowers the bound for what is left), and sets that have under t of
their shingles in common with any others leave early.  No link is lost.

Equal sets are one: all work is on distinct sets.  Within a signature's list, not
all pairs are made: each member is verified against the leader it shares most
signatures with, in rounds with different leaders, and lists shrink to those that
still hold members of different components.  Further rounds verify each set against
the closest one of another component in a few of its lists, until no components
join, or hardly any.  Then every pair across components that shares a signature is looked at, so no
link that could join components is lost: first by its parity bitmaps, which differ in at most as many bits as the sets differ
in elements, and, if they allow the link, exactly.  Lists are kept by block of
documents, and each block reports a signature once, so a list that a third of all
rows are in doesn't meet in one task before it has shrunk.

A document's set: distinct k-word shingles of its text, A-Z lower-cased; with fewer
words, all words as one; without words or text (null, empty) it is empty and linked
with nothing.  Shingles are compared by 64-bit hashes, sets are told apart by 128 bits.
Very long texts are taken whole: their sets fall into bands of their own.  Rows repeating
an id or a text each get a row.  An empty table gives no rows.  Of the input's columns only
id and text are read, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketch
from .common import Workspace, clean, parallelism, rows_of, spread_join, to_batch
from .components import components
from .exact_dedup import normalise
from .substring_dedup import corpus_bytes
from .windows import WordHasher, mix, window_hashes, words_of

SHINGLE = 5
#: Similarity as a fraction, so that the comparison is exact.
NUM, DEN = 3, 4
WORD_BYTES = 6
#: Shingles of a block of documents, and of corpus for each signature bucket.
BLOCK = 2_000_000
PER_BUCKET = 1_000_000
#: Shingles of a block of signature lists, whose keys a worker holds and sorts.
LIST_BLOCK = 1_250_000
#: Rounds of leaders before single pairs.
ROUNDS = 2
#: At most so many rounds of closest sets, looking into so many of a set's lists; one that finds under a part in so many sets is the last.
CLOSEST_ROUNDS, HOMES, FEW = 6, 4, 200
#: Sets whose 128-bit keys differ though their first halves are equal; more would be no chance.
CLASHES = 10_000
#: Bits of a set's parity bitmap.
PARITY = 1024
#: Segments per unit of the bound; the spare ones leave a choice.
SPARE = 1.5
#: Bands up to this size index one-deletion neighbourhoods of all segments, others of each eighth.
SMALL = 48

_U = np.uint64
INDEX, PROBE, HOME = 1, 2, 4


def bound(a: int, b: int, num: int = NUM, den: int = DEN) -> int:
    """Largest symmetric difference of similar sets of these sizes."""
    return (a + b) * (den - num) // (den + num)


class Bands:
    """Ranges of set size, each about 1/t wide, and their numbers of segments."""

    def __init__(self, num: int = NUM, den: int = DEN):
        self.num, self.den = num, den
        self.edges = [1]

    def top(self, b: int) -> int:
        while len(self.edges) <= b + 1:
            self.edges.append(self.edges[-1] * self.den // self.num + 1)
        return self.edges[b + 1] - 1

    def of(self, n: int) -> int:
        b = 0
        while self.top(b) < n:
            b += 1
        return b

    def segments(self, b: int) -> int:
        top = self.top(b)
        most = bound(top, top * self.den // self.num, self.num, self.den)
        return 1 if most == 0 else int(np.ceil(SPARE * (most + 1)))

    def deleting(self, b: int, segment: np.ndarray) -> np.ndarray:
        """Segments that have one-deletion neighbourhoods."""
        return np.ones(len(segment), bool) if self.top(b) <= SMALL else segment % 8 == 0


class _Parts:
    """One set cut into a band's segments."""

    def __init__(self, mixed: np.ndarray, b: int, m: int):
        where = ((mixed >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        self.value, self.where = mixed[order], where[order]
        self.start = np.flatnonzero(np.diff(self.where, prepend=-1))
        self.segment = self.where[self.start]
        self.size = np.diff(self.start, append=len(mixed))
        self.total = np.add.reduceat(self.value, self.start)
        self.b = b

    def _key(self, segment: np.ndarray, content: np.ndarray, deleted: bool) -> np.ndarray:
        place = segment.astype(np.uint64) << _U(9) | _U(self.b << 1 | deleted)
        return mix(mix(place + _U(0x51ED270B)) ^ mix(content + _U(1)))

    def exact(self, pick: np.ndarray) -> np.ndarray:
        return self._key(self.segment[pick], self.total[pick], False)

    def as_added(self, pick: np.ndarray) -> np.ndarray:
        """The whole segment, to be found among the deletions of a larger one."""
        return self._key(self.segment[pick], self.total[pick], True)

    def deletions(self, pick: np.ndarray, indexed: bool) -> np.ndarray:
        mine = np.repeat(pick, self.size)
        total = np.repeat(self.total, self.size)
        return self._key(self.where[mine], (total - self.value)[mine], indexed)


def index_keys(parts: _Parts, bands: Bands) -> np.ndarray:
    every = np.ones(len(parts.size), bool)
    some = bands.deleting(parts.b, parts.segment) & (parts.size > 1)
    return np.concatenate((parts.exact(every), parts.deletions(some, True)))


def probe_keys(parts: _Parts, bands: Bands, need: int) -> tuple[np.ndarray, int]:
    """Keys of the cheapest allotment of ``need`` units, and how many units are missing."""
    k = parts.size.astype(float)
    one = 0.5**k + 0.01
    can = bands.deleting(parts.b, parts.segment) & (parts.size > 1)
    two = (k + 1) * 0.5 ** (k - 1) + 0.01 * (k + 1)
    cost = np.concatenate((one, np.where(can, np.maximum(two - one, one), np.inf)))
    order = np.argsort(cost, kind="stable")[:need]
    order = order[np.isfinite(cost[order])]
    first = np.zeros(len(k), bool)
    first[order[order < len(k)]] = True
    second = np.zeros(len(k), bool)
    second[order[order >= len(k)] - len(k)] = True
    keys = np.concatenate((parts.exact(first), parts.as_added(second), parts.deletions(second, False)))
    return keys, need - len(order)


def empty_keys(b: int, segments: np.ndarray) -> np.ndarray:
    """Keys of segments without elements."""
    return mix(mix((segments.astype(np.uint64) << _U(9) | _U(b << 1)) + _U(0x51ED270B)) ^ _U(0x7F4A7C15))


def shingle_sets(texts: list[bytes], hasher: WordHasher, k: int = SHINGLE) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each text."""
    words, counts = words_of(texts, hasher)
    h, _, text = window_hashes(words, counts, k, False)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    edges = np.searchsorted(text, np.arange(len(texts) + 1))
    ends = np.cumsum(counts)
    out = []
    for i, n in enumerate(counts.tolist()):
        if n >= k:
            out.append(h[edges[i] : edges[i + 1]])
        elif n:
            whole = words[ends[i] - n : ends[i]].tobytes()
            out.append(np.array([xxhash.xxh3_64_intdigest(whole, seed=n)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(elements: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(elements.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


_FIRST = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), *sketch.CELLS])
_FIRST_DDL = "kind int, id long, n long, k1 long, k2 long, " + sketch.CELLS_DDL


def parity(elements: np.ndarray) -> np.ndarray:
    """One bit per hash bucket: whether an odd number of elements falls into it."""
    n = np.bincount((mix(elements + _U(0x2545F491)) >> _U(40)).astype(np.int64) % PARITY, minlength=PARITY)
    return np.packbits((n & 1).astype(np.uint8))


_SET, _LIST, _SUM, _HARD, _HAS = 0, 1, 2, 3, 4
_ROW = pa.schema([("kind", pa.int32()), ("src", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary()), ("s", pa.int64()), ("n", pa.int64())])
_ROW_DDL = "kind int, src long, bucket int, payload binary, s long, n long"
_PAIR = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("src", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])
_PAIR_DDL = "kind int, a long, b long, src long, bucket int, payload binary"


def _lists(keys: np.ndarray, sets: np.ndarray, comps: np.ndarray, roles: np.ndarray) -> bytes:
    return b"".join((np.int64(len(keys)).tobytes(), keys.tobytes(), sets.tobytes(), comps.tobytes(), roles.tobytes()))


def _unlists(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(packed, np.int64, 1)[0])
    return (np.frombuffer(packed, np.uint64, n, 8), np.frombuffer(packed, np.int64, n, 8 + 8 * n), np.frombuffer(packed, np.int64, n, 8 + 16 * n), np.frombuffer(packed, np.uint8, n, 8 + 24 * n))


def _buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> _U(40)) * _U(buckets) >> _U(24)).astype(np.int64)


def _summaries(keys, sets, comps, roles, src: int, buckets: int, turn: int) -> list[tuple[int, bytes]]:
    """One row of each signature of a block: a leader, least and greatest component, roles seen."""
    if not len(keys):
        return []
    luck = mix(sets.view(np.uint64) ^ _U(turn * 0x9E3779B97F4A7C15 % (1 << 64)))
    order = np.lexsort((luck, keys))
    keys, sets, comps, roles, luck = keys[order], sets[order], comps[order], roles[order], luck[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    low, high = np.minimum.reduceat(comps, first), np.maximum.reduceat(comps, first)
    seen = np.bitwise_or.reduceat(roles, first)
    keys, lead, of = keys[first], sets[first], comps[first]
    to = _buckets(keys, buckets)
    edges = np.flatnonzero(np.diff(to, prepend=-1, append=-1))
    return [
        (int(to[a]), b"".join((np.array([b - a, src], np.int64).tobytes(), keys[a:b].tobytes(), lead[a:b].tobytes(), of[a:b].tobytes(), low[a:b].tobytes(), high[a:b].tobytes(), seen[a:b].tobytes())))
        for a, b in zip(edges, edges[1:])
    ]


def jaccard_join(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    component_id is the least id reachable by links, its own included.  Null ids count
    as larger than any; a component of null ids only has a null component_id.
    """
    ws = Workspace(spark, "jaccard")
    docs = clean(docs, id=id_col, text=text_col)
    items = corpus_bytes(docs) / WORD_BYTES
    bits = sketch.bits_for(items)
    tasks = parallelism(spark)
    buckets = max(tasks, int(items / PER_BUCKET) + 1)

    first = ws.save(docs.mapInArrow(_first_pass(shingle, bits), _FIRST_DDL), "first", ["kind"])
    members = first.where(f"kind = {_SET}").select("id", "n", "k1", "k2")
    alias = _aliases(members)
    table = sketch.merge(spark, first.where(f"kind = {_LIST}").select("chunk", "once", "more"), bits)
    ws.release()
    ws.drop(f"first/kind={_LIST}")

    second = ws.save(docs.mapInArrow(_second_pass(shingle, table, bits, alias, num, den, buckets, None), _ROW_DDL), "second", ["kind"])
    hard = second.where(f"kind = {_HARD}").select("s", "n").distinct()
    wanted = sorted((r.s, r.n) for r in hard.collect())  # (band, segment) pairs: as many as the sizes of sets allow, whatever the number of sets
    base = "second"
    if wanted:
        ws.drop(base)
        base = "second-all"
        second = ws.save(docs.mapInArrow(_second_pass(shingle, table, bits, alias, num, den, buckets, wanted), _ROW_DDL), base, ["kind"])
    table.unpersist()

    # a set that several blocks hold is written by each; one copy does
    sets = second.where(f"kind = {_SET}").groupBy("s").agg(F.first("payload").alias("payload"), F.first("n").alias("n"))
    sets = ws.save(sets, "sets0")
    ws.drop(f"{base}/kind={_SET}")
    lists = second.where(f"kind = {_LIST}").select("src", "payload")
    has = second.where(f"kind = {_HAS}").select("src", "s", "n", "payload")
    sums = second.where(f"kind = {_SUM}").select("bucket", "payload")
    labels, rounds = None, []

    def settle(turn: int) -> DataFrame:
        return ws.save(sums.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_settle, "src long, payload binary"), f"answers{turn}")

    def joined(found: DataFrame, name: str) -> DataFrame:
        """Components after more links: those so far stand for the links that made them."""
        links = found if labels is None else found.unionByName(labels.where("v != c").select(F.col("v").alias("a"), F.col("c").alias("b")))
        out = components(ws, links, name)
        ws.drop(*[f"{x}-components" for x in rounds])
        rounds[:] = [name]
        return out

    def renamed(rest: DataFrame, turn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Lists with the components as they are now, their summaries, and the sets in them."""
        rest = rest.select("src", F.lit(1).alias("late"), "payload", F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("c"))
        if labels is not None:
            named = has.join(labels, has.s == labels.v).select("src", F.lit(0).alias("late"), F.lit(None).cast("binary").alias("payload"), "s", "c")
            rest = rest.unionByName(named)
        again = ws.save(rest.repartition(tasks, "src").sortWithinPartitions("src", "late").mapInArrow(_relabel(buckets, turn + 1), _ROW_DDL), f"again{turn}", ["kind"])
        return again.where(f"kind = {_LIST}").select("src", "payload"), again.where(f"kind = {_SUM}").select("bucket", "payload"), again.where(f"kind = {_HAS}").select("s").distinct()

    for turn in range(1, ROUNDS + 1):
        answers = settle(turn)
        ws.drop(f"{base}/kind={_SUM}", f"again{turn - 1}/kind={_SUM}")
        if not answers.limit(1).count():
            lists = None
            break
        both = lists.select("src", F.lit(1).alias("late"), "payload").unionByName(answers.select("src", F.lit(0).alias("late"), "payload"))
        star = ws.save(both.repartition(tasks, "src").sortWithinPartitions("src", "late").mapInArrow(_star, _PAIR_DDL), f"star{turn}", ["kind"])
        ws.drop(f"{base}/kind={_LIST}", f"again{turn - 1}", f"answers{turn}")
        found = ws.save(_verified(star.where(f"kind = {_SUM}").select("a", "b").distinct(), sets, num, den), f"found{turn}")
        if found.limit(1).count():
            labels = joined(found, f"round{turn}")
        lists, sums, live = renamed(star.where(f"kind = {_LIST}").select("src", "payload"), turn)
        # sets whose lists are all closed have no further links to find
        sets = ws.save(sets.join(live, "s", "left_semi"), f"sets{turn}")
        ws.drop(f"star{turn}", f"found{turn}", f"sets{turn - 1}")
    turn, few, tried = ROUNDS, False, None
    live = sets.count() if lists is not None else 0
    while lists is not None:
        # what is left: pairs across components in a signature's list; the closest ones first, all in the end
        turn += 1
        closest = turn <= ROUNDS + CLOSEST_ROUNDS and not few
        answers = settle(turn)
        none = F.lit(None).cast("long")
        both = has.select("src", F.lit(0).alias("late"), "payload", "s", "n")
        both = both.unionByName(answers.select("src", F.lit(1).alias("late"), "payload", none.alias("s"), none.alias("n")))
        both = both.unionByName(lists.select("src", F.lit(2).alias("late"), "payload", none.alias("s"), none.alias("n")))
        rest = both.repartition(tasks, "src").sortWithinPartitions("src", "late").mapInArrow(_open_rows(buckets, turn), "bucket int, payload binary")
        rest = ws.save(rest, f"open{turn}")
        pairs = rest.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_cross(num, den, closest), "a long, b long").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")  # those that were no links, or are joined now
        pairs = ws.save(pairs, f"pairs{turn}")
        ws.drop(f"answers{turn}", f"open{turn}")
        found = ws.save(_verified(pairs, sets, num, den), f"found{turn}")
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = found.count()
        if new:
            labels = joined(found, f"round{turn}")
            ws.drop(f"found{turn}")
        if not closest:
            break
        # a further round asks for all sets again, so a share of them decides, whatever their number
        few = new * FEW < live
        if new:
            lists, sums, _ = renamed(lists, turn)
            ws.drop(f"again{turn - 1}")

    # distinct sets, their components, and the least document of each
    filled = members.where("n > 0")
    if alias:
        names = spark.createDataFrame([(*k, v) for k, v in alias.items()], "k1 long, k2 long, other long")
        filled = filled.join(F.broadcast(names), ["k1", "k2"], "left").withColumn("s", F.coalesce("other", "k1"))
    else:
        filled = filled.withColumn("s", F.col("k1"))
    filled = filled.select("id", F.col("n").alias("n_shingles"), "s")
    groups = filled.groupBy("s").agg(F.min("id").alias("component_id"), F.count("*").alias("n"))
    if labels is not None:
        groups = ws.save(groups.join(labels, groups.s == labels.v, "left").select("s", "component_id", "n", F.coalesce("c", "s").alias("c")), "groups")
        least = groups.groupBy("c").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n"))
        groups = spread_join(groups.select("s", "c", F.col("n").alias("rows")), least, ["c"], groups.count()).select("s", "component_id", F.col("rows").alias("n"))
    groups = ws.save(groups, "named")
    out = spread_join(filled, groups, ["s"], members.count()).select("id", "n_shingles", "component_id")
    none = members.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return ws.finish(out.unionByName(none).withColumnRenamed("id", id_col))


def _aliases(members: DataFrame) -> dict[tuple[int, int], int]:
    """Keys of one half for the few different sets whose first halves are equal: some three pairs in 10^10 sets."""
    clash = members.where("n > 0").groupBy("k1").agg(F.min("k2").alias("x"), F.max("k2").alias("y")).where("x != y").select("k1").limit(CLASHES + 1)
    keys = [r.k1 for r in clash.collect()]  # at most CLASHES + 1 rows
    if not keys:
        return {}
    if len(keys) > CLASHES:
        raise ValueError("more clashing set keys than chance allows")
    both = {(r.k1, r.k2) for r in members.where("n > 0").join(F.broadcast(clash), "k1").select("k1", "k2").distinct().collect()}
    for turn in range(1, 100):
        alias = {k: xxhash.xxh3_64_intdigest(np.array(k, np.int64).tobytes(), seed=turn) - (1 << 63) for k in both}
        names = members.sparkSession.createDataFrame([(v,) for v in alias.values()], "k1 long")
        if len(set(alias.values())) == len(alias) and not members.join(F.broadcast(names), "k1", "left_semi").limit(1).count():
            return alias
    raise ValueError("no free set keys")


def _first_pass(shingle: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, known, size = WordHasher(), [], set(), 0

        def close():
            cells = sketch.count_cells(np.concatenate(held), bits)
            n = cells.num_rows
            held.clear()
            known.clear()
            empty = [pa.nulls(n, pa.int64())] * 4
            return pa.RecordBatch.from_arrays([pa.array([_LIST] * n, pa.int32()), *empty, *cells.columns], schema=_FIRST)

        for batch in batches:
            ids, texts = rows_of(batch, "id", "text")
            found = shingle_sets([normalise(t) for t in texts], hasher, shingle)
            keys = [set_key(s) for s in found]
            n = len(ids)
            yield to_batch(_FIRST, [[_SET] * n, ids, [len(s) for s in found], [k[0] for k in keys], [k[1] for k in keys], *[[None] * n] * 3])
            for s, k in zip(found, keys):
                if len(s) and k not in known:
                    known.add(k)
                    held.append(s)
                    size += len(s)
            if size >= BLOCK:
                yield close()
                size = 0
        if held:
            yield close()

    return run


def _second_pass(shingle: int, table, bits: int, alias: dict[tuple[int, int], int], num: int, den: int, buckets: int, wanted: list | None):
    """Sets, signature lists by block, and a summary of each list for its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bands = WordHasher(), Bands(num, den)
        src = TaskContext.get().partitionId() << 32
        known: set[int] = set()
        keys, owners, roles, rows = [], [], [], []
        size = 0
        need_empty: dict[int, np.ndarray] = {}
        for b, i in wanted or ():
            need_empty.setdefault(b, []).append(i)
        need_empty = {b: np.array(v, np.int64) for b, v in need_empty.items()}

        def put(found: np.ndarray, s: int, role: int):
            keys.append(found)
            owners.append(np.full(len(found), s, np.int64))
            roles.append(np.full(len(found), role, np.uint8))

        def take(elements: np.ndarray, s: int):
            n = len(elements)
            common = elements[sketch.maybe_repeated(elements, table.value, bits)]
            if len(common) * den < n * num:
                return
            alone = n - len(common)
            rows.append((_SET, None, None, common.tobytes(), s, n))
            rows.append((_HAS, src, None, parity(elements).tobytes(), s, n))
            mixed = mix(common ^ _U(0xA0761D6478BD642F))
            own = bands.of(n)
            for b in range(bands.of(-(-n * num // den)), own + 1):
                m = bands.segments(b)
                parts = _Parts(mixed, b, m)
                if b == own:
                    put(index_keys(parts, bands), s, INDEX)
                    if b in need_empty:
                        put(empty_keys(b, np.setdiff1d(need_empty[b], parts.segment)), s, INDEX)
                need = bound(n, min(bands.top(b), n), num, den) - alone + 1
                if need > 0:
                    found, missing = probe_keys(parts, bands, need)
                    put(found, s, PROBE)
                    if missing > 0:
                        empty = np.setdiff1d(np.arange(m), parts.segment)[:missing]
                        put(empty_keys(b, empty), s, PROBE)
                        rows.extend((_HARD, None, None, None, b, int(i)) for i in empty)

        def close():
            nonlocal src, size
            if keys:
                k, s, r = np.concatenate(keys), np.concatenate(owners), np.concatenate(roles)
                rows.append((_LIST, src, None, _lists(k, s, s, r), None, None))
                rows.extend((_SUM, src, to, packed, None, None) for to, packed in _summaries(k, s, s, r, src, buckets, 1))
            out = list(rows)
            for x in (keys, owners, roles, rows):
                x.clear()
            known.clear()
            src, size = src + 1, 0
            for at in range(0, len(out), 500):
                yield to_batch(_ROW, list(zip(*out[at : at + 500])))

        for batch in batches:
            for elements in shingle_sets([normalise(t) for t in batch.column(1).to_pylist()], hasher, shingle):
                size += len(elements)
                if len(elements):
                    key = set_key(elements)
                    s = alias.get(key, key[0])
                    if s not in known:
                        known.add(s)
                        take(elements, s)
            if size >= LIST_BLOCK:
                yield from close()
        yield from close()

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket of signatures: those with several components and both roles, told to their blocks with one leader."""
    schema = pa.schema([("src", pa.int64()), ("payload", pa.binary())])
    now, held = None, []

    def close():
        cols, who = [[] for _ in range(6)], []
        for packed in held:
            n, src = np.frombuffer(packed, np.int64, 2)
            at = 16
            for c, kind in zip(cols, (np.uint64, *[np.int64] * 4, np.uint8)):
                c.append(np.frombuffer(packed, kind, n, at))
                at += n * np.dtype(kind).itemsize
            who.append(np.full(n, src))
        keys, lead, of, low, high, seen = (np.concatenate(c) for c in cols)
        who = np.concatenate(who)
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        open_ = (np.minimum.reduceat(low[order], first) < np.maximum.reduceat(high[order], first)) & (np.bitwise_or.reduceat(seen[order], first) == (INDEX | PROBE))
        # the leader: of the blocks' leaders, the one of least luck is as good as any fixed choice
        luck = mix(lead[order].view(np.uint64) ^ k)
        best = np.lexsort((luck, k))[first]
        size = np.diff(first, append=len(k))
        told = np.repeat(open_, size)
        leader, comp = np.repeat(lead[order][best], size)[told], np.repeat(of[order][best], size)[told]
        keys, who = k[told], who[order][told]
        by = np.argsort(who, kind="stable")
        keys, who, leader, comp = keys[by], who[by], leader[by], comp[by]
        edges = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1], [True]))) if len(who) else np.zeros(0, int)
        for a, b in zip(edges, edges[1:]):
            yield int(who[a]), _lists(keys[a:b], leader[a:b], comp[a:b], np.zeros(0, np.uint8))

    def emit():
        out = list(close())
        for at in range(0, len(out), 100):
            yield to_batch(schema, list(zip(*out[at : at + 100])))

    for batch in batches:
        for bucket, payload in zip(*rows_of(batch, "bucket", "payload")):
            if bucket != now and held:
                yield from emit()
                held = []
            now = bucket
            held.append(payload)
    if held:
        yield from emit()


def _unanswers(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(packed, np.int64, 1)[0])
    return np.frombuffer(packed, np.uint64, n, 8), np.frombuffer(packed, np.int64, n, 8 + 8 * n), np.frombuffer(packed, np.int64, n, 8 + 16 * n)


def _answered(batches: Iterator[pa.RecordBatch]):
    """Per block: its list cut to signatures that are still open, with leaders and their components."""
    now, answers = None, []
    for batch in batches:
        for src, late, payload in zip(*rows_of(batch, "src", "late", "payload")):
            if src != now:
                now, answers = src, []
            if not late:
                answers.append(payload)
            elif answers:
                keys, lead, comp = (np.concatenate(x) for x in zip(*map(_unanswers, answers)))
                order = np.argsort(keys)
                keys, lead, comp = keys[order], lead[order], comp[order]
                k, s, c, r = _unlists(payload)
                at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                hit = keys[at] == k
                at = at[hit]
                yield src, k[hit], s[hit], c[hit], r[hit], lead[at], comp[at]


def _star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for src, k, s, c, r, lead, comp in _answered(batches):
        other = (c != comp) & (s != lead)
        # each set goes with the leader it shares most signatures with
        pairs, shared = np.unique(np.stack((s[other], lead[other]), 1), axis=0, return_counts=True)
        order = np.lexsort((pairs[:, 1], -shared, pairs[:, 0]))
        pairs = pairs[order]
        first = np.ones(len(pairs), bool)
        first[1:] = pairs[1:, 0] != pairs[:-1, 0]
        pairs = np.sort(pairs[first], axis=1)
        n = len(pairs)
        if n:
            yield to_batch(_PAIR, [[_SUM] * n, pairs[:, 0], pairs[:, 1], [src] * n, [None] * n, [None] * n])
        yield to_batch(_PAIR, [[_LIST], [None], [None], [src], [None], [_lists(k, s, c, r)]])


def _relabel(buckets: int, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, named = None, {}
        for batch in batches:
            for src, payload, s, c in zip(*rows_of(batch, "src", "payload", "s", "c")):
                if src != now:
                    now, named = src, {}
                if payload is None:
                    named[s] = c
                    continue
                keys, sets, _, roles = _unlists(payload)
                own, where = np.unique(sets, return_inverse=True)
                comps = np.array([named.get(x, x) for x in own.tolist()], np.int64)[where] if len(own) else sets
                rows = [(_LIST, src, None, _lists(keys, sets, comps, roles), None, None)]
                rows += [(_SUM, src, to, packed, None, None) for to, packed in _summaries(keys, sets, comps, roles, src, buckets, turn)]
                rows += [(_HAS, None, None, None, x, None) for x in own.tolist()]
                for at in range(0, len(rows), 100):
                    yield to_batch(_ROW, list(zip(*rows[at : at + 100])))

    return run


_OPEN = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])


def _homes(keys: np.ndarray, sets: np.ndarray, roles: np.ndarray, turn: int) -> np.ndarray:
    """Roles with a mark on a few probes of each set, other ones in each turn."""
    probe = np.flatnonzero(roles & PROBE)
    luck = mix(keys[probe] ^ _U(turn * 0x9E3779B97F4A7C15 % (1 << 64)))
    order = np.lexsort((luck, sets[probe]))
    first = np.flatnonzero(np.diff(sets[probe][order], prepend=sets[probe][order][:1] - 1) != 0) if len(probe) else probe
    place = np.arange(len(probe)) - np.repeat(first, np.diff(first, append=len(probe)))
    out = roles.copy()
    out[probe[order[place < HOMES]]] |= HOME
    return out


def _open_rows(buckets: int, turn: int):
    """Open lists by bucket of signatures, with the sizes and parity bitmaps of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, answers, known = None, [], {}
        for batch in batches:
            for src, late, payload, one, size in zip(*rows_of(batch, "src", "late", "payload", "s", "n")):
                if src != now:
                    now, answers, known = src, [], {}
                if late == 0:
                    known[one] = (size, payload)
                elif late == 1:
                    answers.append(payload)
                elif answers:
                    keys = np.sort(np.concatenate([_unanswers(a)[0] for a in answers]))
                    k, s, c, r = _unlists(payload)
                    at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                    hit = np.flatnonzero(keys[at] == k)
                    hit = hit[np.argsort(k[hit], kind="stable")]
                    k, s, c, r = k[hit], s[hit], c[hit], r[hit]
                    r = _homes(k, s, r, turn)
                    to = _buckets(k, buckets)
                    edges = np.flatnonzero(np.diff(to, prepend=-1, append=-1))
                    rows = []
                    for a, b in zip(edges, edges[1:]):
                        own, where = np.unique(s[a:b], return_inverse=True)
                        sizes = np.array([known[x][0] for x in own.tolist()], np.int64)
                        head = np.array([b - a, len(own)], np.int64)
                        parts = (head, k[a:b], c[a:b], where.astype(np.int64), own, sizes, r[a:b])
                        rows.append((int(to[a]), b"".join([x.tobytes() for x in parts] + [known[x][1] for x in own.tolist()])))
                    for x in range(0, len(rows), 100):
                        yield to_batch(_OPEN, list(zip(*rows[x : x + 100])))

    return run


def _read_open(packed: bytes) -> tuple[np.ndarray, ...]:
    n, m = (int(x) for x in np.frombuffer(packed, np.int64, 2))
    at, out = 16, []
    for kind, size in ((np.uint64, n), (np.int64, n), (np.int64, n), (np.int64, m), (np.int64, m), (np.uint8, n)):
        out.append(np.frombuffer(packed, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return (*out, np.frombuffer(packed[at:], np.uint64).reshape(m, PARITY // 64))


def _cross(num: int, den: int, closest: bool):
    """Pairs across components that share a signature, one as an index entry and one as a probe, if sizes and parities allow a link.

    ``closest``: for marked probes only, with the set whose parity differs least.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def close(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [_read_open(p) for p in held]
        base = np.cumsum([0, *(len(p[3]) for p in parts)])
        k, c, r = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 5))
        where = np.concatenate([p[2] + b for p, b in zip(parts, base)])
        own, sizes, bits = (np.concatenate([p[i] for p in parts]) for i in (3, 4, 6))
        order = np.lexsort((own[where], k))
        k, c, r, where = k[order], c[order], r[order], where[order]
        told: set[tuple[int, int]] = set()
        edges = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
        for a, b in zip(edges, edges[1:]):
            index = np.flatnonzero(r[a:b] & INDEX) + a
            for i in (np.flatnonzero(r[a:b] & (HOME if closest else PROBE)) + a).tolist():
                at = where[index[c[index] != c[i]]]
                mine = where[i]
                n, other = int(sizes[mine]), sizes[at]
                at = at[np.minimum(n, other) * den >= np.maximum(n, other) * num]
                apart = np.bitwise_count(bits[at] ^ bits[mine]).sum(axis=1, dtype=np.int64)
                fine = apart <= (n + sizes[at]) * (den - num) // (den + num)
                at, apart = at[fine], apart[fine]
                if closest and len(at):
                    at = at[[np.argmin(apart)]]
                me = int(own[mine])
                told.update((min(me, x), max(me, x)) for x in own[at].tolist())
            if len(told) > 100_000:
                yield to_batch(schema, list(zip(*told)))
                told.clear()
        if told:
            yield to_batch(schema, list(zip(*told)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, payload in zip(*rows_of(batch, "bucket", "payload")):
                if bucket != now and held:
                    yield from close(held)
                    held = []
                now = bucket
                held.append(payload)
        if held:
            yield from close(held)

    return run


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of distinct sets whose exact similarity reaches the threshold."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x, m, y, n in zip(*rows_of(batch, "a", "b", "x", "m", "y", "o")):
                left, right = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((left, right))
                both.sort()
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                if same * den >= (m + n - same) * num:
                    out.append((a, b))
            if out:
                yield to_batch(schema, list(zip(*out)))

    # both sides are the same columns under other names, all of them renamed: so Spark shuffles the sets once and reads them twice
    left = sets.select(F.col("s").alias("a"), F.col("payload").alias("x"), F.col("n").alias("m"))
    right = sets.select(F.col("s").alias("b"), F.col("payload").alias("y"), F.col("n").alias("o"))
    # sizes alone rule out some pairs
    near = (F.least("m", "o") * den) >= (F.greatest("m", "o") * num)
    return pairs.join(left, "a").join(right, "b").where(near).select("a", "b", "x", "m", "y", "o").mapInArrow(run, "a long, b long")

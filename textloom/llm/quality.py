"""Quality classifier with hierarchical empirical Bayes over sites.

Document evidence.  Two logistic heads, "poor" and "toxic", are fitted on a bounded
sample of labelled rows (``TRAIN_ROWS``, least hashes of ids).  One half of the sample
gives a lexicon of words and word beginnings with their log odds, the other half the
heads' weights on lexicon sums and on shape features of the whole text, so that the
lexicon isn't trusted for having seen its own documents.

Site evidence.  Over all documents, grouped aggregation gives each path's and each
host's mean of the classifier's probability of a good document.  A host's posterior
shrinks towards the global mean and a path's towards its host's, with strengths
estimated from the spread between groups (method of moments), so sparse sites stay
near the prior.  A document is left out of its own site's posterior.  Its final log
odds are the classifier's plus the path posterior's distance from the global prior.

Null texts are empty; null hosts or paths form a site of their own, other than the
empty name's.  Rows without an id are scored too, and rows repeating an id each by
itself.  Very long texts are read whole.  Only the named columns are read, so others
can't clash.  Training takes one row of each labelled id: of texts repeating an id, the
one of least hash.  A head without both classes in the sample predicts the share it
saw.  Without usable labels, or with an empty table, everything is kept.  Of several
labels for an id, the least quality and greatest toxicity count.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, clean, rows_of, spread_join, to_batch

TRAIN_ROWS = 20_000
#: Words and beginnings in the lexicon, and documents that must have one.
LEXICON, SUPPORT = 4_000, 8
#: Lengths of word beginnings.
STEMS = (4, 5)
#: Words whose log odds a worker remembers.
REMEMBERED = 500_000
RIDGE = 1.0
KEEP_FROM = 0.5

_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„’‘…–—¡¿"


def evidence_tokens(word: str) -> list[str]:
    """The word without marks around it, and its beginnings."""
    word = word.strip(_MARKS)
    return [word, *(f"{word[:n]}~" for n in STEMS if len(word) > n)] if word else []


def shape(text: str, words: list[str]) -> list[float]:
    """Features of the whole text that don't depend on which words it has."""
    n = max(1, len(words))
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = max(1, int(raw.sum()))
    upper, lower, digits = raw[65:91].sum(), raw[97:123].sum(), raw[48:58].sum()
    marks = raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum()
    plain = raw[44] + raw[46]
    lines = [x for x in text.split("\n") if x]
    variety = len(set(words)) / n
    return [
        math.log1p(len(words)),
        sum(map(eq, words, words[1:])) / n,
        variety,
        variety * math.log1p(len(words)),
        float(upper / max(1, upper + lower)),
        float(digits / size),
        float(marks / size),
        float((marks - plain) / n),
        float(raw[33] / n),
        float(raw[124] / n),
        sum(map(len, words)) / n,
        float(raw[128:].sum() / size),
        1 - len(set(lines)) / max(1, len(lines)),
    ]


class Lexicon:
    """Log odds of words for each head."""

    def __init__(self, odds: dict[str, tuple[float, float]]):
        self.odds, self.seen = odds, {}

    def of(self, word: str) -> tuple[float, float]:
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) > REMEMBERED:
                self.seen.clear()
            known = [self.odds[t] for t in evidence_tokens(word) if t in self.odds]
            found = self.seen[word] = (max((k[0] for k in known), key=abs, default=0.0), max((k[1] for k in known), key=abs, default=0.0))
        return found

    def features(self, text: str) -> list[float]:
        low = text.lower()
        words = low.split()
        out = shape(text, words)
        found = [x for x in map(self.of, set(words)) if x != (0.0, 0.0)]
        for head in (0, 1):
            odds = [x[head] for x in found]
            strong = sorted((x for x in odds if x > 1.0), reverse=True)
            out += [math.log1p(len(strong)), sum(strong[:8]), 100 * len(strong) / max(1, len(words))]
        return out


class Head:
    """Ridge logistic regression on standardised features and their squares."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.share = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.0
        self.weights: np.ndarray | None = None
        if not 0 < y.sum() < len(y):
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = self._design(x)
        w = np.zeros(z.shape[1])
        w[0] = math.log(self.share / (1 - self.share))
        ridge = np.full(len(w), RIDGE)
        ridge[0] = 1e-6
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (p - y) + ridge * w
            hess = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(hess, grad)
            step *= min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate((np.ones((len(z), 1)), z, z * z / 8), 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.share if self.share > 0.5 else 0.0)
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.weights, -30, 30)))


def fit(spark: SparkSession, ws: Workspace, docs: DataFrame, labels: DataFrame) -> tuple[Lexicon, Head, Head]:
    """Heads from a bounded sample of labelled rows; docs has id and text, labels id, quality and toxic."""
    known = labels.where("id IS NOT NULL").groupBy("id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = known.where("quality IS NOT NULL AND toxic IS NOT NULL")
    sample = known.orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS)
    rows = docs.join(F.broadcast(sample), "id")  # at most TRAIN_ROWS ids
    rows = rows.groupBy("id", "quality", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = ws.save(rows.withColumn("half", F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).cast("int")), "train")
    seen = pa.schema([("token", pa.string()), *[(f"{c}{h}", pa.int64()) for h in (0, 1) for c in ("n", "poor", "toxic")]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter() for _ in range(6)]
            for text, q, t, half in zip(*rows_of(batch, "text", "quality", "toxic", "half")):
                tokens = {x for w in set((text or "").lower().split()) for x in evidence_tokens(w)}
                for c, hit in zip(counts[3 * half : 3 * half + 3], (True, q == 0, t == 1)):
                    if hit:
                        c.update(tokens)
            words = list(counts[0] | counts[3])
            if words:
                yield to_batch(seen, [words, *[[c[w] for w in words] for c in counts]])

    sizes = {r.half: r for r in rows.groupBy("half").agg(F.count("*").alias("n"), F.sum((F.col("quality") == 0).cast("int")).alias("poor"), F.sum((F.col("toxic") == 1).cast("int")).alias("toxic")).collect()}
    kinds = [f.name for f in seen][1:]
    tokens = rows.mapInArrow(count, "token string, " + ", ".join(f"{c} long" for c in kinds)).groupBy("token").agg(*[F.sum(c).alias(c) for c in kinds])
    tokens = ws.save(tokens.where(F.col("n0") + F.col("n1") >= SUPPORT), "tokens")

    def lexicon_of(halves: tuple[int, ...]) -> Lexicon:
        total = {c: sum((F.col(f"{c}{h}") for h in halves), F.lit(0)) for c in ("n", "poor", "toxic")}
        known = [sizes[h] for h in halves if h in sizes]
        size = max(1, sum(r.n for r in known))

        def odds(head: str):
            # distance of the shrunk rate from the head's share, in log odds
            share = min(max(sum(r[head] for r in known) / size, 1e-4), 1 - 1e-4)
            rate = (F.col(head) + 4 * share) / (F.col("n") + 4)
            return F.log(rate / (1 - rate)) - math.log(share / (1 - share))

        scored = tokens.select("token", *[v.alias(c) for c, v in total.items()]).where(F.col("n") >= SUPPORT).select("token", "n", odds("poor").alias("o0"), odds("toxic").alias("o1"))
        weight = F.greatest(F.abs("o0"), F.abs("o1")) * F.sqrt("n")
        best = scored.where(F.greatest("o0", "o1") > 1.0).orderBy(weight.desc(), "token").limit(LEXICON).collect()  # at most LEXICON rows
        return Lexicon({r.token: (float(r.o0), float(r.o1)) for r in best})

    across = (lexicon_of((1,)), lexicon_of((0,)))  # each half is seen through the other's
    out = pa.schema([("poor", pa.int64()), ("toxic", pa.int64()), ("x", pa.list_(pa.float64()))])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, q, t, half = rows_of(batch, "text", "quality", "toxic", "half")
            yield to_batch(out, [[int(v == 0) for v in q], [int(v == 1) for v in t], [across[h].features(x or "") for x, h in zip(texts, half)]])

    got = rows.mapInArrow(features, "poor long, toxic long, x array<double>").toArrow()  # at most TRAIN_ROWS rows
    x = np.array(got.column("x").to_pylist() or np.zeros((0, 19)), float)
    return lexicon_of((0, 1)), Head(x, np.array(got.column("poor").to_pylist(), float)), Head(x, np.array(got.column("toxic").to_pylist(), float))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", row_col: str | None = None) -> DataFrame:
    """One row per input row: id, p_poor, p_toxic, host_posterior, path_posterior, posterior, kept; ``row_col``, if given, tells rows apart and is handed on."""
    ws = Workspace(spark, "quality")
    own = {"row": row_col} if row_col else {}
    docs = clean(docs, id=id_col, text=text_col, host=host_col, path=path_col, **own)
    # a null name is another than the empty one
    docs = docs.withColumns({c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("host", "path")})
    labels = labels.select(F.col(id_col).alias("id"), "quality", "toxic")
    lexicon, poor, toxic = fit(spark, ws, docs.select("id", "text"), labels)
    schema = pa.schema([("id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("poor", pa.float64()), ("toxic", pa.float64()), ("good", pa.float64()), *[(c, pa.int64()) for c in own]])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, hosts, paths = rows_of(batch, "id", "text", "host", "path")
            x = np.array([lexicon.features(t or "") for t in texts], float).reshape(len(texts), -1)
            if len(x):
                a, b = poor.predict(x), toxic.predict(x)
                yield to_batch(schema, [ids, hosts, paths, a, b, np.clip((1 - a) * (1 - b), 1e-6, 1 - 1e-6), *rows_of(batch, *own)])

    scored = ws.save(docs.mapInArrow(score, "id long, host string, path string, poor double, toxic double, good double" + ", row long" * len(own)), "scored")
    paths = ws.save(scored.groupBy("host", "path").agg(F.count("*").alias("pn"), F.sum("good").alias("ps")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("pn").alias("hn"), F.sum("ps").alias("hs"))
    # strengths of the priors, from the spread of group means beyond that of their members
    total = paths.agg(F.sum("pn").alias("n"), F.sum("ps").alias("s")).first()
    m = float(total.s / total.n) if total.n else 0.5

    def strength(groups: DataFrame, n: str, s: str, centre) -> float:
        mean = F.col(s) / F.col(n)
        r = groups.agg(F.sum(F.col(n) * (mean - centre) ** 2).alias("v"), F.sum(n).alias("n"), F.sum(F.lit(1.0)).alias("k")).first()
        if not r.n or r.k < 2:
            return 100.0
        between = max(float(r.v) / float(r.n) - m * (1 - m) * float(r.k) / float(r.n), 1e-9)
        return min(max(m * (1 - m) / between - 1, 1.0), 1e6)

    host_strength = strength(hosts, "hn", "hs", F.lit(m))
    both = ws.save(paths.join(hosts, "host"), "sites")
    path_strength = strength(both, "pn", "ps", F.col("hs") / F.col("hn"))
    rows = spread_join(scored, both.withColumn("n", F.col("pn")), ["host", "path"], total.n or 0)
    host = (F.col("hs") - F.col("good") + host_strength * m) / (F.col("hn") - 1 + host_strength)
    path = (F.col("ps") - F.col("good") + path_strength * F.col("host_posterior")) / (F.col("pn") - 1 + path_strength)
    logit = lambda c: F.log(c / (1 - c))
    odds = logit(F.col("good")) + logit(F.col("path_posterior")) - F.lit(math.log(m / (1 - m)))
    rows = rows.withColumn("host_posterior", host).withColumn("path_posterior", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), path)))
    rows = rows.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return ws.finish(
        rows.select(
            F.col("id").alias(id_col), F.col("poor").alias("p_poor"), F.col("toxic").alias("p_toxic"), "host_posterior", "path_posterior", "posterior", (F.col("posterior") >= KEEP_FROM).alias("kept"), *[F.col(c).alias(name) for c, name in own.items()]
        )
    )

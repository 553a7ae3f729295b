"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, with a block-max inverted index.

Learning. Labelled rows are examples, at most ``MAX_EXAMPLES`` of them (those
with the smallest hashes, whatever the table's size). Terms are words and their
first 4, 5 and 6 letters, so that inflected forms share terms; the vocabulary is
the terms that go with the label by a chi-square of ``MIN_CHI2`` or more, at most
``MAX_TERMS``. Document frequencies of these terms are counted over all
documents.

Scoring. A document's TF-IDF vector over the vocabulary is compared with all
examples. The index files examples in blocks with the largest weight of every
term in a block; blocks are scored in the order of the bounds that these give
and the search ends when no block can reach the k-th best cosine, so the result
is that of comparing with every example. Votes of the ``NEIGHBOURS`` nearest are
weighted by closeness; the share of toxic votes becomes a probability by the
monotone calibration learnt from the examples' own leave-one-out votes. The
nearest examples are the evidence.

A document without vocabulary terms is near no example: its score is the share
of toxic ones among the examples without terms.

Defined results: NULL and empty texts count as texts without terms; rows with
NULL or repeated ids are scored each, and a repeated id is one example; NULL labels are no labels, a doc_id with
several labels counts as toxic if one says so; without labelled rows every
score is 0; empty tables work; other columns are ignored (or carried, by
``reject_toxic``).
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.llm.frames import columns, numbered, released

MAX_EXAMPLES = 20_000
MAX_TERMS = 512
MIN_CHI2 = 30.0
MIN_DOCS = 3
PREFIXES = (4, 5, 6)
NEIGHBOURS = 15
BLOCK = 64
BINS = 20
WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def terms_of(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


class Features:
    """Counts of vocabulary terms in a text; words seen are kept up to a bound."""

    def __init__(self, vocabulary: list[str]):
        self.index = {t: i for i, t in enumerate(vocabulary)}
        self.words: dict[str, tuple[int, ...]] = {}

    def of(self, text: str | None) -> dict[int, int]:
        found: dict[int, int] = {}
        if not text:
            return found
        known = self.words
        for word, n in Counter(WORD.findall(text.lower())).items():
            hits = known.get(word)
            if hits is None:
                hits = tuple(self.index[t] for t in terms_of(word) if t in self.index)
                if len(known) > 200_000:
                    known.clear()
                known[word] = hits
            for i in hits:
                found[i] = found.get(i, 0) + n
        return found


@dataclass
class Model:
    """What scoring needs: bounded by MAX_TERMS and MAX_EXAMPLES."""

    vocabulary: list[str]
    idf: list[float]
    examples: list[tuple[int | None, int, list[int], list[float]]] = field(default_factory=list)  # doc_id, toxic, terms, weights
    base: float = 0.0
    calibration: list[float] = field(default_factory=list)

    def vector(self, counts: dict[int, int]) -> tuple[list[int], list[float]]:
        terms = sorted(counts)
        weights = [(1 + math.log(counts[t])) * self.idf[t] for t in terms]
        norm = math.sqrt(sum(w * w for w in weights)) or 1.0
        return terms, [w / norm for w in weights]


class BlockMaxIndex:
    """Exact nearest examples by cosine."""

    def __init__(self, examples: list[tuple]):
        import numpy as np

        # similar examples side by side, so that block bounds are sharp
        self.examples = sorted(examples, key=lambda e: (e[2], e[3], e[0] is None, e[0] or 0))
        self.toxic = np.array([e[1] for e in self.examples], np.float64)
        blocks = -(-len(self.examples) // BLOCK)
        # postings side by side in arrays, by term and then by example
        terms = np.fromiter(chain.from_iterable(e[2] for e in self.examples), np.int32)
        order = np.argsort(terms, kind="stable")
        rows = np.repeat(np.arange(len(self.examples)), np.array([len(e[2]) for e in self.examples], np.int64))[order]
        values = np.fromiter(chain.from_iterable(e[3] for e in self.examples), np.float64)[order]
        found, starts = np.unique(terms[order], return_index=True)
        ends = np.append(starts, len(terms))[1:]
        self.postings, self.most, self.starts = {}, {}, {}
        for t, lo, hi in zip(found.tolist(), starts, ends, strict=True):
            ids, weights = rows[lo:hi], values[lo:hi]
            top = np.zeros(blocks)
            np.maximum.at(top, ids // BLOCK, weights)
            self.postings[t], self.most[t] = (ids, weights), top
            self.starts[t] = np.searchsorted(ids, np.arange(blocks + 1) * BLOCK)
        self.blocks = blocks

    def nearest(self, terms: list[int], weights: list[float], k: int, without: int | None = None):
        """The ``k`` best (cosine, example number), best first, equal ones by number; only cosines over 0."""
        import numpy as np

        bound = np.zeros(self.blocks)
        used = [(t, w) for t, w in zip(terms, weights, strict=True) if t in self.postings]
        for t, w in used:
            bound += w * self.most[t]
        best: list[tuple[float, int]] = []
        least = 0.0
        for b in np.argsort(-bound, kind="stable"):
            # rounding of the sums must not end the search early
            if bound[b] <= 0 or (len(best) == k and bound[b] < least - 1e-9):
                break
            scores = np.zeros(BLOCK)
            for t, w in used:
                lo, hi = self.starts[t][b], self.starts[t][b + 1]
                if hi > lo:
                    ids, values = self.postings[t]
                    scores[ids[lo:hi] - b * BLOCK] += w * values[lo:hi]
            for i in np.nonzero(scores > 0)[0]:
                if (n := int(b) * BLOCK + int(i)) != without:
                    best.append((float(scores[i]), n))
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
            least = best[-1][0] if best else 0.0
        return best

    def vote(self, best: list[tuple[float, int]]) -> float:
        votes = [(1 / (1.05 - min(1.0, s)), self.toxic[n]) for s, n in best]
        return sum(w * y for w, y in votes) / sum(w for w, _ in votes)


def _monotone(sums: list[tuple[float, float]]) -> list[float]:
    """Shares of toxic ones by bin, made non-decreasing by pooling; empty bins take part with their middle as a weak prior."""
    pools: list[list[float]] = []
    for i, (toxic, n) in enumerate(sums):
        pools.append([toxic + (i + 0.5) / len(sums), n + 1.0, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] > pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return [p[0] / p[1] for p in pools for _ in range(int(p[2]))]


def _examples(docs: DataFrame, labels: DataFrame, max_examples: int) -> DataFrame:
    """doc_id, text, toxic of the sampled labelled rows that are not held out."""
    marked = columns(labels, "doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    train = marked.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # doc_ids are bounded by the parameter, so they may be broadcast and texts need no shuffle
    chosen = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    return columns(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")


def _vocabulary(examples: DataFrame, max_terms: int) -> list[str]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            terms = list(held[0])
            arrays = [pa.array(terms, pa.string()), pa.array([held[0][t] for t in terms], pa.int64()), pa.array([held[1][t] for t in terms], pa.int64())]
            for c in held:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, ["term", "n", "toxic"])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen = {t for w in set(WORD.findall((text.as_py() or "").lower())) for t in terms_of(w)}
                held[0].update(seen)
                if toxic:
                    held[1].update(seen)
                if len(held[0]) > 300_000:
                    yield flush()
        yield flush()

    totals = examples.agg(F.count("*").alias("n"), F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("t")).first()
    n, t = float(totals["n"]), float(totals["t"] or 0)
    if not 0 < t < n:
        return []
    counts = examples.select("text", F.col("toxic") > 0).mapInArrow(released(count), "term string, n long, toxic long")
    sums = counts.groupBy("term").agg(F.sum("n").cast("double").alias("d"), F.sum("toxic").cast("double").alias("p"))
    d, p = F.col("d"), F.col("p")
    chi2 = n * (p * n - d * t) * (p * n - d * t) / (t * (n - t) * d * (n - d))
    likely = sums.filter((d >= MIN_DOCS) & (d < n)).withColumn("chi2", chi2).filter(F.col("chi2") >= MIN_CHI2)
    return [r["term"] for r in likely.orderBy(F.desc("chi2"), "term").limit(max_terms).select("term").collect()]


def _document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[int, int]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, df, n = Features(vocabulary), Counter(), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0):
                df.update(features.of(text.as_py()).keys())
        df[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.int32()), pa.array(list(df.values()), pa.int64())], ["term", "n"])

    rows = columns(docs, "text").mapInArrow(released(count), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    return found.pop(-1, 0), found


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS) -> Model:
    examples = _examples(docs, labels, max_examples)
    vocabulary = _vocabulary(examples, max_terms)
    if not vocabulary:
        share = examples.agg(F.avg(F.when(F.col("toxic") > 0, 1.0).otherwise(0.0))).first()[0]
        return Model([], [], base=share or 0.0)
    n, df = _document_frequencies(docs, vocabulary)
    model = Model(vocabulary, [math.log((1 + n) / (1 + df.get(i, 0))) + 1 for i in range(len(vocabulary))])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(vocabulary)
        for batch in batches:
            rows = [model.vector(features.of(t.as_py())) for t in batch.column(2)]
            arrays = [pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *arrays], ["id", "toxic", "terms", "weights"])

    labelled = examples.select(F.col("doc_id").cast("long").alias("id"), (F.col("toxic") > 0).cast("int").alias("toxic"), "text")
    made = labelled.mapInArrow(released(vectors), "id long, toxic int, terms array<int>, weights array<double>")
    # one vector for each doc_id, however many rows repeat it: at most max_examples short rows
    once = made.groupBy("id").agg(F.min(F.struct("terms", "weights", "toxic")).alias("v")).select("id", "v.*")
    rows = once.collect()
    model.examples = [(r["id"], r["toxic"], list(r["terms"]), list(r["weights"])) for r in rows if r["terms"]]
    bare = [r["toxic"] for r in rows if not r["terms"]]
    model.base = (sum(bare) + 0.5) / (len(bare) + 1) if len(bare) else 0.5
    model.calibration = _calibrate(docs.sparkSession, model)
    return model


def _calibrate(spark, model: Model) -> list[float]:
    """Bins of leave-one-out votes of the examples to shares of toxic ones."""

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sums = BlockMaxIndex(model.examples), {}
        for batch in batches:
            for n in batch.column(0).to_pylist():
                _, toxic, terms, weights = index.examples[n]
                best = index.nearest(terms, weights, NEIGHBOURS, without=n)
                if best:
                    b = min(BINS - 1, int(index.vote(best) * BINS))
                    old = sums.get(b, (0, 0))
                    sums[b] = (old[0] + toxic, old[1] + 1)
        arrays = [pa.array(list(sums), pa.int32()), *[pa.array([v[i] for v in sums.values()], pa.int64()) for i in (0, 1)]]
        yield pa.RecordBatch.from_arrays(arrays, ["bin", "toxic", "n"])

    rows = spark.range(len(model.examples)).mapInArrow(released(votes), "bin int, toxic long, n long")
    sums = {r["bin"]: (float(r["toxic"]), float(r["n"])) for r in rows.groupBy("bin").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).collect()}
    return _monotone([sums.get(b, (0.0, 0.0)) for b in range(BINS)])


class Scorer:
    def __init__(self, model: Model):
        self.model, self.features, self.index = model, Features(model.vocabulary), BlockMaxIndex(model.examples)
        self.known: dict[bytes, tuple[float, list[int]]] = {}

    def of(self, text: str | None) -> tuple[float, list[int]]:
        """Score, and the doc_ids of the nearest examples."""
        counts = self.features.of(text)
        if not counts:
            return self.model.base, []
        key = array("q", chain.from_iterable(sorted(counts.items()))).tobytes()
        if key not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            best = self.index.nearest(*self.model.vector(counts), NEIGHBOURS)
            ids = [self.index.examples[n][0] for _, n in best]
            b = min(BINS - 1, int(self.index.vote(best) * BINS)) if best else 0
            self.known[key] = (self.model.calibration[b] if best else self.model.base, ids)
        return self.known[key]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score and evidence."""
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.LongType()))])
    where = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_TERMS and MAX_EXAMPLES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            done = [scorer.of(t.as_py()) for t in batch.column(where)]
            arrays = [pa.array([d[0] for d in done], pa.float64()), pa.array([d[1] for d in done], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], schema.fieldNames())

    return docs.mapInArrow(released(work), schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (doc_ids of the nearest labelled rows) of every document."""
    rows = columns(docs, "doc_id", "text")
    scored = score(rows, fit(rows, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose score is 0.5 or more."""
    plain, where, back = numbered(docs)
    model = fit(columns(docs, "doc_id", "text"), labels)
    return back(score(plain, model, where["text"]).filter("score < 0.5"))

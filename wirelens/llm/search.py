"""Ranked lexical search by bit-sliced Bloom signatures.

``index`` packs documents of similar size into blocks. A document's signature is
a Bloom filter of its terms, with a further key for a term that occurs 2, 4, 8...
times or more; a block stores the signatures bit by bit, so that one row of bits
tells of one signature bit which documents have it. A signature has
``BITS_A_KEY`` bits or more for each key, however long the document is. Beside
the bits a block holds its documents' terms, each text compressed by itself.

``rank`` reads a term's rows, joins them by AND and gets, for all documents of a
block at once, the most often the term may occur; false positives only raise it.
With it the term's share of the score is bounded, the weighted sum over a query's
terms bounds the score. The ten documents with the largest bounds are scored
exactly first; their tenth score is the least that a document must reach. Then
every document whose bound isn't below that is scored exactly from its terms,
whatever their number, so the result is that of scoring all.

Scores are whole numbers: a term's weight w is floor(1000 ln((2N+2) / (2df+1))),
its share w * ((10^9 tf) div (1000 tf + 8 m)), m = 10 + (90 n N) div L.

What goes through the driver: the queries of a pass (``PASS_BYTES``; more queries
take more passes), their document frequencies, ten candidates and one threshold
for each. Blocks are scored where they lie; nothing of a document is shuffled.

Defined results: NULL, empty and term-less documents or queries match nothing;
repeated rows are ranked each; NULL doc_ids come after others of equal score;
repeated or NULL item_ids are queries of their own; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.llm.frames import ascii_lower, columns, cut

TOP = 10
PROBES = 4
BITS_A_KEY = 16
#: Bits and documents of a block.
CELLS = 1 << 24
BLOCK_DOCS = 2048
#: Bytes of query texts that one pass over the index takes.
PASS_BYTES = 4 << 20
KNOWN_TERMS = 300_000
#: Terms are runs of digits, letters A-Z (in lower case) and all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Bytes over 127 are parts of characters beyond ASCII, so terms of the bytes are terms of the text."""
    return text.translate(_TO_TERMS).split()


class _Hashes(dict):
    """64-bit hashes of terms; a bounded memory."""

    def __missing__(self, term: bytes) -> int:
        import xxhash

        if len(self) >= KNOWN_TERMS:
            self.clear()
        value = self[term] = xxhash.xxh3_64_intdigest(term)
        return value


def _probes(hashes, level: int, bits: int):
    """Signature bits (key, probe) of terms that occur 2^level times or more."""
    import numpy as np

    x = hashes + np.uint64(0x9E3779B97F4A7C15 * level & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    low, high = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(PROBES, dtype=np.uint64) * high[:, None]) % np.uint64(bits)).astype(np.int64)


def _levels(count: int) -> int:
    """Keys of a term that occurs ``count`` times."""
    return count.bit_length()


class _Builder:
    """Documents of one size class on their way into a block."""

    def __init__(self, bits: int):
        self.bits = bits
        self.room = max(8, min(BLOCK_DOCS, CELLS // bits))
        self.ids, self.lengths, self.texts, self.places = [], [], [], []

    def add(self, doc_id: pa.Array, terms: list[bytes], hashes, counts, pack) -> None:
        import numpy as np

        keys, level = [], 0
        while len(hashes):
            keys.append(_probes(hashes, level, self.bits).ravel())
            level += 1
            often = counts >= 1 << level
            hashes, counts = hashes[often], counts[often]
        self.places.append(np.concatenate(keys))
        self.ids.append(doc_id)
        self.lengths.append(len(terms))
        self.texts.append(pack(b" ".join(terms)))

    def block(self, number: int, pack) -> pa.RecordBatch:
        import numpy as np

        docs = len(self.ids)
        cells = np.zeros((self.bits, -(-docs // 8) * 8), bool)
        for d, places in enumerate(self.places):
            cells[places, d] = True
        slices = pack(np.packbits(cells, axis=1).tobytes())
        lists = [pa.array([v], pa.list_(t)) for v, t in ((self.lengths, pa.int64()), (self.texts, pa.binary()))]
        ids = pa.ListArray.from_arrays(pa.array([0, docs], pa.int32()), pa.concat_arrays(self.ids))
        arrays = [pa.array([number], pa.int64()), pa.array([self.bits], pa.int32()), ids, lists[0], pa.array([slices], pa.binary()), lists[1]]
        return pa.RecordBatch.from_arrays(arrays, ["block", "bits", "doc_ids", "lengths", "slices", "texts"])


def index(docs: DataFrame) -> DataFrame:
    """Blocks of all documents with a term: block, bits, doc_ids, lengths (terms), slices, texts. Written to the shared folder."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard
        from pyspark import TaskContext

        pack = zstandard.ZstdCompressor(level=3).compress
        known, open_blocks = _Hashes(), {}
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, cell in enumerate(batch.column(1)):
                terms = terms_of(cell.as_py() or b"")
                if not terms:
                    continue
                held = Counter(terms)
                counts = np.fromiter(held.values(), np.int64, len(held))
                hashes = np.fromiter(map(known.__getitem__, held), np.uint64, len(held))
                keys = sum(map(_levels, held.values()))
                bits = BITS_A_KEY << (keys - 1).bit_length()
                if bits not in open_blocks:
                    open_blocks[bits] = _Builder(bits)
                builder = open_blocks[bits]
                builder.add(batch.column(0).slice(i, 1), terms, hashes, counts, pack)
                if len(builder.ids) >= builder.room:
                    yield open_blocks.pop(bits).block(number, pack)
                    number += 1
        while open_blocks:
            yield open_blocks.popitem()[1].block(number, pack)
            number += 1

    rows = columns(docs, "doc_id", "text")
    ids = T.StructField("doc_ids", T.ArrayType(rows.schema["doc_id"].dataType))
    plain = T.StructType.fromDDL("block long, bits int, lengths array<long>, slices binary, texts array<binary>").fields
    return cut(rows.select("doc_id", F.col("text").cast("binary")).mapInArrow(work, T.StructType([*plain[:2], ids, *plain[2:]])))


@dataclass
class Queries:
    """A pass of queries: numbers, terms as positions in ``terms``, weights of these; N and L of the documents."""

    numbers: list[int]
    wanted: list[list[int]]
    terms: list[bytes]
    weights: list[int]
    n: int
    total: int

    def norm(self, length):
        return 10 + (90 * length * self.n) // self.total


def _share(tf, norm):
    return (1_000_000_000 * tf) // (1000 * tf + 8 * norm)


class _Bounds:
    """Upper bounds of the scores of a block's documents, a query at a time."""

    def __init__(self, queries: Queries):
        import numpy as np

        self.queries = queries
        known = _Hashes()
        self.hashes = np.array([known[t] for t in queries.terms], np.uint64)
        self.weights = np.array(queries.weights, np.int64)
        self.wanted = [np.array(w, np.int64) for w in queries.wanted]

    def of(self, bits: int, lengths: list[int], slices: bytes) -> Iterator[tuple[int, object]]:
        """(query's place, bounds of all documents) of every query with a term that may occur in the block."""
        import numpy as np
        import zstandard

        docs = len(lengths)
        rows = np.frombuffer(zstandard.ZstdDecompressor().decompress(slices), np.uint8).reshape(bits, -1)
        length = np.array(lengths, np.int64)
        norm = self.queries.norm(length)
        level = np.zeros((len(self.hashes), docs), np.uint8)
        live, still = np.arange(len(self.hashes)), None
        shares = [np.zeros(docs, np.int64)]
        top = int(length.max())
        while len(live) and 1 << (len(shares) - 1) <= top:
            n = len(shares)
            found = np.bitwise_and.reduce(rows[_probes(self.hashes[live], n - 1, bits)], axis=1)
            if still is not None:
                found &= still
            some = found.any(axis=1)
            live, still = live[some], found[some]
            level[live] += np.unpackbits(still, axis=1, count=docs)
            # seen at level n - 1 and not at n: fewer than 2^n times
            shares.append(_share(np.minimum(length, (1 << n) - 1), norm))
        table, column = np.array(shares), np.arange(docs)
        present = level.any(axis=1)
        for place, wanted in enumerate(self.wanted):
            use = wanted[present[wanted]]
            if len(use):
                yield place, (table[level[use], column] * self.weights[use, None]).sum(axis=0)


class _Scorer:
    """Exact scores of one block's documents; equal texts are counted once."""

    def __init__(self, queries: Queries, lengths: list[int], texts: list[bytes]):
        import zstandard

        self.queries, self.lengths, self.texts = queries, lengths, texts
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.known: dict[bytes, Counter] = {}

    def of(self, place: int, doc: int) -> int:
        q, text = self.queries, self.texts[doc]
        counts = self.known.get(text)
        if counts is None:
            if len(self.known) >= 64:
                self.known.clear()
            counts = self.known[text] = Counter(self.unpack(text).split())
        norm = q.norm(self.lengths[doc])
        return sum(q.weights[t] * _share(tf, norm) for t in q.wanted[place] if (tf := counts.get(q.terms[t])))


def _frequencies(blocks: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """In how many documents each of the given terms occurs, over all documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        wanted, found = frozenset(terms), Counter()
        for batch in batches:
            for texts in batch.column(0):
                for text in texts:
                    found.update(wanted.intersection(unpack(text.as_py()).split()))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["term", "n"])

    parts = blocks.select("texts").mapInArrow(work, "term binary, n long")
    return {bytes(r["term"]): r["n"] for r in parts.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def _first_scores(blocks: DataFrame, queries: Queries, top: int) -> list[int]:
    """For each query the least score that can be among the ``top``: the last of the exact scores of the documents with the largest bounds."""

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bounds, best = _Bounds(queries), [[] for _ in queries.wanted]
        for batch in batches:
            for block, bits, lengths, slices in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                for place, values in bounds.of(bits, lengths, slices):
                    heap = best[place]
                    for doc in np.argsort(-values, kind="stable")[:top].tolist():
                        if len(heap) < top:
                            heapq.heappush(heap, (int(values[doc]), -block, -doc))
                        elif (int(values[doc]), -block, -doc) > heap[0]:
                            heapq.heapreplace(heap, (int(values[doc]), -block, -doc))
        rows = [(place, bound, -block, -doc) for place, heap in enumerate(best) for bound, block, doc in heap if bound > 0]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["place", "bound", "block", "doc"])

    found = blocks.select("block", "bits", "lengths", "slices").mapInArrow(largest, "place long, bound long, block long, doc long")
    order = Window.partitionBy("place").orderBy(F.desc("bound"), "block", "doc")
    chosen: dict[int, list[tuple[int, int]]] = {}
    for r in found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).collect():
        chosen.setdefault(r["block"], []).append((r["place"], r["doc"]))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, block in enumerate(batch.column(0).to_pylist()):
                if block in chosen:
                    scorer = _Scorer(queries, batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                    rows += [(place, scorer.of(place, doc)) for place, doc in chosen[block]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(2)], ["place", "score"])

    some = blocks.select("block", "lengths", "texts").filter(F.col("block").isin(list(chosen))) if chosen else blocks.select("block", "lengths", "texts").limit(0)
    scores: list[list[int]] = [[] for _ in queries.wanted]
    for r in some.mapInArrow(exact, "place long, score long").collect():
        scores[r["place"]].append(r["score"])
    return [max(1, sorted(s)[-top]) if len(s) >= top else 1 for s in scores]


def _pass(blocks: DataFrame, queries: Queries, top: int) -> DataFrame:
    """number (of the query), doc_id, score: the best of every task, by score and doc_id."""
    least = _first_scores(blocks, queries, top)
    id_type = blocks.schema["doc_ids"].dataType.elementType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bounds, best = _Bounds(queries), [[] for _ in queries.wanted]
        ids_type = None
        for batch in batches:
            ids_type = batch.column(1).type.value_type
            for i, (bits, slices) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                lengths, scorer, ids = batch.column(2)[i].as_py(), None, None
                for place, values in bounds.of(bits, lengths, slices):
                    docs = np.flatnonzero(values >= least[place]).tolist()
                    if docs and scorer is None:
                        scorer, ids = _Scorer(queries, lengths, batch.column(4)[i].as_py()), batch.column(1)[i].as_py()
                    rows = [(-s, ids[d] is None, ids[d]) for d in docs if (s := scorer.of(place, d)) >= least[place]]
                    if rows:
                        best[place] = heapq.nsmallest(top, [*best[place], *rows], key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))
        if ids_type is not None:
            rows = [(queries.numbers[place], r) for place, found in enumerate(best) for r in found]
            arrays = [pa.array([n for n, _ in rows], pa.int64()), pa.array([r[2] for _, r in rows], ids_type), pa.array([-r[0] for _, r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["number", "doc_id", "score"])

    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])
    return blocks.select("bits", "doc_ids", "lengths", "slices", "texts").mapInArrow(work, schema)


def rank(blocks: DataFrame, items: DataFrame, top: int = TOP, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score of the ``top`` documents of ``index`` for every row of ``items`` (item_id, text)."""
    terms = F.array_distinct(F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0)))
    asked = cut(columns(items, "item_id", "text").select(F.monotonically_increasing_id().alias("number"), "item_id", terms.alias("terms"), F.octet_length("text").alias("size")))
    all_bytes = asked.agg(F.sum("size")).first()[0] or 0
    totals = blocks.agg(F.sum(F.size("lengths")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("total")).first()
    passes = -(-all_bytes // pass_bytes) if totals["n"] else 0
    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("doc_id", blocks.schema["doc_ids"].dataType.elementType), T.StructField("score", T.LongType())])
    best = blocks.sparkSession.createDataFrame([], schema)
    for k in range(passes):
        some = asked.filter(F.pmod(F.xxhash64("number"), F.lit(passes)) == k).select("number", "terms").collect()
        held = {r["number"]: [t.encode() for t in r["terms"]] for r in some}
        df = _frequencies(blocks, sorted({t for ts in held.values() for t in ts}))
        weights = {t: math.floor(1000 * math.log((2 * totals["n"] + 2) / (2 * d + 1))) for t, d in df.items()}
        used = sorted(t for t, w in weights.items() if w > 0)
        place = {t: i for i, t in enumerate(used)}
        wanted = [[place[t] for t in ts if t in place] for ts in held.values()]
        queries = Queries(list(held), wanted, used, [weights[t] for t in used], totals["n"], totals["total"])
        best = best.unionByName(_pass(blocks, queries, top)) if passes > 1 else _pass(blocks, queries, top)
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(asked.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The best documents of ``docs`` for every row of ``items``."""
    return rank(index(docs), items, top)

"""Near-duplicate lines across documents by a segment-partition edit join.

A line is what stands between line feeds, without white space around it. Lines
of ``MIN_CHARS`` characters or more within ``EDITS`` edits are linked, linked
lines are a class, and the first line of a class (smallest doc_id, then place)
stays. With ``short_lines`` (op9_line_dedup) shorter lines with a word take part
too: equal ones are a class, at no edits. Without it shorter lines always stay.

Two lines within t edits share one of t+1 segments of the shorter line, at a
place that the lengths and the segment's number confine to a few offsets. So
each line is indexed by its own segments and probes the segments of all lengths
from its own down to t less; both are rows (bucket, line). Equal lines are one
node from the start, whatever their number. Buckets go through
``components.grouped_links``; counts of characters and their neighbours rule pairs out, and a bucket
with too many pairs is refined by parts of these counts, of which linked lines
have one in common. Pairs are verified by ``edits.within``.

Defined results: a NULL or empty text has no lines and stays; a document that
loses every line with a word goes (``deduplicate``); rows with a NULL or
repeated doc_id are ordered by their place in the input after the others; an
empty table gives an empty table; other columns are ignored (or carried).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.llm.components import components, cross_pairs, grouped_links, open_groups
from wirelens.llm.edits import codes, within
from wirelens.llm.frames import SPACES, columns, cut, numbered, released, work_dir

EDITS = 2
MIN_CHARS = 24
#: Classes of characters, and of pairs of neighbours, that are counted.
BAG = 32
PAIR_BAG = 64
#: Buckets are sent by slices of their keys, and this many pairs of bucket and node are sorted at a time.
SLICE_BITS = 14
PAIRS = 1 << 20


def _segments(length: int, parts: int) -> list[tuple[int, int]]:
    """Start and length of even segments, the longer ones last."""
    base, longer = divmod(length, parts)
    spans, at = [], 0
    for i in range(parts):
        size = base + (i >= parts - longer)
        spans.append((at, size))
        at += size
    return spans


def _offsets(edits: int) -> list[tuple[int, int, int]]:
    """(gap, segment, offset): where a line looks for a segment of a line that is ``gap`` shorter."""
    found = []
    for gap in range(edits + 1):
        for i in range(edits + 1):
            # edits left of the segment are at most i, right of it at most edits - i
            low, high = max(-i, gap - (edits - i)), min(i, gap + (edits - i))
            found += [(gap, i, offset) for offset in range(low, high + 1)]
    return found


def probes(lengths, edits: int) -> Iterator[tuple]:
    """(lines, key numbers, starts, sizes) of all substrings under which lines of these lengths are filed.

    The key number tells the segment and the length of the line it belongs to.
    A line's own segments are those with no difference in length and no offset.
    """
    import numpy as np

    parts = edits + 1
    for gap, i, offset in _offsets(edits):
        whole = lengths - gap
        base, longer = whole // parts, whole % parts
        size = base + (i >= parts - longer)
        start = i * base + np.maximum(0, i - (parts - longer)) + offset
        lines = np.flatnonzero((whole >= parts) & (start >= 0) & (start + size <= lengths))
        yield lines, whole[lines] * parts + i, start[lines], size[lines]


class _Keys:
    """Bucket keys of lines: polynomials over the UTF-8 bytes of filed substrings, modulo 2^64.

    Running sums over a batch give every substring's polynomial by one
    difference. Keys that fall together only add candidates.
    """

    #: Bytes whose running sums are held at a time; a longer line is summed in stretches.
    BYTES = 1 << 19

    def __init__(self, edits: int):
        import numpy as np

        self.edits = edits
        base = 0x2545F4914F6CDD1D
        self.codes = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)
        self.up = self._powers(base, self.BYTES + 1)
        self.down = self._powers(pow(base, -1, 1 << 64), self.BYTES + 1)

    @staticmethod
    def _powers(base: int, n: int):
        import numpy as np

        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        return np.multiply.accumulate(factors)

    @staticmethod
    def _mixed(sums, numbers):
        import numpy as np

        x = sums + numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    def _sum(self, data) -> int:
        """The polynomial of one substring of any length."""
        import numpy as np

        total, step = 0, self.BYTES
        for n, at in enumerate(range(0, len(data), step)):
            part = data[at : at + step]
            total += int((self.codes[part] * self.up[: len(part)]).sum(dtype=np.uint64)) * pow(int(self.up[step]), n, 1 << 64)
        return total & 0xFFFFFFFFFFFFFFFF

    def _chunk(self, data, ends) -> tuple:
        """Keys, and to which line each belongs, of lines that end at ``ends`` in ``data``."""
        import numpy as np

        starts = np.append(0, ends[:-1])
        leads = None
        if len(data) and data.max() > 127:
            lead = (data & 0xC0) != 0x80
            leads = np.append(np.flatnonzero(lead), len(data))
            before = np.append(0, np.cumsum(lead))
            starts, ends = before[starts], before[ends]
        sums = None
        if len(data) <= self.BYTES:
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self.codes[data] * self.up[: len(data)], out=sums[1:])
        keys, owners = [], []
        for lines, numbers, at, size in probes(ends - starts, self.edits):
            first = starts[lines] + at
            last = first + size
            if leads is not None:
                first, last = leads[first], leads[last]
            if sums is None:
                found = np.array([self._sum(data[x:y]) for x, y in zip(first, last, strict=True)], np.uint64)
            else:
                found = (sums[last] - sums[first]) * self.down[first]
            keys.append(self._mixed(found, numbers))
            owners.append(lines)
        return np.concatenate(keys), np.concatenate(owners)

    def of(self, line: str) -> list[tuple[int, int, int]]:
        """Key, start and length of every filed substring of ``line``."""
        import numpy as np

        (keys, _), *_ = self.of_all(pa.array([line]))
        places = [x for _, _, at, size in probes(np.array([len(line)]), self.edits) for x in zip(at.tolist(), size.tolist(), strict=True)]
        return [(k, p, s) for k, (p, s) in zip(keys.tolist(), places, strict=True)]

    def of_all(self, lines: pa.Array) -> Iterator[tuple]:
        """Keys, and to which of ``lines`` each belongs, by and by."""
        import numpy as np

        texts = lines.cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + self.BYTES, "right")) - 1)
            keys, owners = self._chunk(data[ends[at] : ends[stop]], ends[at + 1 : stop + 1] - ends[at])
            yield keys, owners + at
            at = stop


def _packed(buckets, nodes) -> Iterator[pa.RecordBatch]:
    """Pairs of bucket and node, sorted and packed by slice: one row for many pairs."""
    import numpy as np

    order = np.argsort(buckets)
    pairs = np.empty((len(order), 2), np.uint64)
    pairs[:, 0], pairs[:, 1] = buckets[order], nodes[order]
    slices = (pairs[:, 0] >> np.uint64(64 - SLICE_BITS)).astype(np.int32)
    begins = np.append(0, np.flatnonzero(slices[1:] != slices[:-1]) + 1)
    offsets = np.append(begins, len(pairs)) * 16
    packs = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(pairs)])
    yield pa.RecordBatch.from_arrays([pa.array(slices[begins]), packs], ["slice", "pairs"])


def _told(buckets, nodes, told) -> tuple:
    """Of pairs of bucket and node: which to tell, as their bucket has several nodes, and one pair of each bucket to go on with."""
    import numpy as np

    order = np.argsort(buckets)
    b = buckets[order]
    alone = np.ones(len(b), bool)
    alone[1:] = b[1:] != b[:-1]
    alone[:-1] &= alone[1:]
    # most buckets have one pair
    rest = order[~alone]
    rest = rest[np.lexsort((~told[rest], nodes[rest], buckets[rest]))]
    b, n, t = buckets[rest], nodes[rest], told[rest]
    fresh = np.ones(len(b), bool)
    fresh[1:] = (b[1:] != b[:-1]) | (n[1:] != n[:-1])
    b, n, t = b[fresh], n[fresh], t[fresh]
    first = np.ones(len(b), bool)
    first[1:] = b[1:] != b[:-1]
    begins = np.flatnonzero(first)
    sizes = np.diff(np.append(begins, len(b)))
    several = sizes > 1
    out = np.repeat(several, sizes) & ~t
    lone = order[alone]
    kept = np.append(buckets[lone], b[begins]), np.append(nodes[lone], n[begins]), np.append(told[lone], several | t[begins])
    return b[out], n[out], kept


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed pairs sorted by slice the distinct ones whose bucket has several nodes.

    Many slices are settled at a time. A slice beyond PAIRS is settled in parts,
    and goes on with one pair of each bucket; then a pair may be told twice.
    """
    import numpy as np

    none = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, bool)
    waiting: list = []
    held, count, last = none, 0, None

    def settled() -> tuple:
        both = np.concatenate(waiting or [np.empty((0, 2), np.uint64)])
        return _told(np.append(held[0], both[:, 0]), np.append(held[1], both[:, 1]), np.append(held[2], np.zeros(len(both), bool)))

    def rows(b, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(b.view(np.int64)), pa.array(n.view(np.int64))], ["bucket", "node"])

    for batch in batches:
        for number, pack in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if count >= PAIRS:
                b, n, held = settled()
                same = held[0] >> np.uint64(64 - SLICE_BITS) == np.uint64(last)
                held = tuple(x[same] for x in held) if number == last else none
                waiting, count = [], 0
                yield rows(b, n)
            pairs = np.frombuffer(pack.as_buffer(), np.uint64).reshape(-1, 2)
            waiting.append(pairs)
            count += len(pairs)
            last = number
    yield rows(*settled()[:2])


def lines_of(docs: DataFrame, key: str, text: str, at: str, least: int = MIN_CHARS) -> DataFrame:
    """at, doc_id, line_no, line, node (hash of the line) of every line that takes part."""
    split = docs.select(F.col(at).alias("at"), F.col(key).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "raw"))
    line = split.select("at", "doc_id", "line_no", F.btrim("raw", F.lit(SPACES)).alias("line"))
    return line.filter(F.length("line") >= least).withColumn("node", F.xxhash64("line"))


def _with_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with the counts of their characters in BAG classes, and of their pairs of neighbours in PAIR_BAG."""
    import numpy as np

    def lists(bags) -> pa.Array:
        n, width = bags.shape
        return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(bags.reshape(-1)))

    for whole in batches:
        for start in range(0, whole.num_rows, 512):
            batch = whole.slice(start, 512)
            texts = batch.column(1).to_pylist()
            c = codes(texts)
            row = np.repeat(np.arange(len(texts), dtype=np.uint32), [len(t) for t in texts])
            bags = np.bincount(row * np.uint32(BAG) + c % np.uint32(BAG), minlength=len(texts) * BAG).astype(np.int32).reshape(-1, BAG)
            inside = row[1:] == row[:-1]
            pair = ((c[:-1] * np.uint32(31) + c[1:]) * np.uint32(0x9E3779B1) >> np.uint32(26))[inside]
            pairs = np.bincount(row[1:][inside] * np.uint32(PAIR_BAG) + pair, minlength=len(texts) * PAIR_BAG).astype(np.int32).reshape(-1, PAIR_BAG)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(bags), lists(pairs)], ["node", "line", "bag", "pairs"])


def linked_lines(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """node, comp of every line that is within ``edits`` edits of a different line."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        keys, buckets, nodes, count = _Keys(edits), [], [], 0
        for batch in batches:
            found, once = np.unique(np.asarray(batch.column(0)).view(np.uint64), return_index=True)
            for key, owner in keys.of_all(batch.column(1).take(pa.array(once))):
                buckets.append(key)
                nodes.append(found[owner])
                count += len(key)
                if count >= PAIRS:
                    yield from _packed(np.concatenate(buckets), np.concatenate(nodes))
                    buckets, nodes, count = [], [], 0
        if count:
            yield from _packed(np.concatenate(buckets), np.concatenate(nodes))

    spark = lines.sparkSession
    # one exchange of packed pairs: a slice's come one after another, and those of buckets with one line stop here
    filed = lines.select("node", "line").mapInArrow(released(file), "slice int, pairs binary").repartition("slice")
    members = cut(filed.sortWithinPartitions("slice").mapInArrow(released(_shared), "bucket long, node long"))
    taking_part = members.select("node").distinct()
    path = work_dir(spark)
    found = lines.select("node", "line").join(taking_part, "node", "left_semi").dropDuplicates(["node"])
    found.mapInArrow(released(_with_bags), "node long, line string, bag array<int>, pairs array<int>").write.option("compression", "zstd").parquet(path)
    texts = spark.read.parquet(path)
    facts = texts.select("node", F.struct(F.length("line").alias("n"), "bag", "pairs").alias("fact"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = within(batch.column(2).to_pylist(), batch.column(3).to_pylist(), edits)
            yield batch.select([0, 1]).filter(pa.array(near))

    def verify(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("node").alias("a"), F.col("line").alias("la"))
        right = texts.select(F.col("node").alias("b"), F.col("line").alias("lb"))
        both = pairs.join(right, "b").join(left, "a").filter(F.abs(F.length("la") - F.length("lb")) <= edits)
        return both.select("a", "b", "la", "lb").mapInArrow(released(compare), "a long, b long")

    def may_link(x: Column, y: Column) -> Column:
        """One edit changes at most two characters and four pairs of neighbours, counted with those that come and go."""

        def apart(which: str) -> Column:
            return F.aggregate(F.zip_with(x[which], y[which], lambda a, b: F.abs(a - b)), F.lit(0), lambda s, d: s + d)

        return (F.abs(x["n"] - y["n"]) <= edits) & (apart("bag") <= 2 * edits) & (apart("pairs") <= 4 * edits)

    def rest(heavy: DataFrame) -> DataFrame:
        """Pairs that also have a part of their character counts in common.

        At most 2 * edits counts differ, so of 2 * edits + 1 parts one is equal.
        """
        parts = [F.slice("bag", start + 1, size) for start, size in _segments(BAG, 2 * edits + 1)]
        keys = F.array(*[F.xxhash64("bucket", F.lit(n), part) for n, part in enumerate(parts)])
        finer = cut(heavy.join(texts, "node").select("node", "comp", F.explode(keys).alias("bucket")).distinct())
        return cross_pairs(finer, open_groups(finer), facts, may_link)

    return components(grouped_links(members, verify, rest, facts, may_link))


def _classed(lines: DataFrame, edits: int) -> DataFrame:
    """at, doc_id, line_no, the class's first line (class_doc_id, class_line_no), class_size and kept of every line."""
    # shorter lines are linked with equal ones only, and these are one node already
    comps = linked_lines(lines.filter(F.length("line") >= MIN_CHARS), edits)
    light = cut(lines.select("at", "doc_id", "line_no", "node"))
    rooted = light.join(comps, "node", "left").withColumn("root", F.coalesce("comp", "node")).drop("comp", "node")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at", "line_no")
    classes = rooted.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("class_size"))
    return rooted.join(classes, "root").select(
        "at", "doc_id", "line_no", F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"), "class_size",
        ((F.col("first.at") == F.col("at")) & (F.col("first.line_no") == F.col("line_no"))).alias("kept"),
    )


def line_classes(docs: DataFrame, edits: int = EDITS, short_lines: bool = False) -> DataFrame:
    """doc_id, line_no (from 0), class_doc_id, class_line_no, class_size, kept of every line that takes part."""
    rows = columns(docs, "doc_id", "text").withColumn("at", F.monotonically_increasing_id())
    return _classed(lines_of(rows, "doc_id", "text", "at", 1 if short_lines else MIN_CHARS), edits).drop("at")


def deduplicate(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """``docs`` without repeated lines; rows that lose every line with a word go, n_chars follows the text."""
    plain, where, back = numbered(docs)
    spark = docs.sparkSession
    path = work_dir(spark)
    plain.withColumn("at", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)
    text = where["text"]
    repeated = _classed(lines_of(rows, where["doc_id"], text, "at"), edits).filter("NOT kept")
    gone = repeated.groupBy("at").agg(F.collect_set("line_no").alias("gone"))
    joined = rows.join(gone, "at", "left")
    lines = F.filter(F.split(F.col(text), "\n"), lambda _, i: ~F.array_contains("gone", i))
    shorter = joined.withColumn(text, F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(lines, "\n")))
    left = shorter.filter(F.col("gone").isNull() | (F.btrim(text, F.lit(SPACES)) != ""))
    if "n_chars" in where:
        size = F.length(text).cast(docs.schema["n_chars"].dataType)
        left = left.withColumn(where["n_chars"], F.when(F.col("gone").isNull(), F.col(where["n_chars"])).otherwise(size))
    return back(left)

"""Repeated passages by level-wise doubling.

A window of ``LENGTH`` words can only repeat if all its shorter windows do. So
windows of about a quarter of that length come first; the ones that start twice
or more anywhere are kept, joined to stretches, and stretches with fewer words
than ``LENGTH`` go. What is left is looked at with windows of twice the length,
and so on until the full length is reached or nothing is left. Every word under
a window that is repeated at the full length is removed; a window repeats
wherever its word sequence starts again, in the same text too. Windows are judged
on the input, not on what is left of it.

Texts are packed into blocks of about ``BLOCK_BYTES`` once. At each level a block
sends the hashes of its windows to buckets, each hash once with a mark if the
block has it several times, and a bucket answers with one bit per hash: does
any other block have it, or this one twice. So a passage that a third of all
documents share is one entry per block, not one per document, and no task gets
the rows of a key. Levels below the last send 32 bits of a hash within the
bucket: hash collisions there only keep a stretch for the next level. The last
level compares 128 bits made from two independent hashes of the words.

Buckets grow in number with the words (``BUCKET_WINDOWS`` each), blocks with the
bytes; tables between levels are written to the shared folder.

Defined results: NULL, empty and blank texts have no words, and the digest of no
bytes; rows with NULL or repeated ids are rows of their own (equal texts of
``LENGTH`` words or more remove each other's words entirely); empty tables work;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from wirelens.llm.frames import columns, cut

LENGTH = 35
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Windows that a bucket has on average.
BUCKET_WINDOWS = 2_000_000

#: A block: rows (their place in the block), where a stretch starts in its row, its bytes; the stretches' texts behind each other, compressed.
_INTS = pa.list_(pa.int32())
BLOCK = pa.schema([("block", pa.int64()), ("words", pa.int64()), ("rows", _INTS), ("starts", _INTS), ("sizes", _INTS), ("data", pa.binary())])
KEYS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("several", pa.binary())])
ANSWERS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("bits", pa.binary())])


def levels(length: int) -> list[int]:
    """Window lengths: a quarter of ``length`` rounded up, doubled, and ``length`` itself last."""
    steps = [max(1, -(-length // 4))]
    while steps[-1] < length:
        steps.append(min(2 * steps[-1], length))
    return steps


#: Odd factors and offsets of the two independent hashes.
_FACTORS = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0x94D049BB133111EB), (0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0xFF51AFD7ED558CCD))
#: Words with more bytes are hashed one by one.
LONG_WORD = 512


def _mixed(a, b, half: int):
    """One hash of two, in order; wraps at 64 bits."""
    import numpy as np

    k, m, n = map(np.uint64, _FACTORS[half])
    x = a * k + (b ^ m)
    x ^= x >> np.uint64(32)
    x *= m
    x ^= x >> np.uint64(29)
    x *= n
    return x ^ (x >> np.uint64(32))


def _word_hashes(data: bytes, starts, ends, half: int):
    """Hashes of the words at these places, eight bytes of all words at a time."""
    import numpy as np
    import xxhash

    padded = np.frombuffer(data + bytes(8), np.uint8)
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    h = size.astype(np.uint64)
    live, at = np.flatnonzero(size <= LONG_WORD), 0
    while len(live):
        left = size[live] - at
        part = eight[starts[live] + at]
        short = left < 8
        part[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        h[live] = _mixed(h[live], part, half)
        at += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]], seed=half + 1)
    return h


def _window_hashes(h, length: int, half: int):
    """Hashes of all windows of ``length`` words by doubling: a window is two windows of half its length, which may overlap."""
    size = 1
    while size < length:
        step = min(size, length - size)
        h = _mixed(h[: max(0, len(h) - step)], h[step:], half)
        size += step
    return h


def _buckets_of(first, buckets: int):
    """Even ranges of the hashes, so that order by hash is order by bucket."""
    import numpy as np

    return ((first >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


class _Block:
    """A block's words: bytes, where each begins and ends, and the number of the first word of each stretch."""

    def __init__(self, rows: list[int], starts: list[int], sizes: list[int], data: bytes):
        import numpy as np
        import zstandard

        self.rows, self.first = rows, starts
        self.data = zstandard.ZstdDecompressor().decompress(data)
        raw = np.frombuffer(self.data, np.uint8)
        # the white space of the word rule; every stretch ends with some
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(raw) and not blank[0]:
            edges = np.append(0, edges)
        self.starts, self.ends = edges[::2], edges[1::2]
        self.offsets = np.searchsorted(self.starts, np.append(0, np.cumsum(sizes)))

    def windows(self, length: int):
        """Numbers of the words that begin a window inside their stretch, and their stretches."""
        import numpy as np

        stretch = np.repeat(np.arange(len(self.rows)), np.diff(self.offsets))
        at = np.flatnonzero(np.arange(len(stretch)) + length <= self.offsets[stretch + 1])
        return at, stretch[at]

    def hashes(self, length: int, whole: bool) -> list:
        """Window hashes; a second, independent one where ``whole`` is set."""
        at, _ = self.windows(length)
        if not len(at):
            return []
        return [_window_hashes(_word_hashes(self.data, self.starts, self.ends, half), length, half)[at] for half in range(1 + whole)]

    def keys(self, length: int, whole: bool, buckets: int, places: bool = True):
        """Distinct window hashes in order of bucket, their buckets, which are there several times, and each window's place among them."""
        import numpy as np

        cols = self.hashes(length, whole)
        if not cols:
            return None
        if not whole:
            cols = [(_buckets_of(cols[0], buckets) << np.uint64(32)) | (cols[0] & np.uint64(0xFFFFFFFF))]
        if whole or places:
            order = np.argsort(cols[0])
            held = [c[order] for c in cols]
            if whole and np.any((held[0][1:] == held[0][:-1]) & (held[1][1:] != held[1][:-1])):
                order = np.lexsort(cols[::-1])
                held = [c[order] for c in cols]
        else:
            held = [np.sort(cols[0])]
        fresh = np.ones(len(held[0]), bool)
        fresh[1:] = np.any([c[1:] != c[:-1] for c in held], axis=0)
        heads = np.flatnonzero(fresh)
        several = np.diff(np.append(heads, len(fresh))) > 1
        distinct = [c[heads] for c in held]
        own = _buckets_of(distinct[0], buckets) if whole else distinct[0] >> np.uint64(32)
        place = None
        if places:
            place = np.empty(len(fresh), np.int64)
            place[order] = np.cumsum(fresh) - 1
        return distinct, own.astype(np.int64), several, place

    def text(self, lo: int, hi: int) -> bytes:
        """Bytes from the first of some words to the last."""
        return self.data[self.starts[lo] : self.ends[hi - 1]] if hi > lo else b""

    def stretches(self) -> Iterator[tuple[int, int, int, int]]:
        """Row, number of the row's word that it begins with, and its words' numbers in the block (from, to)."""
        offsets = self.offsets.tolist()
        yield from zip(self.rows, self.first, offsets, offsets[1:], strict=False)


def _packed(rows: list[int], starts: list[int], texts: list[bytes]) -> tuple:
    import zstandard

    return rows, starts, [len(t) + 1 for t in texts], zstandard.ZstdCompressor(level=3).compress(b"".join([t + b"\n" for t in texts]))


def _cells(held: pa.Table, *names: str) -> list[tuple]:
    """Rows of a group's table; the empty side of a cogroup may come without columns."""
    return list(zip(*[held.column(n).to_pylist() for n in names], strict=True)) if held.num_rows else []


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) in blocks: BLOCK and the doc_ids of a block's rows. Written, so blocks stay as they are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = (TaskContext.get().partitionId() << 32) - 1
        texts, ids, size, words = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal number, texts, ids, size, words
            number += 1
            made = (number, words, *_packed(list(range(len(texts))), [0] * len(texts), texts))
            held = pa.concat_arrays(ids)
            doc_ids = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)
            texts, ids, size, words = [], [], 0, 0
            out = _batch([made], BLOCK)
            return pa.RecordBatch.from_arrays([*out.columns, doc_ids], [*out.schema.names, "doc_ids"])

        for batch in batches:
            for i, cell in enumerate(batch.column(1)):
                text = cell.as_py() or b""
                texts.append(text)
                ids.append(batch.column(0).slice(i, 1))
                size += len(text)
                words += len(text.split())
                if size >= block_bytes or len(texts) >= 1 << 20:
                    yield flush()
        if texts:
            yield flush()

    rows = columns(docs, "doc_id", "text")
    schema = T.StructType([*from_arrow_schema(BLOCK).fields, T.StructField("doc_ids", T.ArrayType(rows.schema["doc_id"].dataType))])
    return cut(rows.select("doc_id", F.col("text").cast("binary")).mapInArrow(work, schema))


def _sent(table: DataFrame, length: int, whole: bool, buckets: int) -> DataFrame:
    """KEYS: for each block and bucket the distinct hashes, and a bit for each that the block has several times."""
    import numpy as np

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *cells in _cells(batch, "block", "rows", "starts", "sizes", "data"):
                found = _Block(*cells).keys(length, whole, buckets, places=False)
                if found is None:
                    continue
                cols, own, several, _ = found
                numbers, starts = np.unique(own, return_index=True)
                rows = []
                for bucket, lo, hi in zip(numbers.tolist(), starts, [*starts[1:], len(own)], strict=True):
                    # sorted hashes, by bytes of equal weight: the upper ones hardly differ and shrink on the wire
                    planes = [c[lo:hi].astype("<u8") for c in cols] if whole else [(cols[0][lo:hi] & np.uint64(0xFFFFFFFF)).astype("<u4")]
                    flat = b"".join(p.view(np.uint8).reshape(len(p), -1).T.tobytes() for p in planes)
                    rows.append((bucket, block, flat, np.packbits(several[lo:hi]).tobytes()))
                yield _batch(rows, KEYS)

    return table.select("block", "rows", "starts", "sizes", "data").mapInArrow(work, from_arrow_schema(KEYS))


def _answers(whole: bool) -> Callable[[pa.Table], pa.Table]:
    """Of a bucket's rows (KEYS) the answers to its blocks: a bit for each hash that starts twice or more anywhere."""

    def work(held: pa.Table) -> pa.Table:
        import numpy as np

        widths = (8, 8) if whole else (4,)
        parts: list[list] = [[] for _ in widths]
        several, sizes = [], []
        for flat, bits in zip(held.column("hashes"), held.column("several"), strict=True):
            raw = np.frombuffer(flat.as_buffer(), np.uint8)
            n, at = len(raw) // sum(widths), 0
            for part, w in zip(parts, widths, strict=True):
                part.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(f"<u{w}").reshape(n))
                at += n * w
            several.append(np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=n).astype(bool))
            sizes.append(n)
        cols = [np.concatenate(p) for p in parts]
        marked = np.concatenate(several)
        order = np.argsort(cols[0])
        equal = [c[order][1:] == c[order][:-1] for c in cols]
        if whole and np.any(equal[0] & ~equal[1]):
            order = np.lexsort(cols[::-1])
            equal = [c[order][1:] == c[order][:-1] for c in cols]
        same = np.all(equal, axis=0)
        repeated = np.zeros(len(order), bool)
        repeated[1:] |= same
        repeated[:-1] |= same
        out = marked
        out[order] |= repeated
        bits = [np.packbits(x).tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]
        return pa.table([held.column("block"), held.column("bucket"), pa.array(bits, pa.binary())], ["block", "bucket", "bits"])

    return work


def _repeated(block: _Block, length: int, whole: bool, buckets: int, answers: pa.Table) -> list[tuple[int, int, int]]:
    """Stretch and words (from, to, as numbers in the block) under windows that are repeated, for each run of them."""
    import numpy as np

    found = block.keys(length, whole, buckets)
    if found is None:
        return []
    _, own, _, place = found
    counts = np.bincount(own, minlength=buckets)
    bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=counts[k]) for k, b in sorted(_cells(answers, "bucket", "bits"))]
    at, stretch = (x[np.concatenate(bits).astype(bool)[place]] for x in block.windows(length))
    if not len(at):
        return []
    gaps = np.flatnonzero((at[1:] - at[:-1] > 1) | (stretch[1:] != stretch[:-1]))
    heads, tails = np.append(0, gaps + 1), np.append(gaps, len(at) - 1)
    return list(zip(stretch[heads].tolist(), at[heads].tolist(), (at[tails] + length).tolist(), strict=True))


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for lo, hi in spans:
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _kept_stretches(table: DataFrame, answers: DataFrame, length: int, target: int, buckets: int, whole: bool) -> DataFrame:
    """BLOCK: stretches of repeated windows that have ``target`` words or more."""

    def work(_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for block, *cells in _cells(left, "block", "rows", "starts", "sizes", "data"):
            held = _Block(*cells)
            runs = [r for r in _repeated(held, length, whole, buckets, right) if r[2] - r[1] >= target]
            if runs:
                rows = [held.rows[k] for k, _, _ in runs]
                starts = [held.first[k] + lo - int(held.offsets[k]) for k, lo, _ in runs]
                out.append((block, sum(hi - lo for _, lo, hi in runs), *_packed(rows, starts, [held.text(lo, hi) for _, lo, hi in runs])))
        return pa.Table.from_batches([_batch(out, BLOCK)])

    return table.select(*BLOCK.names).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, from_arrow_schema(BLOCK))


def repeated_stretches(table: DataFrame, length: int = LENGTH, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """BLOCK: the stretches of ``blocks`` that windows of ``length`` words cover which start twice or more anywhere."""
    left = table.select(*BLOCK.names)
    for step in levels(length):
        words = left.agg(F.sum("words")).first()[0] or 0
        if not words:
            break
        buckets, whole = -(-words // bucket_windows), step == length
        answers = _sent(left, step, whole, buckets).groupBy("bucket").applyInArrow(_answers(whole), from_arrow_schema(ANSWERS))
        left = cut(_kept_stretches(left, answers, step, length, buckets, whole))
    return left.filter("words > 0")


def without_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_removed, spans (start and end of removed words) and text (kept words joined by a space) of every row."""
    made = blocks(docs, block_bytes)
    gone = repeated_stretches(made, length, bucket_windows)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", spans), ("text", pa.binary())])

    def work(_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        covered: dict[int, list[tuple[int, int]]] = {}
        for cells in _cells(right, "rows", "starts", "sizes", "data"):
            for row, start, lo, hi in _Block(*cells).stretches():
                covered.setdefault(row, []).append((start, start + hi - lo))
        out = []
        for cells in _cells(left, "rows", "starts", "sizes", "data"):
            held = _Block(*cells)
            for row, _, first, last in held.stretches():
                words = held.text(first, last).split()
                own = _joined(sorted(covered.get(row, ())))
                edges = [0, *[e for span in own for e in span], len(words)]
                kept = [w for lo, hi in zip(edges[::2], edges[1::2], strict=True) for w in words[lo:hi]]
                out.append((len(words), len(words) - len(kept), [{"start": lo, "end": hi} for lo, hi in own], b" ".join(kept)))
        ids = left.column("doc_ids").combine_chunks().flatten()
        rest = _batch(out, schema)
        return pa.Table.from_arrays([ids, *rest.columns], ["doc_id", *schema.names])

    id_type = made.schema["doc_ids"].dataType.elementType
    result = T.StructType([T.StructField("doc_id", id_type), *from_arrow_schema(schema).fields])
    done = made.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(work, result)
    return done.withColumn("text", F.col("text").cast("string"))


def digests(cleaned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256."""
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))

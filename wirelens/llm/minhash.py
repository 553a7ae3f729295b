"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard on full shingle sets.

Two random permutations of the 2^32 shingle numbers make the whole signature:
the first scatters a document's shingles, the second is shifted circularly, one
shift for each coordinate, and the smallest value is the coordinate. Both are
bijective integer mixers, so no table of permutations exists. ``BANDS`` bands
of ``ROWS`` coordinates are bucket keys. A pair at the threshold shares a bucket
except with probability 2e-6, a pair at similarity 0.3 shares one in fifty. Lower
thresholds take more bands (``bands_for``) and keep that probability.

Documents are grouped by their shingle set first, so equal documents are one
node and a large group of copies costs nothing further. Candidates come from
``components.grouped_links`` (leaders, then pairs across components, and a prefix
and position rule where these would be too many; no cap);
each is compared on the full sets, by 64-bit hashes of all shingles.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a set is the distinct
5-word shingles, or the whole sequence of a shorter text. Defined results: a
NULL or blank text has an empty set and is linked with nothing; rows with a
NULL id take part in links, their component is the smallest other id in it and
they are not ``kept``; equal rows are in one component; an empty table gives an
empty table; other columns are ignored (or carried, by ``deduplicate``).
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.llm.components import components, grouped_links
from wirelens.llm.frames import columns, cut, numbered, released, work_dir

WIDTH = 5
BANDS = 28
ROWS = 6
PERCENT = 85
#: Probability that a pair at the threshold shares no bucket.
MISS = 2e-6
#: Cells of the table that orders shingles in crowded buckets.
CELLS = 1 << 18


def bands_for(percent: int) -> int:
    """Bands by which a pair at ``percent`` is missed with probability ``MISS`` at most, ``BANDS`` or more."""
    return max(BANDS, math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS))))


def shingle_set(text: bytes | None):
    """Sorted distinct 64-bit hashes of the 5-word shingles of a text."""
    import numpy as np
    import xxhash

    tokens = (text or b"").lower().split()
    n = len(tokens)
    if n == 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, n)
    w = min(n, WIDTH)
    out = np.full(n - w + 1, w, np.uint64)
    for j in range(w):
        out ^= h[j : n - w + 1 + j]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _signatures(sets: list, bands: int = BANDS):
    """One row of bands * ROWS coordinates for each shingle set."""
    import numpy as np

    k = bands * ROWS
    shifts = (np.arange(1, k + 1, dtype=np.uint64) * np.uint64((1 << 32) // k + 12_345)).astype(np.uint32)[:, None]
    step = 512
    a, b = np.empty((k, step), np.uint32), np.empty((k, step), np.uint32)
    out = np.full((len(sets), k), 0xFFFFFFFF, np.uint32)
    for row, hashes in enumerate(sets):
        # first permutation: scatters the shingle numbers
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        for at in range(0, len(x), step):
            part = x[at : at + step]
            y, t = a[:, : len(part)], b[:, : len(part)]
            # second permutation, shifted circularly by each coordinate's shift
            np.add(part, shifts, out=y)
            np.right_shift(y, np.uint32(16), out=t)
            np.bitwise_xor(y, t, out=y)
            np.multiply(y, np.uint32(0x7FEB352D), out=y)
            np.right_shift(y, np.uint32(15), out=t)
            np.bitwise_xor(y, t, out=y)
            np.multiply(y, np.uint32(0x846CA68B), out=y)
            np.minimum(out[row], y.min(axis=1), out=out[row])
    return out


def _band_keys(signatures):
    import numpy as np

    coords = signatures.reshape(len(signatures), -1, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, coords.shape[1] + 1, dtype=np.uint64), coords.shape[:2]).copy()
    for j in range(ROWS):
        keys ^= coords[:, :, j]
        keys *= np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def sketch(docs: DataFrame, text: str, bands: int = BANDS) -> DataFrame:
    """``docs`` with at (a row number), node (hash of the shingle set), n_shingles and bands."""
    added = [T.StructField("at", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    rows = docs.withColumn("at", F.monotonically_increasing_id())
    schema = T.StructType([*docs.schema.fields, *added])
    where = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sets = [shingle_set(v.as_py()) for v in part.column(where).cast(pa.large_binary())]
                keys = _band_keys(_signatures(sets, bands))
                node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                empty = np.array([len(s) == 0 for s in sets], bool)
                buckets = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.reshape(-1), pa.int64()))
                size = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(node, mask=empty), size, buckets], schema.fieldNames())

    return rows.mapInArrow(released(work), schema)


def _verifier(texts: DataFrame, percent: int):
    """Pairs (a, b) of nodes to the links among them, by full sets of ``texts`` (node, n_shingles, text)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        recent: OrderedDict = OrderedDict()

        def full(node: int, text: bytes):
            if node in recent:
                recent.move_to_end(node)
            else:
                recent[node] = shingle_set(text)
                if len(recent) > 64:
                    recent.popitem(last=False)
            return recent[node]

        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            links = []
            for i in range(batch.num_rows):
                x, y = a[i].as_py(), b[i].as_py()
                s, t = full(x, ta[i].cast(pa.binary()).as_py()), full(y, tb[i].cast(pa.binary()).as_py())
                both = np.intersect1d(s, t, assume_unique=True).size
                if 100 * both >= percent * (len(s) + len(t) - both):
                    links.append((x, y))
            arrays = [pa.array([p[i] for p in links], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(arrays, ["a", "b"])

    def verify(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"), F.col("n_shingles").alias("na"))
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"), F.col("n_shingles").alias("nb"))
        sized = pairs.join(right, "b").join(left, "a").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        return sized.select("a", "b", "ta", "tb").mapInArrow(released(compare), "a long, b long")

    return verify


def near_duplicates(sketched: DataFrame, text: str, percent: int = PERCENT) -> DataFrame:
    """node, comp of every shingle set that is linked with another one. ``sketched`` is a written table."""
    full = sketched.filter("n_shingles > 0")
    spread = full.select("node", F.explode("bands").alias("bucket"))
    several = spread.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("bucket")
    spark = sketched.sparkSession
    path = work_dir(spark)
    spread.join(several, "bucket", "left_semi").distinct().write.parquet(path)
    members = spark.read.parquet(path)
    taking_part = members.select("node").distinct()
    once = full.select("node", "at").groupBy("node").agg(F.min("at").alias("at")).join(taking_part, "node", "left_semi")
    path = work_dir(spark)
    full.select("at", "n_shingles", F.col(text).alias("text")).join(once, "at").drop("at").write.option("compression", "zstd").parquet(path)
    texts = spark.read.parquet(path)

    facts = texts.select("node", F.col("n_shingles").alias("fact"))

    def may_link(x: Column, y: Column) -> Column:
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    return components(grouped_links(members, _verifier(texts, percent), _prefix_pairs(texts, percent), facts, may_link))


def _prefix_pairs(texts: DataFrame, percent: int):
    """Members (bucket, node, comp) of crowded buckets to candidate pairs by prefix and position.

    With the shingles of all sets in one order, rare ones first, two sets at the
    threshold share a shingle at places so early that enough may follow in
    both. Sets that differ only by edits of their own begin with these, so
    thousands of copies just under the threshold leave few pairs. The order
    comes from counts in a table of ``CELLS`` cells: any table gives all pairs.
    """

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(counts, (shingle_set(text.cast(pa.binary()).as_py()) % np.uint64(CELLS)).astype(np.int64), 1)
        used = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["cell", "n"])

    def pairs(heavy: DataFrame) -> DataFrame:
        import numpy as np

        nodes = heavy.select("node", "comp").distinct()
        rows = cut(texts.join(nodes, "node").select("node", "comp", "text"))
        counts = np.zeros(CELLS, np.int64)
        summed = rows.select("text").mapInArrow(released(cells), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        for r in summed.toLocalIterator():  # at most CELLS rows
            counts[r["cell"]] = r["n"]
        shared = heavy.sparkSession.sparkContext.broadcast(counts)

        def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[list] = [[], [], [], [], []]
                for node, comp, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    s = shingle_set(text.cast(pa.binary()).as_py())
                    n = len(s)
                    often = shared.value[(s % np.uint64(CELLS)).astype(np.int64)]
                    first = np.lexsort((s, often))[: n - -(-percent * n // 100) + 1]
                    # a shingle that is counted once has no partner
                    places = np.nonzero(often[first] > 1)[0]
                    out[0] += s[first[places]].view(np.int64).tolist()
                    out[1] += [node] * len(places)
                    out[2] += [comp] * len(places)
                    out[3] += [n] * len(places)
                    out[4] += places.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["shingle", "node", "comp", "n", "place"])

        filed = cut(rows.mapInArrow(released(prefixes), "shingle long, node long, comp long, n long, place long"))
        least = F.ceil(F.lit(percent) * (F.col("x.n") + F.col("y.n")) / F.lit(100 + percent))
        smaller = filed.filter(F.col("place") <= F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / F.lit(100 + percent))).alias("x")
        found = smaller.join(filed.alias("y"), F.col("x.shingle") == F.col("y.shingle")).filter(
            (F.col("x.comp") != F.col("y.comp"))
            & ((F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") != F.col("y.node"))))
            & (F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) >= least)
        )
        return found.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()

    return pairs


def _sketched(docs: DataFrame, text: str, percent: int) -> DataFrame:
    spark = docs.sparkSession
    path = work_dir(spark)
    sketch(docs, text, bands_for(percent)).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _with_components(sketched: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """``sketched`` with root (NULL for empty sets) and component_id."""
    comps = near_duplicates(sketched, text, percent)
    light = sketched.select("at", F.col(key).alias("id"), "node", "n_shingles")
    rooted = light.join(comps, "node", "left").withColumn("root", F.coalesce("comp", "node")).drop("comp")
    smallest = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least_id"), F.min(F.struct(F.col("id").isNull(), "id", "at"))["at"].alias("first_at"))
    joined = rooted.join(smallest, "root", "left")
    return joined.select(
        "at", "id", "n_shingles", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least_id")).alias("component_id"), F.coalesce("first_at", "at").alias("first_at")
    )


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    sketched = _sketched(columns(docs, "doc_id", "text"), "text", percent)
    found = _with_components(sketched, "doc_id", "text", percent)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each class: that with the smallest doc_id, of equal ones the first."""
    plain, where, back = numbered(docs)
    sketched = _sketched(plain, where["text"], percent)
    found = _with_components(sketched, where["doc_id"], where["text"], percent)
    return back(sketched.join(found.filter("at = first_at").select("at"), "at", "left_semi"))

"""Keys, packed pairs and distances of the line operator, and rounds of components, against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from wirelens.llm import components as c
from wirelens.llm import line_dedup as ld
from wirelens.llm.edits import within


def test_keys_of_batches_and_long_lines_are_those_of_single_lines():
    rng = random.Random(5)
    lines = ["".join(rng.choice("abé😀") for _ in range(rng.randrange(40))) for _ in range(200)] + ["", "x" * 600_000, "é" * 300_000, "y" * 70_000]
    keys, got = ld._Keys(2), defaultdict(list)
    for found, owners in keys.of_all(pa.array(["cut off", *lines]).slice(1)):
        for k, i in zip(found.tolist(), owners.tolist(), strict=True):
            got[i].append(k)
    assert all(got[i] == [k for k, _, _ in keys.of(line)] for i, line in enumerate(lines))
    short = ld._Keys(2)
    short.BYTES = 16
    assert all(short.of(s) == keys.of(s) for s in lines[:40])
    # a substring that stands elsewhere in a longer line has the same key
    assert {k for k, _, _ in keys.of("abcdefghi" * 4)} & {k for k, _, _ in keys.of("é" + "abcdefghi" * 4)}


def test_packed_pairs_tell_each_node_of_shared_buckets(monkeypatch):
    rng = random.Random(6)
    pairs = [((rng.randrange(200) << 56) + 7, rng.randrange(60)) for _ in range(3000)] + [(i << 50, i) for i in range(1, 400)]
    nodes = defaultdict(set)
    for b, n in pairs:
        nodes[b].add(n)
    want = {(b, n) for b, several in nodes.items() if len(several) > 1 for n in several}
    both = np.array(pairs, np.uint64)
    for at_a_time in (1 << 20, 50):
        monkeypatch.setattr(ld, "PAIRS", at_a_time)
        packed = [r for part in np.array_split(both, 7) for batch in ld._packed(part[:, 0], part[:, 1]) for r in batch.to_pylist()]
        assert len(packed) < len(pairs) // 2
        packed.sort(key=lambda r: r["slice"])
        schema = pa.schema([("slice", pa.int32()), ("pairs", pa.binary())])
        batches = [pa.RecordBatch.from_pylist(part, schema) for part in (packed[:90], packed[90:])]
        told = [(b % (1 << 64), n) for out in ld._shared(iter(batches)) for b, n in zip(*(x.to_pylist() for x in out.columns), strict=True)]
        assert set(told) == want
        assert at_a_time == 50 or len(told) == len(want)
    assert [b.num_rows for b in ld._shared(iter([]))] == [0]


def test_distances_of_uneven_texts():
    long = "ab" * 200_000
    left = [long, long, "a", "", "abc", long]
    right = [long[:1000] + "x" + long[1000:], "xyz" + long, "a" + long, "ab", "cab", long]
    assert within(left, right, 2).tolist() == [True, False, False, True, True, True]
    assert within([], [], 2).tolist() == []


def test_stars_take_no_round(spark, monkeypatch):
    written = []
    cut = c.cut
    monkeypatch.setattr(c, "cut", lambda df: written.append(1) or cut(df))
    stars = [(1, 5), (6, 1), (7, 1), (2, 3)]
    got = {r.node: r.comp for r in c.components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {1: 1, 5: 1, 6: 1, 7: 1, 2: 2, 3: 2}
    assert len(written) == 1

"""Repeated passages against a plain version, with tiny blocks and buckets too."""

import hashlib
import random
import re
from collections import Counter

import pytest

from wirelens.llm import repeats


def truth(rows, length):
    lists = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + length]) for w in lists for i in range(len(w) - length + 1))
    out = []
    for (doc_id, _), w in zip(rows, lists, strict=True):
        gone = {i + k for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for k in range(length)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), kept))
    return sorted(out, key=repr)


def corpus(seed, n, vocabulary, passage):
    """Random texts that share passages, some cut at their ends, some within one text."""
    rng = random.Random(seed)
    some = lambda k: [f"w{rng.randrange(vocabulary)}é"[: rng.choice((3, 9))] for _ in range(k)]
    passages = [some(rng.randrange(passage // 2 + 2, 3 * passage + 3)) for _ in range(12)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            lo = rng.randrange(len(p) // 2)
            words += some(rng.randrange(20)) + p[lo : lo + rng.randrange(1, len(p))]
        rows.append((i % 90 or None, rng.choice([" ", "\n\t", "  "]).join(words) if i % 17 else None))
    return [*rows, (900, "ha " * 80), (901, "ha " * 34), (902, " ".join(f"x{i}" for i in range(35)) * 1), (903, " " + " ".join(f"x{i}" for i in range(35)))]


@pytest.mark.parametrize(("length", "vocabulary", "block", "bucket"), [(35, 500, 3000, 700), (35, 4, 500, 200), (35, 50, 1 << 23, 1 << 21), (7, 30, 900, 50), (1, 40, 99, 9), (64, 9, 2000, 500)])
def test_equals_brute_force(spark, length, vocabulary, block, bucket):
    rows = corpus(length + vocabulary, 150, vocabulary, length)
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, words long")
    got = repeats.without_repeats(docs, length, block, bucket).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.text) for r in got], key=repr) == truth(rows, length)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_hashes_tell_words_apart():
    """Words of all lengths, also beyond eight bytes and beyond the long ones; both hashes."""
    import numpy as np

    words = [b"x" * n for n in range(1, 600)] + [b"%d" % i for i in range(20_000)] + [b"a" * 8 + b"%d" % i for i in range(999)]
    data = b" ".join(words)
    size = np.array([len(w) for w in words])
    ends = np.cumsum(size + 1) - 1
    for half in (0, 1):
        assert len(np.unique(repeats._word_hashes(data, ends - size, ends, half))) == len(words)
        h = repeats._word_hashes(data + b" " + data, np.append(ends - size, ends - size + len(data) + 1), np.append(ends, ends + len(data) + 1), half)
        assert (h[: len(words)] == h[len(words) :]).all()


def test_words_of_a_block():
    texts = ["", " a  b\n", "é\x0b😀\x1c x", "\t", "last", "z" * 2000].copy()
    block = repeats._Block(*repeats._packed(list(range(6)), [0] * 6, [t.encode() for t in texts]))
    got = [block.text(lo, hi).split() for _, _, lo, hi in block.stretches()]
    assert got == [[w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t)] for t in texts]


def test_levels():
    assert repeats.levels(35) == [9, 18, 35] and repeats.levels(64) == [16, 32, 64]
    assert repeats.levels(1) == [1] and repeats.levels(5) == [2, 4, 5]


def test_odd_rows(spark, odd_docs, no_docs):
    want = truth([(r.doc_id, r.text) for r in odd_docs.collect()], 35)
    got = repeats.digests(repeats.without_repeats(odd_docs)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == sorted(
        ((i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in want), key=repr
    )
    assert repeats.without_repeats(no_docs).collect() == []
    blank = odd_docs.filter("length(text) < 8 OR text IS NULL")
    assert {(r.n_words, len(r.spans)) for r in repeats.without_repeats(blank).collect()} == {(0, 0)}

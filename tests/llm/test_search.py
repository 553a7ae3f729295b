"""Ranked search against scoring every document, with tiny signatures and many passes too."""

import math
import random
import re
from collections import Counter

import pytest

from wirelens.llm import search


def truth(docs, items, top=10):
    pattern = re.compile(search.TERM)
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    terms = lambda t: pattern.findall((t or "").translate(lower))
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := terms(t))]
    n, total = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        rows = []
        for doc_id, counts, size in held:
            m = 100 - 90 + (90 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m)) for t in set(terms(text)) if t in counts)
            if score > 0:
                rows.append((-score, doc_id is None, doc_id or 0, doc_id))
        rows.sort(key=lambda r: r[:3])
        out += [(item, k + 1, r[3], -r[0]) for k, r in enumerate(rows[:top])]
    return sorted(out, key=repr)


def made(seed, n, vocabulary):
    rng = random.Random(seed)
    word = lambda: rng.choice(("W", "w", "é", "日")) + str(int(rng.paretovariate(0.7)) % vocabulary)
    docs = [(rng.randrange(n) if rng.random() < 0.98 else None, rng.choice((" ", "-", "\n")).join(word() for _ in range(int(rng.paretovariate(0.6)) % 2000))) for _ in range(n)]
    docs += [(9000 + i, docs[3][1]) for i in range(25)] + [(9100, None), (9101, ""), (9102, "?! --"), (5, docs[5][1])]
    items = [(i % 30, " ".join(word() for _ in range(rng.randrange(12)))) for i in range(40)] + [(None, docs[3][1][:60]), (77, None), (78, "...")]
    return docs, items


@pytest.mark.parametrize(("bits", "room", "pass_bytes"), [(16, 2048, 1 << 22), (1, 16, 200), (2, 8, 1 << 22)])
def test_equals_scoring_all(spark, monkeypatch, bits, room, pass_bytes):
    """With few bits nearly everything looks present: more is scored exactly, the result stays."""
    monkeypatch.setattr(search, "BITS_A_KEY", bits)
    monkeypatch.setattr(search, "BLOCK_DOCS", room)
    docs, items = made(bits, 400, 300)
    left = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, score long, block string")
    right = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, doc_id int")
    got = search.rank(search.index(left), right, pass_bytes=pass_bytes).collect()
    assert sorted(map(tuple, got), key=repr) == truth(docs, items)


def test_bounds_hold_and_exclude():
    docs, items = made(8, 600, 5000)
    builder = search._Builder(1 << 14)
    known, rows = search._Hashes(), []
    import numpy as np

    for _, text in docs:
        words = search.terms_of((text or "").encode())
        if 0 < len(words) < 900:
            counts = Counter(words)
            builder.add(None, words, np.array([known[t] for t in counts], np.uint64), np.array(list(counts.values())), lambda b: b)
            rows.append(words)
    cells = np.zeros((builder.bits, -(-len(rows) // 8) * 8), bool)
    for d, places in enumerate(builder.places):
        cells[places, d] = True
    import zstandard

    slices = zstandard.ZstdCompressor().compress(np.packbits(cells, axis=1).tobytes())
    terms = sorted({t for _, text in items for t in search.terms_of((text or "").encode())})
    wanted = [[terms.index(t) for t in dict.fromkeys(search.terms_of((text or "").encode()))] for _, text in items]
    q = search.Queries(list(range(len(items))), wanted, terms, [1000 + i for i in range(len(terms))], len(rows), sum(map(len, rows)))
    scorer = search._Scorer(q, [len(w) for w in rows], [zstandard.ZstdCompressor().compress(b" ".join(w)) for w in rows])
    loose = total = 0
    for place, bounds in search._Bounds(q).of(builder.bits, [len(w) for w in rows], slices):
        exact = [scorer.of(place, d) for d in range(len(rows))]
        assert all(b >= e for b, e in zip(bounds, exact, strict=True))
        loose += sum(b > 0 and e == 0 for b, e in zip(bounds, exact, strict=True))
        total += len(exact)
    assert loose < 0.02 * total


def test_odd_rows(spark, odd_docs, no_docs):
    items = [(1, "Alpha w5x5 日本語"), (1, "\U0001f600 ll"), (None, "one two")]
    right = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, search.search(odd_docs, right).collect()), key=repr)
    assert got == truth([(r.doc_id, r.text) for r in odd_docs.collect()], items)
    assert search.search(no_docs, right).collect() == [] and search.search(odd_docs, right.limit(0)).collect() == []
    named = odd_docs.selectExpr("concat('d', doc_id) AS doc_id", "text")
    assert {r.doc_id for r in search.search(named, right).collect() if r.doc_id} == {f"d{i}" for i in (1, 6, 7, 8, 9)}

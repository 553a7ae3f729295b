import hashlib
import zlib

import pytest

from wirelens.llm import bpe, licenses, shards, warc
from wirelens.llm import toxicity as tx
from wirelens.llm.queries import tokenizer_path


def test_bpe_equals_the_library(spark, odd_docs, no_docs):
    import numpy as np
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    tok.no_truncation()
    tok.no_padding()

    def want(doc_id, text):
        ids = tok.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, dtype="<u4").tobytes()
        back = tok.decode(ids, skip_special_tokens=False)
        return doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()

    texts = ["<|startoftext|>a<|endoftext|> b", "it's we'll I x\u0085y\x1cz", "é İ ǅ ΣΑΣ", "a\rb\x0cc", "́ ̈", "#" * 400 + " " + "x" * 900]
    docs = odd_docs.select("doc_id", "text", "node").unionByName(spark.createDataFrame([(50 + i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, node long"))
    got = bpe.digests(bpe.encode_and_decode(docs, tokenizer_path())).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((want(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert bpe.digests(bpe.encode_and_decode(no_docs, tokenizer_path())).collect() == []


def test_bpe_small_blocks_and_tables(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(tuple, bpe.encode(docs, tokenizer_path()).collect()))
    monkeypatch.setattr(bpe, "BLOCK_ROWS", 3)
    assert sorted(map(tuple, bpe.encode(docs, tokenizer_path()).collect())) == want


def test_shards_are_exact(spark, odd_docs, no_docs):
    rows = shards.shard_documents(odd_docs, shards=4).collect()
    assert len(rows) == odd_docs.count()
    texts = {(r.doc_id, r.text) for r in odd_docs.collect()}
    sizes = {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts}
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == sizes
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (2, 3)
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)
    assert shards.shard_documents(no_docs).collect() == []
    few = shards.shard_documents(odd_docs.limit(3), shards=24).collect()
    assert len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}


def test_shuffle_is_uniform(spark):
    """Every row is as likely in every shard and slot, whatever partition it comes from."""
    rows = spark.range(240).repartition(5)
    seen = {}
    for seed in range(6):
        for r in shards.shuffle(rows, 6, seed=seed).collect():
            seen.setdefault(r.id, []).append((r.shard, r.slot))
    assert all(len(set(v)) > 1 for v in seen.values())
    counts = [sum(s == k for v in seen.values() for s, _ in v) for k in range(6)]
    assert counts == [240] * 6


def test_matrix_sums_and_law():
    m = shards.communication_matrix([100, 0, 7, 893], 7, seed=1)
    assert [sum(r) for r in m] == [100, 0, 7, 893]
    sizes = [sum(c) for c in zip(*m, strict=True)]
    assert sum(sizes) == 1000 and max(sizes) - min(sizes) == 1
    cells = [shards.communication_matrix([10, 30], 2, seed=s)[0][0] for s in range(3000)]
    mean = sum(cells) / len(cells)
    spread = sum((c - mean) ** 2 for c in cells) / len(cells)
    assert abs(mean - 5) < 0.1 and abs(spread - 10 * 0.25 * 30 / 39) < 0.15


PAGES = [
    (1, "http://a/1", "x" * 99), (2, "http://a/2", "x" * 99), (3, "http://a/3", "y" * 100), (2, "http://a/2", "y" * 100), (9, None, "y" * 100),
    (10, "u\r\nWARC/1.1\r\n%", None), (11, "http://a/11", ""), (12, "http://a/12", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n0\r\n\r\n" * 20),
    (13, "http://a/13", "é 日本" * 50_000), (14, "http://a/14", "é 日本" * 50_000), (15, "http://a/15", "z" * 40_000), (15, "http://a/15", "z" * 40_000),
    (None, "http://a/n", "y" * 100), (None, "http://a/n", "only null " * 30), (16, "u", "q" * 8192), (17, "u", "q" * 8193),
]


def truth(rows):
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        first = min(same) if same and len(raw) >= 100 else i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if i == first else "revisit", None if i == first else first))
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment", [500, 32_768])
def test_archives_round_trip(spark, segment):
    pages = spark.createDataFrame([(*p, "t") for p in PAGES], "page_id long, url string, html string, type string")
    got = sorted(map(tuple, warc.archive_roundtrip(pages, segment).collect()), key=repr)
    assert got == truth(PAGES)
    assert warc.archive_roundtrip(pages.limit(0), segment).collect() == []


def test_payloads_and_uris_come_back(spark, tmp_path):
    pages = spark.createDataFrame(PAGES[8:9] + PAGES[5:6], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "w"), 1000)
    rows = {r.page_id: r for r in warc.read_archive(spark, str(tmp_path / "w")).collect()}
    assert bytes(rows["13"].payload).decode() == PAGES[8][2] and rows["13"].problem is None
    assert rows["10"].uri == "u%0D%0AWARC/1.1%0D%0A%25" and bytes(rows["10"].payload) == b""
    assert warc.read_records(spark, str(tmp_path / "w")).filter("type = 'continuation'").count() > 400


def test_broken_segments_are_told():
    block = warc.HEAD + warc.chunked(b"abc" * 100)
    part = lambda n, b: {"segment": n, "block": b}
    whole = [part(1, block[:50]), part(2, block[50:])]
    assert warc._decode("response", None, whole[::-1], len(block)) == (b"abc" * 100, None)
    assert warc._decode("response", None, whole, len(block) + 1) == (None, "the total length differs")
    assert warc._decode("response", None, [whole[0], part(3, b"")], 9) == (None, "segments are missing")
    assert warc._decode("response", None, whole, None) == (None, "the last segment is missing")
    assert warc._decode("response", "sha256:0", whole, len(block)) == (None, "the digest differs")
    assert warc._decode("response", None, [part(1, block[:-9])], None)[0] is None


def test_licenses(spark, odd_docs, no_docs):
    mit = dict((t[0] + t[1], t[2]) for t in licenses.TEMPLATES)["MITgrant"]
    words = mit.split()
    rows = [
        (1, "Foo bar. Licensed under the Apache License, Version 2.0. Baz"), (2, f"İİ {mit} and {mit}"), (3, " ".join(words[:20] + ["zzz"] + words[21:40] + words[42:])),
        (4, " ".join(words[:25])), (5, "This license is licensed under a license"), (None, "Released under the MIT License."), (7, "released UNDER the\nmit license"),
    ]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, license string")
    got = licenses.scan_licenses(docs).collect()
    found = sorted((r.doc_id or -1, r.license, r.template, r.matched_words) for r in got)
    n = len(licenses.WORD.findall(mit.lower()))
    assert found == [(-1, "MIT", "notice", 5), (1, "Apache-2.0", "notice", 8), (2, "MIT", "grant", n), (2, "MIT", "grant", n), (3, "MIT", "grant", n - 3), (7, "MIT", "notice", 5)]
    texts = {r[0]: r[1] for r in rows}
    spans = {texts[r.doc_id][r.start_char : r.end_char] for r in got if r.doc_id in (1, 7)}
    assert spans == {"Licensed under the Apache License, Version 2.0", "released UNDER the\nmit license"}
    assert licenses.scan_licenses(odd_docs).collect() == [] and licenses.scan_licenses(no_docs).collect() == []


def test_licenses_in_passes(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(tuple, licenses.scan_licenses(docs).collect()))
    monkeypatch.setattr(licenses, "PASS_BYTES", 60)
    assert sorted(map(tuple, licenses.scan_licenses(docs).collect())) == want and want


def test_nearest_equals_brute_force():
    import random

    rng = random.Random(9)

    def vector():
        terms = sorted(rng.sample(range(30), rng.randrange(1, 6)))
        w = [rng.random() for _ in terms]
        norm = sum(x * x for x in w) ** 0.5
        return terms, [x / norm for x in w]

    index = tx.BlockMaxIndex([(i, i % 2, *vector()) for i in range(1000)])
    for _ in range(100):
        terms, weights = vector()
        q = dict(zip(terms, weights, strict=True))
        sims = []
        for n, e in enumerate(index.examples):
            s = sum(q[t] * w for t, w in zip(e[2], e[3], strict=True) if t in q)
            if s > 0:
                sims.append((-s, n))
        want = sorted(sims)[:7]
        got = index.nearest(terms, weights, 7)
        assert [round(s, 9) for s, _ in got] == [round(-s, 9) for s, _ in want]


def test_toxic_words_are_learnt(spark, odd_docs, no_docs):
    import random

    rng = random.Random(3)
    plain = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        text = " ".join(rng.choices(plain, k=40) + ([f"vile{rng.randrange(9)}", "nasty"][rng.randrange(2) :] if bad else []))
        rows.append((i, text, bad))
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(b), 1) for i, _, b in rows if i % 3] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, text int")
    got = tx.score_documents(docs, labels).collect()
    assert len(got) == 600 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert [r.doc_id for r in got if r.predicted != rows[r.doc_id][2]] == []
    trained = {r.doc_id for r in got if not r.held_out and r.doc_id % 3}
    assert all(set(r.evidence) <= trained for r in got)
    kept = tx.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _, b in rows if not b}
    odd = tx.score_documents(odd_docs, labels.limit(0)).collect()
    assert len(odd) == odd_docs.count() and {r.score for r in odd} == {0.0}
    assert tx.score_documents(no_docs, labels).collect() == []


def test_calibration_is_monotone():
    out = tx._monotone([(0, 10), (3, 10), (1, 10), (0, 0), (9, 10)])
    assert out == sorted(out) and len(out) == 5

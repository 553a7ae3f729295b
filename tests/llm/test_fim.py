"""Fill-in-the-middle against a plain version, over many frames and odd texts."""

import hashlib
import random
import re

import pytest

from wirelens.llm import fim


def truth(doc_id, text, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    key = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(key[8 * i : 8 * i + 8], 16) for i in range(4)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return (doc_id, len(units), "plain", None, None, sha(text), sha(text))
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, len(units), form, len(p), len(m), sha(out), sha(text))


def made():
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("aé\n\n😀b ") for _ in range(rng.randrange(300)))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate(["", None, "\n", "a", "\n\n\n", "a\n", "x <P> y\nz", "<M", "<S>", "é" * 999, "abc\n" * 500 + "d" * 700 + "\ne"])]
    return rows + [(None, "a\nb\nc"), (5, "a\nb\nc"), (5, "a\nb\nc")]


@pytest.mark.parametrize("size", [7, 64, fim.FRAME_BYTES])
def test_equals_brute_force(spark, size):
    docs = spark.createDataFrame([(*r, 9, "f") for r in made()], "doc_id long, text string, n long, form string")
    out = fim.transform(fim.store(docs, size))
    got = sorted((tuple(r) for r in fim.digests(out).collect()), key=repr)
    assert got == sorted((truth(*r) for r in made()), key=repr)
    back = sorted(((r.doc_id, r.text) for r in fim.texts(fim.restore(out)).collect()), key=repr)
    assert back == sorted(((i, t or "") for i, t in made()), key=repr)


def test_rates_and_forms(spark):
    docs = spark.createDataFrame([(i, "a\nb\nc\n") for i in range(400)], "doc_id long, text string")
    got = sorted(tuple(r) for r in fim.digests(fim.transform(fim.store(docs), percent=30, spm_percent=20)).collect())
    assert got == sorted(truth(i, "a\nb\nc\n", 30, 20) for i in range(400))


def test_cuts_open_one_frame_each():
    """Frames that hold no cut keep their compressed bytes."""
    codec = fim.Codec()
    frames = codec.frames(b"".join(b"line %d\n" % i for i in range(1000)), 256)
    left, right = codec.split(frames, 501)
    assert len(frames) > 30 and len(set(frames) - {*left, *right}) <= 1
    assert b"".join(codec.unpack(f[3]) for f in left).count(b"\n") == 501


def test_odd_rows(spark, odd_docs, no_docs):
    got = sorted((tuple(r) for r in fim.fill_in_middle(odd_docs).collect()), key=repr)
    assert got == sorted((truth(r.doc_id, r.text) for r in odd_docs.collect()), key=repr)
    assert fim.fill_in_middle(no_docs).collect() == []
    assert fim.fill_in_middle(odd_docs.selectExpr("concat('d', doc_id) AS doc_id", "text")).count() == odd_docs.count()

import re
from collections import Counter

import pytest

from wirelens.llm import quality_ledger as ql
from wirelens.llm import url_rules as ur

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = WORDS.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force(spark, odd_docs):
    texts = ["a b c a b c a b c", "x x x x", "p q r s p q r", "l1\nl1\n\nl1 \nl2", "### a|b <c>", "a\x0bb\x0cc\rd"]
    docs = odd_docs.select("doc_id", "text", "node").unionByName(spark.createDataFrame([(100 + i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, node long"))
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in ql.ledger(docs).collect())
    assert got == sorted((r.doc_id or -1, *measures(r.text)) for r in docs.collect())


def test_policies_and_ablations(spark):
    book = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (4, 4), (5, 5)], "doc_id long, fail_bits long")
    kept = {r.doc_id: (r.kept, r.base) for r in ql.apply_policy(ql.apply_policy(book, 4), "base", "base").collect()}
    assert kept == {1: (True, True), 2: (True, False), 3: (True, False), 4: (False, True), 5: (False, False)}
    rows = {r.rule: (r.failed, r.failed_only, r.kept_without, r.kept) for r in ql.ablations(book, 5).collect()}
    assert rows == {"few_words": (3, 2, 3, 1), "symbols": (2, 1, 2, 1)}


def test_ledger_of_nothing(no_docs):
    assert ql.ledger(no_docs).collect() == []


def expected(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "http://xnet/", "http://a.example.net/en/1?q#f",
    "http://example.net/en", "http://b.a.example.com/de/", "http://example.com/de", "http://org/fr/x", "http://a.org/en/", "http://net./x",
    "http://.net/x", "http://a..net/x", "ftp://u:p@a.net:80/x", "http://a.net?x=/en/", "a://b.net/x://c.org/fr/", "http://ÄB.net/ü", "http://a.net/x\ny",
    "http://example.net.org/fr/", "http://a\n.net/x", "http://a.net/en/" + "x" * 5000,
]


def test_urls_equal_brute_force(spark):
    pages = spark.createDataFrame([(i % 20, u, "r", 1) for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string, open int")
    got = sorted(((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in ur.judge(pages, ur.rules_frame(spark)).collect()), key=repr)
    want = sorted(((i % 20, *[x or "" if n == 2 else x for n, x in enumerate(expected(u, ur.DEFAULT_RULES))]) for i, u in enumerate(URLS * 2)), key=repr)
    assert got == want


def test_many_nested_rules(spark):
    hosts = ["c", "b.c", "a.b.c", "x.a.b.c", "d", "b.d"]
    paths = ["/", "/p", "/p/q", "/p/q/r", "/z"]
    rules = tuple((h, p, "block" if (len(h) + len(p)) % 2 else "allow") for h in hosts for p in paths if (len(h) * len(p)) % 5)
    rules += (("a.b.c", "/p/q/", "allow"), ("a.b.c", "/p/q/", "block"))
    urls = [f"http://{s}{h}{p}{t}" for s in ("", "y.", "x.") for h in hosts for p in paths for t in ("", "/q", "r")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in ur.judge(pages, ur.rules_frame(spark, rules)).collect()}
    assert got == {i: expected(u, rules) for i, u in enumerate(urls)}


def test_nothing_to_judge(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert ur.judge(pages, ur.rules_frame(spark)).collect() == []
    one = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    none = spark.createDataFrame([(None, "/", "block")], "host string, path string, verdict string")
    assert [(r.rule, r.verdict) for r in ur.judge(one, none).collect()] == [(None, "allow")]


@pytest.mark.parametrize("name", ["op2_url_filters", "op3_quality_ledger"])
def test_native_plan(spark, sf, name):
    from wirelens.llm.queries import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().toString()
    assert not re.search(r"Python|Pandas|Arrow|Cartesian|NestedLoop", plan)

import random
import re
from collections import Counter

from wirelens.llm import decontaminate as dc
from wirelens.llm import line_dedup as ld
from wirelens.llm import minhash as mh
from wirelens.llm.components import components
from wirelens.llm.edits import within


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for x in range(len(sets)):
        for y in range(x):
            s, t = sets[x][1], sets[y][1]
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                parent[find(x)] = find(y)
    out = []
    for x, (i, s) in enumerate(sets):
        ids = [sets[y][0] for y in range(len(sets)) if find(y) == find(x) and sets[y][0] is not None] if s else [i]
        out.append((i, len(s), min(ids) if ids else None))
    return sorted(out, key=repr)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
    return words


def corpus():
    rng = random.Random(3)
    docs = []
    base = [f"b{rng.randrange(500)}" for _ in range(200)]
    # copies of one text: many just under and just over the threshold, so that one bucket holds several classes
    docs += [" ".join(edited(rng, base, rng.choice([0, 1, 2, 3, 3, 4, 5, 6]))) for _ in range(120)]
    for _ in range(15):
        other = [f"c{rng.randrange(300)}" for _ in range(rng.randrange(5, 300))]
        docs += [" ".join(edited(rng, other, rng.randrange(0, 4))) for _ in range(rng.randrange(1, 5))]
    docs += [" ".join(base[:100]), " ".join(base[:110]), " ".join(base[:95])]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_classes_equal_brute_force(spark, odd_docs):
    docs = corpus() + [(r.doc_id if r.doc_id is None else r.doc_id + 1000, r.text) for r in odd_docs.collect()]
    frame = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, node long")
    got = mh.classes(frame).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == classes(docs)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def test_prefix_rule_finds_the_same(spark, monkeypatch):
    from wirelens.llm import components as c

    monkeypatch.setattr(c, "PAIRS_A_MEMBER", 0)
    docs = corpus()
    got = mh.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == classes(docs)


def test_one_of_each_class_stays(spark, odd_docs, no_docs):
    kept = mh.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 7, 8, 9]
    assert mh.classes(no_docs).collect() == [] and mh.deduplicate(no_docs).collect() == []


def test_signature_estimates_similarity():
    import numpy as np

    rng = random.Random(1)
    base = [str(rng.random()) for _ in range(800)]
    sets = [mh.shingle_set(" ".join(w).encode()) for w in (base, edited(rng, base, 20), edited(rng, base, 60))]
    sig = mh._signatures(sets)
    for i in (1, 2):
        both = np.intersect1d(sets[0], sets[i]).size
        true = both / (len(sets[0]) + len(sets[i]) - both)
        assert abs((sig[0] == sig[i]).mean() - true) < 0.12


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutated(rng, s, n):
    s = list(s)
    for _ in range(n):
        at = rng.randrange(len(s) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            s.insert(at, rng.choice("abé"))
        elif at < len(s):
            s[at : at + 1] = [] if kind == 1 else [rng.choice("abc")]
    return "".join(s)


def test_edit_distance_and_segments():
    rng = random.Random(4)
    for k in (0, 1, 2, 4):
        left = ["".join(rng.choice("abc") for _ in range(rng.randrange(50))) for _ in range(800)]
        right = [mutated(rng, s, rng.randrange(k + 3)) for s in left]
        near = [distance(a, b) <= k for a, b in zip(left, right, strict=True)]
        assert within(left, right, k).tolist() == near
        keys = ld._Keys(k)
        for a, b, n in zip(left, right, near, strict=True):
            if n and min(len(a), len(b)) > k:
                assert {x for x, _, _ in keys.of(a)} & {x for x, _, _ in keys.of(b)}


def line_docs():
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(24, 80))).strip().ljust(24, "x") for _ in range(30)]
    docs = []
    for i in range(60):
        lines = [mutated(rng, rng.choice(base), rng.randrange(0, 4)) for _ in range(rng.randrange(0, 6))]
        docs.append((i, "\n".join([*lines, "short", ""])))
    return docs


def line_truth(docs):
    lines = [(i, n, x.strip(" \t\n\x0b\x0c\r")) for i, t in docs for n, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if len(x[2]) >= 24]
    parent = list(range(len(lines)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(lines)):
        for b in range(a):
            if distance(lines[a][2], lines[b][2]) <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {lines[a][:2]: lines[find(a)][:2] for a in range(len(lines))}


def test_lines_equal_brute_force(spark, monkeypatch):
    docs = line_docs()
    frame = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, line string")
    want = line_truth(docs)
    assert {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in ld.line_classes(frame).collect()} == want
    from wirelens.llm import components as c

    monkeypatch.setattr(c, "PAIRS_A_MEMBER", 0)
    assert {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in ld.line_classes(frame).collect()} == want


def test_query_has_short_lines_as_exact_classes(spark, tmp_path):
    from wirelens.llm.queries import QUERIES

    docs = [(i, t + "\n \nAnd.\nnote %d" % (i % 7)) for i, t in line_docs()] + [(90, "x" * 23), (91, "x" * 24), (92, "x" * 23), (93, "  y\n\ny"), (94, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = [(i, n, x.strip(" \t\n\x0b\x0c\r")) for i, t in docs for n, x in enumerate((t or "").split("\n"))]
    want, first = line_truth([d for d in docs if d[1]]), {}
    for i, n, x in lines:
        if 0 < len(x) < 24:
            want[i, n] = first.setdefault(x, (i, n))
    got = QUERIES["op9_line_dedup"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in got} == want
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[want[r.doc_id, r.line_no]] and r.kept == (want[r.doc_id, r.line_no] == (r.doc_id, r.line_no)) for r in got)


def test_repeated_lines_go(spark, odd_docs, no_docs):
    one, two = "a line that many documents share", "another line of some length here"
    rows = [(1, f"{one}\n{two}", 9), (2, f"x\n{one}.\ny", 9), (3, f"{two}\n{one}", 9), (None, one, 9), (5, None, 9), (6, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    out = {r.doc_id: (r.text, r.n_chars) for r in ld.deduplicate(docs).collect()}
    assert out == {1: (f"{one}\n{two}", 9), 2: ("x\ny", 3), 5: (None, 9), 6: ("", 9)}
    assert ld.deduplicate(no_docs).collect() == [] and ld.line_classes(no_docs).collect() == []
    assert ld.deduplicate(odd_docs).columns == odd_docs.columns


def test_masks_hit_every_pattern():
    from itertools import combinations

    for width, edits in ((13, 2), (16, 3)):
        for gone in combinations(range(width), edits):
            assert any(all(p + o not in gone for o in m) for m in dc.MASKS for p in range(width - m[-1]))


def test_overlaps(spark, odd_docs, no_docs):
    rng = random.Random(8)
    item = [f"t{i}" for i in range(30)]
    noise = [f"n{rng.randrange(9999)}" for _ in range(50)]
    subbed = [w if i not in (4, 11, 20) else "zzz" for i, w in enumerate(item)]
    rows = [(1, " ".join(noise + item + noise)), (2, " ".join(noise[:3] + subbed)), (3, " ".join(item[8:21])), (4, " ".join(item[:12] + noise)), (5, " ".join(noise)), (5, ", ".join(item).upper()), (None, " ".join(item))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ix int")
    items = spark.createDataFrame([(10, " ".join(item), 3), (11, "too short", 3), (12, None, 3), (None, "", 3)], "item_id long, text string, at int")
    got = sorted(((r.doc_id or -1, r.item_id, r.overlap_words, r.matched_words, r.doc_start, r.item_start) for r in dc.contaminated(docs, items).collect()))
    assert got == [(-1, 10, 30, 30, 0, 0), (1, 10, 30, 30, 50, 0), (2, 10, 25, 23, 8, 5), (3, 10, 13, 13, 0, 8), (5, 10, 30, 30, 0, 0)]
    assert sorted(r.doc_id for r in dc.remove_contaminated(docs, items).collect()) == [4, 5]
    assert dc.remove_contaminated(odd_docs, items).count() == odd_docs.count() and dc.remove_contaminated(odd_docs, items).columns == odd_docs.columns
    assert dc.contaminated(no_docs, items).collect() == [] and dc.contaminated(odd_docs, items.limit(0)).collect() == []


def test_stage_takes_any_long_enough_segment(spark):
    """Every overlap of 13 words with two substitutions, 15 with one, 16 with three; others as brute force says."""
    from itertools import combinations

    rng = random.Random(10)
    cases = [(n, gone) for n, k in ((13, 2), (15, 1), (16, 3)) for gone in combinations(range(n), k)]
    whole = len(cases)
    cases += [(n, tuple(rng.sample(range(n), rng.randrange(1, 6)))) for n in (7, 8, 10, 12, 13, 18, 30) for _ in range(40)]
    cases += [(30, tuple(range(12, 30))), (30, tuple(range(13, 30)))]

    def truth(n, gone):
        hit, least = [i not in gone for i in range(n)], min(13, n)
        seeded = any(all(hit[p + o] for o in m) for m in dc.MASKS for p in range(n - m[-1]))
        ends = [(b, e) for b in range(n) for e in range(b + least, n + 1) if (hit[b] or b == 0) and (hit[e - 1] or e == n)]
        return seeded and any(sum(1 if h else -4 for h in hit[b:e]) > 0 for b, e in ends)

    docs = [(i, " ".join([f"x{i}", *["zz" if j in gone else f"t{n}w{j}" for j in range(n)], f"y{i}"])) for i, (n, gone) in enumerate(cases)]
    items = [(n, " ".join(f"t{n}w{j}" for j in range(n))) for n in sorted({n for n, _ in cases})]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {i for i, c in enumerate(cases) if not truth(*c)}
    assert {r.doc_id for r in dc.remove_contaminated(docs, items).collect()} == want
    assert want and min(want) >= whole


def test_overlaps_without_broadcast(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = sorted(map(tuple, dc.contaminated(docs, items).collect()))
    monkeypatch.setattr(dc, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, dc.contaminated(docs, items).collect())) == want and want


def test_decontamination_is_native(spark, sf):
    from wirelens.llm.queries import QUERIES

    plan = QUERIES["op7_decontamination"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search(r"Python|Pandas|Arrow|Cartesian|NestedLoop", plan)

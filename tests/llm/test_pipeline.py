import random
import re
import tracemalloc

import corpus_pipeline
from wirelens.llm import bpe, decontaminate, line_dedup, minhash, toxicity
from wirelens.llm.frames import released
from wirelens.llm.queries import ORACLES, QUERIES, tokenizer_path


def test_stages_take_effect_in_order(spark, sf):
    """Every stage's rows are those of its operator's own, tested, results on that stage's input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    labels, items = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == columns
        ids = sorted(r.doc_id for r in out.select("doc_id").collect())
        if name == "toxicity":
            want = toxicity.score_documents(docs, labels).filter("predicted = 0")
        elif name == "near_dedup":
            want = minhash.classes(docs).filter("kept")
        elif name == "decontamination":
            want = docs.join(decontaminate.contaminated(docs, items), "doc_id", "left_anti")
        else:
            lines = line_dedup.line_classes(docs).collect()
            gone = {}
            for r in lines:
                if not r.kept:
                    gone.setdefault(r.doc_id, set()).add(r.line_no)
            texts = {}
            for r in docs.collect():
                left = [x for n, x in enumerate(r.text.split("\n")) if n not in gone.get(r.doc_id, ())]
                if r.doc_id not in gone or "".join(left).strip(" \t\n\x0b\x0c\r"):
                    texts[r.doc_id] = "\n".join(left)
            assert {r.doc_id: r.text for r in out.collect()} == texts
            want = None
        if want is not None:
            assert ids == sorted(r.doc_id for r in want.select("doc_id").collect())
        docs = out
        sizes.append(len(ids))
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[-1] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    want = bpe.digests(bpe.encode_and_decode(docs, tokenizer_path()))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_near_dedup_takes_pairs_from_four_fifths(spark, sf):
    """The stage's rows are those of brute force at a Jaccard similarity of 0.8."""
    rng = random.Random(12)
    docs = []
    for n in (4, 5, 6, 7, 8) * 4:
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        # each edit takes five of 296 shingles: similarities on both sides of 0.8 and 0.85
        docs += [" ".join(base), " ".join(f"e{i}" if i in range(20, 20 + 30 * n, 30) else w for i, w in enumerate(base))]
    sets = [{tuple(d.split()[i : i + 5]) for i in range(296)} for d in docs]
    near = [(a, b) for b in range(len(docs)) for a in range(b) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    root = list(range(len(docs)))
    for _ in docs:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), sf)
    assert sorted(r.doc_id for r in out.collect()) == [i for i, r in enumerate(root) if i == r]
    between = [(a, b) for a, b in near if 100 * len(sets[a] & sets[b]) < 85 * len(sets[a] | sets[b])]
    assert between and minhash.bands_for(85) == minhash.BANDS
    assert (1 - 0.8**minhash.ROWS) ** minhash.bands_for(80) <= minhash.MISS


def test_run_on_odd_documents(spark, odd_docs, sf):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(r.doc_id for r in docs.collect()) == [1, 2, 3, 4, 7, 8, 9]


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_token_ids_take_one_python_process_a_task(spark, odd_docs):
    """Decoding has no Python step of its own behind the one that puts the ids together."""
    coded = corpus_pipeline.encode(spark, odd_docs, "")
    plan = coded._jdf.queryExecution().executedPlan().toString()
    steps = re.findall("Exchange|MapInArrow|FlatMapCoGroupsInArrow", plan)
    assert steps.count("FlatMapCoGroupsInArrow") == 1
    assert "MapInArrow" not in steps[: steps.index("FlatMapCoGroupsInArrow")]
    want = bpe.digests(bpe.decode(bpe.encode(odd_docs, tokenizer_path()), tokenizer_path()))
    key = [(str(r.doc_id), *r[1:]) for r in want.collect()]
    assert sorted(key) == sorted((str(r.doc_id), *r[1:]) for r in coded.collect())


def test_python_processes_give_memory_back(spark):
    """What a task held isn't kept by the process that Spark reuses for later tasks."""

    def resident() -> int:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    def work(batches):
        held = [bytes(2000) for _ in range(40_000)]
        for batch in batches:
            yield batch
        pins.append(held[-1])  # the last block stays, so that the heap can't shrink from its end

    pins: list = []
    before = resident()
    assert list(released(work)(iter([]))) == []
    assert resident() - before < 40_000_000


def test_index_of_examples_is_built_in_arrays(spark):
    """Building takes a few machine words for each posting, not an object for each."""
    rng = random.Random(5)
    examples = [(i, i % 2, sorted(rng.sample(range(512), 60)), [rng.random() for _ in range(60)]) for i in range(2000)]
    tracemalloc.start()
    index = toxicity.BlockMaxIndex(examples)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert sum(len(ids) for ids, _ in index.postings.values()) == 120_000
    assert most < 60 * 120_000
    assert toxicity.BlockMaxIndex([]).nearest([1], [1.0], 3) == []

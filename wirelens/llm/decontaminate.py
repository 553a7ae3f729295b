"""Benchmark decontamination by spaced-seed hashing.

A text is its runs of letters and digits in lower case. Fixed masks pick some of
the words of a short window and ignore the others, so a substituted word under a
gap leaves the hash as it is. Hashes of all windows of all documents are joined
with those of the benchmark; a hit names an item and an alignment (document
position minus item position). Every alignment with a hit is then verified
whole: a matching word scores 1, a substitution costs 4, and the best segment is
an overlap if it has ``MIN_WORDS`` words (or the whole item, if that is shorter).
A positive score means that over 80 % of the segment's words match. ``contaminated``
(op7_decontamination, as its SQL says) takes the best segment of an alignment and
then asks for its length; ``remove_contaminated`` takes any segment of that length,
as the best one may be a shorter part of an overlap.

The masks find every overlap of 13 words with two substitutions and of 16 words
with three, wherever these fall (tests/llm enumerates all patterns).

Window hashes are made by generated code from the words of a row; only hits
leave it. The benchmark's hashes are broadcast when its texts have at most
``BROADCAST_BYTES``; beyond that the windows are joined by a shuffle.

Defined results: NULL or short texts (under 6 words) have no windows and no
overlaps, on either side; repeated documents and items are separate rows, NULL
ids stay NULL; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.llm.frames import columns, cut, let, numbered

#: Offsets of the words that a seed reads.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 2, 3, 5))
SPAN = 1 + max(m[-1] for m in MASKS)
MIN_WORDS = 13
PENALTY = 4
BROADCAST_BYTES = 16 << 20


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _seeds(rows: DataFrame, place: str) -> DataFrame:
    """One row per window and mask: hash ``h`` and the window's position."""
    long_enough = rows.filter(F.size("w") >= SPAN)
    at = long_enough.withColumn(place, F.explode(F.sequence(F.lit(0), F.size("w") - SPAN)))
    hashes = [F.xxhash64(F.lit(n), *[F.get(F.col("w"), F.col(place) + o) for o in mask]) for n, mask in enumerate(MASKS)]
    return at.withColumn("h", F.explode(F.array(*hashes)))


def _best_segment(doc: Column, item: Column) -> Column:
    """Best-scoring segment of two aligned word lists: score, start, stop (exclusive), matched.

    Of equal scores the earliest end counts, and its latest start.
    """
    same = F.zip_with(doc, item, lambda a, b: F.coalesce(a == b, F.lit(False)))

    def state(score, start, matched, at, best) -> Column:
        return F.struct(score.alias("score"), start.alias("start"), matched.alias("matched"), at.alias("at"), best.alias("best"))

    def found(score, start, stop, matched) -> Column:
        return F.struct(score.alias("score"), start.alias("start"), stop.alias("stop"), matched.alias("matched"))

    zero = F.lit(0)

    def step(s: Column, hit: Column) -> Column:
        fresh = s["score"] <= 0
        score = F.when(fresh, zero).otherwise(s["score"]) + F.when(hit, F.lit(1)).otherwise(F.lit(-PENALTY))
        start = F.when(fresh, s["at"]).otherwise(s["start"])
        matched = F.when(fresh, zero).otherwise(s["matched"]) + F.when(hit, F.lit(1)).otherwise(zero)
        best = F.when(score > s["best"]["score"], found(score, start, s["at"] + 1, matched)).otherwise(s["best"])
        return state(score, start, matched, s["at"] + 1, best)

    return F.aggregate(same, state(zero, zero, zero, zero, found(zero, zero, zero, zero)), step, lambda s: s["best"])


def _has_overlap(doc: Column, item: Column, n: Column, skipped: Column) -> Column:
    """Whether any segment of two aligned word lists is long enough and has a positive score.

    A segment has at least ``MIN_WORDS`` words (or the whole item of ``n`` words,
    if that is shorter) and begins and ends with a matching word or an end of
    the item. The best one for each end begins at the lowest score so far of
    the places that far back.
    """
    least, none = F.least(F.lit(MIN_WORDS), n), F.lit(1 << 30)

    def found(hits: Column) -> Column:
        def points(at: Column) -> Column:
            return F.when(F.get(hits, at), F.lit(1)).otherwise(F.lit(-PENALTY))

        def state(score, back, low, ok) -> Column:
            return F.struct(score.alias("score"), back.alias("back"), low.alias("low"), ok.alias("ok"))

        def step(s: Column, stop: Column) -> Column:
            # scores of all words before ``stop`` and before the last place where its segment may begin
            begin = stop - least
            score = s["score"] + points(stop - 1)
            back = s["back"] + F.when(begin > 0, points(begin - 1)).otherwise(F.lit(0))
            may_begin = (begin >= 0) & (F.get(hits, F.greatest(begin, F.lit(0))) | (begin + skipped == 0))
            low = F.when(may_begin, F.least(s["low"], back)).otherwise(s["low"])
            may_end = F.get(hits, stop - 1) | (stop + skipped == n)
            return state(score, back, low, s["ok"] | (may_end & (score > low)))

        zero = F.lit(0)
        return F.aggregate(F.sequence(F.lit(1), F.size(hits)), state(zero, zero, none, F.lit(False)), step, lambda s: s["ok"])

    return let(F.zip_with(doc, item, lambda a, b: F.coalesce(a == b, F.lit(False))), found)


def _alignments(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every alignment of a document row and an item with a hit: at, doc_id, item_id, ix, shift, n, skip, dw and iw (aligned words)."""
    items = columns(benchmark, "item_id", "text").select(
        F.monotonically_increasing_id().alias("ix"), "item_id", F.octet_length("text").alias("size"), tokens(F.col("text")).alias("w")
    )
    items = cut(items)
    bounded = (items.agg(F.sum("size")).first()[0] or 0) <= BROADCAST_BYTES
    small = F.broadcast if bounded else (lambda df: df)

    seeds = _seeds(items.select("ix", F.size("w").alias("n"), "w"), "j").select("h", "ix", "n", "j")
    probes = _seeds(docs.select("at", "doc_id", tokens(F.col("text")).alias("w")), "i")
    shift = F.col("i") - F.col("j")
    hits = probes.join(small(seeds), "h").select(
        "at", "doc_id", "ix", shift.alias("shift"),
        F.slice("w", F.greatest(shift, F.lit(0)) + 1, F.col("n") + F.least(shift, F.lit(0))).alias("dw"),
    )
    aligned = hits.groupBy("at", "doc_id", "ix", "shift").agg(F.first("dw").alias("dw"))
    texts = items.select("ix", "item_id", F.col("w").alias("iw"))
    skipped = F.greatest(-F.col("shift"), F.lit(0))
    return aligned.join(small(texts), "ix").select(
        "at", "doc_id", "item_id", "ix", "shift", F.size("iw").alias("n"), skipped.alias("skip"), "dw", F.slice("iw", skipped + 1, F.size("dw")).alias("iw")
    )


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """at, doc_id, item_id, overlap_words, matched_words, doc_start, item_start: the best overlap of each document row and item.

    ``docs`` has a unique row number ``at``; positions count words from 0.
    """
    checked = _alignments(docs, benchmark).select("at", "doc_id", "item_id", "ix", "shift", "n", "skip", _best_segment(F.col("dw"), F.col("iw")).alias("b"))
    item_start = F.col("skip") + F.col("b.start")
    spans = checked.select(
        "at", "doc_id", "item_id", "ix", F.col("b.score").alias("score"), (F.col("b.stop") - F.col("b.start")).alias("overlap_words"),
        F.col("b.matched").alias("matched_words"), (item_start + F.col("shift")).alias("doc_start"), item_start.alias("item_start"), "n",
    ).filter((F.col("score") > 0) & (F.col("overlap_words") >= F.least(F.lit(MIN_WORDS), F.col("n"))))
    fields = ["overlap_words", "matched_words", "doc_start", "item_start"]
    first = F.min(F.struct((-F.col("score")).alias("s"), "doc_start", "item_start", "overlap_words", "matched_words")).alias("b")
    best = spans.groupBy("at", "doc_id", "ix", "item_id").agg(first)
    return best.select("at", "doc_id", "item_id", *[F.col(f"b.{f}").cast("long").alias(f) for f in fields])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id and the overlap of every document row with every benchmark item it holds a part of."""
    rows = columns(docs, "doc_id", "text").withColumn("at", F.monotonically_increasing_id())
    return overlaps(rows, benchmark).drop("at")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that overlap a benchmark item by any segment that is long enough."""
    plain, where, back = numbered(docs)
    rows = cut(plain.withColumn("at", F.monotonically_increasing_id()))
    aligned = _alignments(rows.select("at", F.col(where["doc_id"]).alias("doc_id"), F.col(where["text"]).alias("text")), benchmark)
    found = aligned.filter(_has_overlap(F.col("dw"), F.col("iw"), F.col("n"), F.col("skip")))
    return back(rows.join(found.select("at").distinct(), "at", "left_anti"))

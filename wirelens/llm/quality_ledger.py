"""Rule bitmask ledger: every quality rule runs once and leaves one bit and its measurements.

``ledger`` reads each text once, in the JVM and without a shuffle, and keeps per
document the measurements and one failure bit per rule. Policies are bit masks
over that ledger, so a new version, or the question what one rule alone costs,
needs no second pass over texts: ``apply_policy`` is one bitwise AND per row and
``ablations`` works on the counts of the at most 2^rules distinct bit sets.

Defined results: a NULL or blank text has no words, zero measurements and fails
``few_words``; rows keep their ``doc_id`` as it is, NULL or repeated; an empty
table gives an empty ledger; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.llm.frames import columns, let, words

SYMBOLS = "#*$%&|<>"

#: Rule names by bit number. Bits are never reused; new rules get new bits.
RULES = (
    "few_words",  # fewer than 50 words
    "repeated_words",  # over half of the words stand in repeated 3-word windows
    "symbols",  # more than one symbol in ten words
    "word_length",  # mean word length under 2.5 or over 12 characters
    "duplicate_lines",  # over half of the lines with words repeat an earlier line
    "capitals",  # over 30 % of the text is in capitals
)
BIT = {name: 1 << i for i, name in enumerate(RULES)}

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": BIT["few_words"] | BIT["repeated_words"],
    "v1": sum(BIT.values()),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def _repeat_words(tokens: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the text, the first occurrence included.

    Windows are sorted by hash and position, so equal windows are neighbours
    and the work is n log n for any text.
    """

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            starts,
            zero,
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    def repeated(s: Column) -> Column:
        hit = F.filter(
            s,
            lambda x, k: F.coalesce(F.get(s, k - 1)["g"] == x["g"], F.lit(False))
            | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False)),
        )
        return covered(F.sort_array(F.transform(hit, lambda x: x["i"])))

    def of(w: Column) -> Column:
        def gram(i: Column) -> Column:
            return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

        spots = F.sequence(F.lit(0), F.size(w) - 3)
        windows = F.transform(spots, lambda i: F.struct(gram(i).alias("g"), i.alias("i")))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(F.sort_array(windows), repeated))

    return let(tokens, of)


def _dup_lines(text: Column) -> tuple[Column, Column]:
    """Lines with a word, and how many of them equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit("\x20\x09\x0a\x0b\x0c\x0d")) != "")
    return F.size(lines), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``fail_bits`` of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n_lines, n_dup = _dup_lines(text)
    tokens = columns(docs, "doc_id", "text").withColumn("w", words(F.col("text")))
    measured = tokens.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        n_dup.cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
        n_lines.cast("long").alias("n_lines"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
    )
    n = F.col("n_words")
    failed = {
        "few_words": n < 50,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "word_length": (2 * F.col("word_chars") < 5 * n) | (F.col("word_chars") > 12 * n),
        "duplicate_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        "capitals": 10 * F.col("n_capitals") > 3 * F.col("word_chars"),
    }
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(failed[rule], F.lit(BIT[rule])).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def apply_policy(book: DataFrame, policy: str | int, name: str = "kept") -> DataFrame:
    """The ledger with one more column: whether the policy keeps the document."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return book.withColumn(name, F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) == 0)


def ablations(book: DataFrame, policy: str | int) -> DataFrame:
    """Per rule of a policy: documents that fail it, fail only it, and that the policy without it keeps.

    Rows: rule, failed, failed_only, kept_without, kept. Counted over the
    distinct bit sets, so the shuffle has at most 2^rules rows a task.
    """
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    sets = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("b")).agg(F.count("*").alias("n"))
    used = [r for r in RULES if BIT[r] & mask]
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in used]))
    rows = sets.select("b", "n", rules.alias("r")).select("b", "n", "r.rule", "r.bit")

    def total(keep: Column) -> Column:
        return F.coalesce(F.sum(F.when(keep, F.col("n"))), F.lit(0))

    return rows.groupBy("rule").agg(
        total(F.col("b").bitwiseAND(F.col("bit")) != 0).alias("failed"),
        total(F.col("b") == F.col("bit")).alias("failed_only"),
        total(F.col("b").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("kept_without"),
        total(F.col("b") == 0).alias("kept"),
    )

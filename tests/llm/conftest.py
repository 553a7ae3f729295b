import pytest

#: Rows every operator must take: NULLs, empty, blank, repeated, long, odd characters; extra columns with clashing names.
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta"),
    (2, None),
    (3, ""),
    (4, " \t\n\x0b\x0c\r "),
    (None, "alpha beta gamma delta epsilon zeta eta theta"),
    (6, "alpha beta gamma delta epsilon zeta eta theta"),
    (6, "alpha beta gamma delta epsilon zeta eta theta"),
    (7, LONG),
    (8, "Ünï ﬁ \u00a0x\u0301 日本語 \U0001f600 'll a\x00b <|endoftext|> #*$%&|<>"),
    (9, "one two three"),
]
EXTRA = "doc_id long, text string, TEXT_ string, node long, at long, `a.b` string, score string, w string, bucket int, n_words int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(*r, "x", 5, 6, None, "s", "w", 1, 2) for r in ODD]
    return spark.createDataFrame(rows, EXTRA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.fixture(scope="session")
def sf(tmp_path_factory):
    return "/root/testdata/sf0.001"

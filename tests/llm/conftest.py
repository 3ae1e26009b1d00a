import pytest

LONG = " ".join(f"word{i % 977} of{i % 13} text{i}." for i in range(9_000))
TEXT = (
    "The first line has quite a few words in it.\n"
    "The second line of the text is not any shorter than that.\n"
    "And a third one ends it here, after some more words."
)
ROWS = [
    (1, TEXT), (2, None), (3, ""), (4, TEXT), (4, TEXT), (4, TEXT + "\nOne more."),
    (None, TEXT), (5, LONG), (6, " \t \n\n \r"), (7, "One two."), (None, None),
    (8, "été \U0001f600 naïve x ﬁ İ ́ \x00 \x1c 数据 數據"),
]
# names that an operator may use for itself
EXTRA = ("words", "rank", "task", "n", "key", "row", "score", "label", "fp", "leaf", "_text", "held")


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls, empty and long texts, repeats and clashing columns."""
    rows = [(i, t, None, None, None, *("x",) * len(EXTRA)) for i, t in ROWS]
    extra = ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame(
        rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    )


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def key(row):
    return tuple((v is not None, v) for v in row)

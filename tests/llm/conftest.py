import pytest

ROWS = [
    (0, "The quick brown fox jumps over the lazy dog and runs far away from here.", "en"),
    (1, None, "en"),
    (2, "", None),
    (3, " \t\n ", "fr"),
    (4, "The quick brown fox jumps over the lazy dog and runs far away from here.", "en"),
    (4, "The quick brown fox jumps over the lazy dog and runs far away from here.", "en"),
    (5, "eins zwei drei vier fünf sechs\n" * 3000, "de"),
    (None, "no id here but a token = abcdef123456 in it", "en"),
    (7, "漢字 émigré 😀 #*$%&|<> password: hunter2hunter2", "zh"),
]


@pytest.fixture()
def awkward(spark):
    """Rows with nulls, empty and very long texts, copies, repeated ids, and columns with names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, 2, "x") for r in ROWS], "doc_id long, text string, lang string, rank int, key int, length string")


@pytest.fixture()
def nothing(awkward):
    return awkward.limit(0)

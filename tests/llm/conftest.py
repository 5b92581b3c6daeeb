import pathlib

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not pathlib.Path(DATA).exists():
        pytest.skip("no test data here")
    return DATA


@pytest.fixture(scope="session")
def larger():
    """A larger table, for what is learned from it."""
    if not pathlib.Path("/root/testdata/sf0.01").exists():
        pytest.skip("no test data here")
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def labelled():
    """A table with some hundreds of labelled toxic documents."""
    if not pathlib.Path("/root/testdata/sf0.1").exists():
        pytest.skip("no test data here")
    return "/root/testdata/sf0.1"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that no operator may trip over, with columns of clashing names."""
    long = "word number one two three four five six seven eight nine ten " * 3000
    rows = [
        (1, "plain text with some words in it and a few more of them", "en", "a", 1, "x", 1), (2, None, "en", "a", None, None, None), (3, "", None, None, 0, "", 0), (4, " \t\n ", "en", "b", 4, "y", 2),
        (5, long, "en", "a", len(long), "z", 3), (None, "a row without an id but with text that has words", "en", "a", 1, "x", 4), (6, "same same same", "en", "a", 14, "x", 5), (6, "same same same", "en", "a", 14, "x", 5),
        (7, "same same same", "en", "c", 14, "x", 6), (8, "日本語 ß É \U0001f600 ́", "ja", "a", 9, "x", 7), (9, "!!! ??? 123", "en", "a", 11, "x", 8),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, id int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")

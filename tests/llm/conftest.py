import pytest

#: Null, empty and repeated rows, ties, a long text, a lone word; extra columns whose names clash with inner ones.
WORDS = [f"word{i}" for i in range(300)]


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    a, b = prose(1, 120), prose(2, 90)
    near = " ".join(["changed", *a.split(" ")[1:]])
    rows = [
        (1, a, "en", "s", 5, "k", 0), (2, a, "en", None, 5, "k", 0), (3, near, None, "s", 5, "k", 0), (4, b, "xx", "s", 5, "k", 0), (5, None, "en", "s", None, "k", 0), (6, "", "en", "s", 0, "k", 0),
        (7, "  \n ", "en", "s", 4, "k", 0), (8, "one", "en", "s", 3, "k", 0), (8, "one", "en", "s", 3, "k", 0), (None, b, "en", "s", 1, "k", 0), (None, None, None, None, None, None, None),
        (9, prose(3, 6000), "en", "s", 1, "k", 0), (10, "Größe 漢字 😀 ok " * 40, "de", "s", 1, "k", 0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, uid int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")

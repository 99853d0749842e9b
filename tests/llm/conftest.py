import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def prose():
    """Reproducible made-up text."""
    import random

    def make(words: int, seed: int) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(words))

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Nulls anywhere, empty and long texts, repeated rows and ids, and columns with names that operators use inside."""
    long = prose(30_000, 1)
    base = prose(400, 2)
    rows = [
        (1, base, "en", 1),
        (2, base, "en", 2),  # an exact copy
        (2, base, "en", 2),  # a repeated row
        (3, base[: len(base) // 2] + " changed " + base[len(base) // 2 :], None, 3),  # a near copy
        (4, None, "en", 4),
        (5, "", "en", 5),
        (6, " \n\t ", "en", 6),
        (7, "one two", "en", 7),
        (8, "ONE two", "en", 8),
        (None, base, "en", 9),  # no id
        (9, long, "en", None),
        (10, "x" * 20_000, "en", 10),
        (11, "ab " * 4_000, "en", 11),
        (11, "another text of the same id", "en", 12),
        (12, prose(300, 3) + " " + " ".join(base.split()[:120]) + " " + prose(30, 4), "fr", 13),  # shares a passage
        (13, "é" * 60 + " ü\x1f\x85 ß", "de", 14),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, run int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)

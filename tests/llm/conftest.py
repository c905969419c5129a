import pytest

WORDS = [f"{a}{b}{c}" for a in ("ta", "ri", "mo", "ne") for b in ("lu", "so", "ken") for c in ("", "dal", "in")]


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", ",", ".")) for _ in range(n))


ODD = [None, "", "   \n\t", "one", "Ünïcode – ſ İ <|endoftext|> 漢字\x1c\x85 a b", "a  b\n\n c\t", "x" * 5000, prose(1, 9000), prose(2, 40), prose(2, 40), "The THE the's can't 3.14"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and other columns with clashing names."""
    rows = [(k, t, "score", 7) for k, t in enumerate(ODD)] + [(None, "no id " + prose(3, 20), None, None), (9, ODD[9], "row", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, block int").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, row string, block int")

import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "lambda", "zeta", "Éclair", "naïve"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) + r.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def messy(spark):
    """Null and empty texts, a null id, repeated rows, one very long text, and columns whose names clash."""
    rows = [
        (0, prose(0, 60)),
        (1, prose(0, 60)),
        (2, None),
        (3, ""),
        (4, "  \n\t "),
        (5, "one"),
        (None, prose(7, 40)),
        (6, prose(6, 50)),
        (6, prose(6, 50)),
        (8, prose(8, 60_000)),
        (9, prose(0, 59) + " other"),
        (10, "x" * 30_000),
        (11, "naïve café's <|endoftext|> 12.5 \U0001f600 é́ it's"),
    ]
    names = ["score", "sid", "h", "kept", "n_tokens", "__own", "mark", "item_id", "__doc", "__score", "row", "own", "lines", "found_id", "covered", "root"]
    return spark.createDataFrame([(i, t, "en", *[k for k in range(len(names))]) for i, t in rows], "doc_id long, text string, lang string, " + ", ".join(f"{n} int" for n in names))


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.where("false")

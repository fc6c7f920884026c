"""Small document tables with every odd case: nulls, empty and very long texts, ties, repeated rows, clashing names."""

import random

import pytest

ODD_COLUMNS = ["row", "digest", "doc", "text_key", "score", "key", "anchor"]  # names that operators use inside
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in ODD_COLUMNS) + ", `a b.c` int"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()) + str(rng.randrange(60)) for _ in range(n))


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    shared, other = sentence(rng, 70), sentence(rng, 55)
    long = sentence(rng, 400)
    near = long.split()
    near[200] = "changed"
    out: list[tuple[int | None, str | None]] = [
        (1, long), (2, " ".join(near)), (3, long.replace(" ", " \t\n", 5)), (4, sentence(rng, 30) + " " + shared + "\n" + sentence(rng, 20)), (5, shared), (6, sentence(rng, 10) + " " + shared + " " + other),
        (7, other + " " + other), (8, ""), (9, None), (10, "  \t \n"), (11, "one"), (12, "one"), (13, "One two"), (14, "x" * 50_000 + " é日本 " + sentence(rng, 3000)), (15, "b c"), (15, "b c"), (15, "another text with the same id"),
        (None, long), (None, None), (16, shared + " " + sentence(rng, 5)),
    ]
    return out + [(20 + i, sentence(rng, rng.randrange(1, 120))) for i in range(30)]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), *["odd"] * len(ODD_COLUMNS), 1) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make

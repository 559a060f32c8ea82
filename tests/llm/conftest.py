import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, kept boolean, part int, h string, t string"


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "in", "on", "re", "ñ", "öß", "at"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """id and text: nulls, empties, a very long one, copies, near copies, shared passages, a repeated row, a null id."""
    rng = random.Random(3)
    base = [words(rng, rng.randint(5, 120)) for _ in range(60)]
    passage = words(rng, 30)
    out = list(enumerate(base))
    out += [(100, None), (101, ""), (102, "  \n\t"), (103, words(rng, 30000)), (104, "one two three"), (105, "one two three"), (106, "é" * 60), (107, "a" * 700)]
    out += [(110 + k, base[k]) for k in range(8)] + [(120 + k, base[k].replace(" ", "\n ", 3)) for k in range(8)]
    near = words(rng, 150)
    for k in range(30):
        w = near.split()
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(150)] = words(rng, 1)
        out.append((200 + k, " ".join(w)))
    out += [(300 + k, words(rng, 20) + " " + passage + " " + words(rng, 20)) for k in range(6)]
    out += [(100, None), (110, base[0]), (None, base[1]), (None, None), (400, "x<|endoftext|>y  z "), (401, "Don't  stop\x1cnow ΑΣ.")]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, ["en", "de", None][k % 3], "s", 1, "clash", 2, False, 3, "h", "t") for k, (i, t) in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)

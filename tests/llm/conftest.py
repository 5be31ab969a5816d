import random

import pytest

LONG = "word " * 30_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with awkward names."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [
        (1, base, "en", "a", 10, "x"), (2, base, "en", "a", 10, None), (2, base, "en", "a", 10, None), (3, None, None, None, None, None), (4, "", "en", "b", 0, "y"),
        (5, LONG, "en", None, 1, "z"), (None, "one two", "en", "a", 7, "k"), (6, "é ☃ 漢字 <|endoftext|> ǅ", "fr", "ß", 3, ""), (7, " \t\n ", "en", "b", 4, "t"), (8, base.upper() + ".", "en", "a", 1, "v"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, t string").withColumnRenamed("t", "k")


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def mixed_texts():
    """Texts with near copies, shared passages and repeats."""
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdeéf") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    out = []
    for i in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randrange(3, 160))]
        if i % 6 == 0:
            w[len(w) // 2 : len(w) // 2] = passage.split()
        if i % 4 == 1 and out:
            w = out[rng.randrange(len(out))].split(" ")
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    return out

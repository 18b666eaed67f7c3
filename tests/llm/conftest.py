import random

import pytest

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau ups Phi chi psi Omega été groß".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) rows: exact and near copies, shared passages, nulls, empties, repeated rows, one very long text."""
    rng = random.Random(5)
    texts = [None, "", " ", "one", "one two", "ONE two", "a  b\tc\n\nd   e", None, " nbsp x é É"]
    for _ in range(30):
        texts.append(prose(rng, rng.randrange(1, 120)))
    base = prose(rng, 90)
    texts += [base, base.upper(), base, base + " tail", base.replace(base.split()[40], "edit")]
    passage = prose(rng, 60)
    texts += [prose(rng, 10) + " " + passage + " " + prose(rng, 15) for _ in range(6)]
    texts.append(passage + "\n" + passage + " " + passage[: len(passage) // 2])
    texts.append("loop " * 90)
    texts.append(prose(rng, 6000))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + rows[:3]


@pytest.fixture(scope="session")
def corpus_df(spark, corpus):
    """The corpus with further columns whose names the operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, fp string, chunk int, length string"
    return spark.createDataFrame([(i, t, "en", None, None, 7, "x", 1, "y") for i, t in corpus], schema).repartition(3)


@pytest.fixture(scope="session")
def empty_df(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

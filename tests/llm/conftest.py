import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" if rng.random() < 0.9 else f"X{rng.randrange(10**6)}." for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with edge cases: null, empty, blank, short, repeats, near copies, shared passages, periodic and long ones."""
    rng = random.Random(4)
    base, passage = prose(rng, 120), prose(rng, 90)
    texts = [None, "", " \n\t ", "a", "A b", "a b c", base, base, base.upper(), base.replace("w1 ", "q ", 1)]
    for k in range(12):
        w = base.split()
        w[rng.randrange(len(w))] = f"edit{k}"
        texts.append(" ".join(w))
    texts += [f"{prose(rng, 40)} {passage} {prose(rng, 40 + k)}" for k in range(5)]
    texts += ["be " * 400, "x" * 1500, "Ünï " * 3 + prose(rng, 30), prose(rng, 6000), *(prose(rng, rng.randrange(5, 60)) for _ in range(25))]
    for n in (8, 12, 15, 19, 21, 33):
        w = prose(rng, n, 10**6).split()
        texts += [" ".join(w), " ".join([*w[:-1], "other"]), " ".join(w[1:]), " ".join([*w, "more"])]
    return texts


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """With columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s", len(t or ""), 1, "x") for i, t in enumerate(corpus)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, keys string").repartition(3)

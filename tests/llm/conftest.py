import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega été über naïve of the and in to a".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(30)) if rng.random() < 0.7 else "") for _ in range(n))


def documents(seed=7):
    """(doc_id, text): prose, exact and near copies, shared passages, and every odd case."""
    rng = random.Random(seed)
    shared = prose(rng, 60)
    rows = [prose(rng, rng.choice([3, 15, 30, 60, 120, 300])) for _ in range(50)]
    base = prose(rng, 150)
    for _ in range(30):  # a large group of near copies
        words = base.split()
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append(" ".join(words))
    rows += [base] * 25  # and of copies
    for _ in range(12):  # a passage within other text
        rows.append(prose(rng, 25) + "\n" + shared + "\t" + prose(rng, rng.randrange(0, 30)))
    rows += [shared.upper(), "", "   \n\t ", "one", "one", "ONE", "one two three", "a b c d", "x " * 100, "y z " * 40, prose(rng, 3000)]
    rows += [prose(rng, 19), prose(rng, 20)] * 2
    out = [(i * 3 % 997, t) for i, t in enumerate(rows)]
    return [*out, (5000, None), (5001, None), (None, "no id but text"), (None, None)]


@pytest.fixture(scope="session")
def docs():
    return documents()


@pytest.fixture
def frame(spark):
    """A DataFrame of (doc_id, text) with columns whose names an operator might use itself."""

    def make(rows):
        full = [(i, t, "en" if (i or 0) % 2 else None, "s", len(t or ""), 1, 2, 3.0, "q", "w") for i, t in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, _n int, _x int, kept double, _row string, _key string"
        return spark.createDataFrame(full, schema).repartition(3)

    return make


def split(text, lower=False):
    raw = (text or "").encode()
    if lower:
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    return raw.split()


class Groups:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def of(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.of(a), self.of(b)
        self.up[max(a, b)] = min(a, b)

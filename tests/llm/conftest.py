import random

import pytest

from siteloom.session import ship_package


@pytest.fixture(autouse=True, scope="session")
def package(spark):
    ship_package(spark)


@pytest.fixture
def texts():
    """Texts with all the odd cases: null, empty, blank, short, long, copies, near copies, marks."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["Été", "naïve", "ß", "日本", "it's", "don't", "3.5", "a|b"]

    def text(n):
        return " ".join(rng.choice(words) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))

    out = [None, "", " \n\t ", "one", "one two three", "ONE two Three", "a b c d", "\x1c odd\x85space"]
    for n in (8, 30, 60, 200, 700):
        base = text(n)
        out += [base, base, base.upper()]
        for k in (1, 1, 2, 3, 6, 12):
            own = base.split(" ")
            for _ in range(k):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(" ".join(own))
    out.append(text(9000))
    out.append("same line here\n" * 300)
    return out

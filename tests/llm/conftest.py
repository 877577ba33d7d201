import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, label string, key long"


def words(rng, n):
    return " ".join(rng.choice(("the", "of", "and", "then", "une", "der", "thing", "eran", "onst", "ble", "ha", "Wh")) + rng.choice(("", "ed", "ing", ".", "ö")) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Near copies, exact copies, a shared passage, short, empty, null and very long texts."""
    rng = random.Random(11)
    base = [words(rng, rng.randrange(1, 120)) for _ in range(25)]
    passage = words(rng, 70)
    out = base + base[:6]
    for b in base[6:14]:
        w = b.split(" ")
        w[len(w) // 2] = "CHANGED"
        out.append(" ".join(w))
    hub = words(rng, 60)
    for i in range(12):  # a chain: each copy differs from the next in one more place
        w = hub.split(" ")
        for j in range(0, i, 2):
            w[5 * j % 60] = f"edit{j}"
        out.append(" ".join(w))
    out += [words(rng, 20) + "\n" + passage + "\n" + words(rng, 15) for _ in range(5)]
    out += ["", None, "   \n", "one", "One two", "one  two", "x" * 700, "ab" * 400, "étéé 漢字 \U0001f600 " * 40, words(rng, 6000)]
    return dict(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, "s", 1, -5, "z", 9) for i, t in texts.items()], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

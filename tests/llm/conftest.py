import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, run string, digest string, node string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra
    columns whose names clash with the operators' own."""
    rng = random.Random(5)
    base = [words(rng, 60) for _ in range(6)]
    shared = words(rng, 25)
    texts = [
        None, "", " \t\n ", "one", "one", base[0], base[0], base[0].replace(" ", "\n"), base[1] + " tail", base[1] + " other", shared + " a b c", "x y " + shared, shared + " " + shared,
        "l1\nl2\nl3\nl4", "z\nl1\nl2\nl3\nend", "l1\nl2\nl3", "\n\n\n\n", words(rng, 30_000), "same " * 3000, "é ü 日本語 \x1c x y", base[2], base[2].upper(),
    ]
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, len(t or ""), "r", "d", "n") for i, t in enumerate(texts)]
    rows += [(None, base[3], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    rows += [rows[5], rows[5], rows[11], (3, "another text under a known number", "en", "s1", 5, "r", "d", "n")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some_docs(spark):
    """A few hundred documents with exact and near copies and shared passages."""
    rng = random.Random(7)
    texts = [words(rng, rng.choice([3, 8, 40, 120, 300]), 3000) for _ in range(120)]
    for i in range(0, 60, 3):
        near = texts[i].split(" ")
        for j in range(1, len(near), 40):
            near[j] = f"changed{i}x{j}"
        texts.append(" ".join(near))
    texts += texts[:15]
    passage = words(rng, 55, 3000)
    for i in range(20, 40):
        texts[i] = f"{texts[i]} {passage}" if i % 2 else f"{passage}\n{texts[i]}"
    lines = [words(rng, 4, 50) for _ in range(40)]
    texts += ["\n".join(rng.choice(lines) if rng.random() < 0.5 else lines[(k + i) % 40] for k in range(12)) for i in range(40)]
    rows = [(i, t, "en", f"s{i % 7}", len(t), "r", "d", "n") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)

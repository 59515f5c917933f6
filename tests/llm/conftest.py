import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n: int = 60, seed: int = 1):
    """Invented texts with exact and near copies, repeated lines, a shared passage, nulls, empty and long ones."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, line = say(70), say(9)
    texts = []
    for i in range(n):
        kind = i % 10
        if kind == 3 and texts:
            texts.append(texts[rng.randrange(len(texts))])
        elif kind == 4 and texts:
            ws = (texts[rng.randrange(len(texts))] or "x y").split(" ")
            for _ in range(max(1, len(ws) // 40)):
                ws[rng.randrange(len(ws))] = say(1)
            texts.append(" ".join(ws))
        elif kind == 5:
            texts.append(f"{say(30)}\n{passage}\n{say(12)}")
        elif kind == 6:
            texts.append(f"{line}\n{say(20)}\n{line}")
        elif kind == 7:
            texts.append([None, "", "   \n", "One", "Two  words", "123 456 !!"][i // 10 % 6])
        else:
            texts.append("\n".join(say(rng.randint(3, 60)) for _ in range(rng.randint(1, 4))))
    texts.append(say(4000))
    out = [(i * 3 % (2 * n + 7), t, rng.choice(["en", "de", "fr", None]), f"s{rng.randrange(3)}", len(t or "")) for i, t in enumerate(texts)]
    assert len({r[0] for r in out}) == len(out)
    return out


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names clash with those the operators use inside."""
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 AS h", "2 AS d", "'x' AS r", "3 AS n", "4 AS rid", "5 AS component_id", "6 AS line").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)

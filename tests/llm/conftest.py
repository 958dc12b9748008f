import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row long, size long, kept string, part int"


def corpus(seed=3):
    """Rows (doc_id, text): prose, exact and near copies, a shared passage, nulls, ties, one very long text."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abdeghilmnorstu") for _ in range(r.randint(2, 8))) for _ in range(400)]

    def prose(n):
        return " ".join(r.choice(vocabulary).capitalize() + ("." if r.random() < 0.15 else "") for _ in range(n))

    texts = [prose(r.randint(1, 220)) for _ in range(40)]
    passage = prose(120)
    texts += [prose(40) + " " + passage + "\n" + prose(30) for _ in range(6)]
    for base in (prose(150), prose(90)):
        for _ in range(8):
            words = base.split()
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            texts.append(" ".join(words))
    texts += [texts[0]] * 3 + ["", " \n\t ", "one", "a b c", "a b c", "é" * 700, "été " * 300, "ab" * 1000]
    texts.append(prose(6000) + " " + passage)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows += [(500, None), (501, None), (None, texts[1]), (None, None), rows[5], rows[5], (502, "日本 " + texts[2] + " <|endoftext|> it's")]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with extra columns whose names clash with the operators' own."""
    full = [(d, t, None if (d or 0) % 7 == 0 else "en", None if (d or 0) % 5 == 0 else f"s{(d or 0) % 3}", None, "x", 9, 9, "x", 9)
            for d, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df, *columns):
    """Rows as a sorted list of tuples (None first)."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda t: tuple((x is not None, x) for x in t))


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda t: tuple((x is not None, x) for x in t))

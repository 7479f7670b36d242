import re

import pytest

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, size string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def words(x):
    return WORD.findall(x or "")


def _rows():
    import random
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdeéñü") for _ in range(r.randint(1, 7))) for _ in range(400)]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 150))) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1] + " tail", "Ä " + texts[2].upper(), texts[3] + "\n" + texts[3]]
    texts += ["", " \t\n\v\f\r ", "one", "one two", "é" * 300, "a" * 450, "x y " * 200, "\n\nline one\nline one\n  \nline one",
              " ".join(r.choice(vocab) for _ in range(30_000)), "a  b\u00a0c \u2028 🙂 d#*$", "l\x00o\x00w"]
    out = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "ünï", None][i % 4], len(t), 0.5, "x") for i, t in enumerate(texts)]
    out += [out[4], out[4], out[7]]  # repeated rows
    out += [(None, texts[5], None, None, None, None, None), (None, None, None, "s1", 0, 0.1, "y"), (900, None, "en", "s2", None, 1.0, None)]
    return out


@pytest.fixture(scope="session")
def rows():
    return _rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Nulls everywhere, empty and very long texts, ties and repeated rows, extra columns with clashing names."""
    return spark.createDataFrame(rows, DDL).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(45)] + [(None, 1, 1), (3, None, None), (7, 0, 1)],
                                 "doc_id bigint, quality int, toxic int")

"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, extra columns."""

import random

import pytest

DOCS = "doc_id long, text string, source string, lang string, n_chars long, size long, score double, kept boolean"


def sentence(rng, n):
    words = ["".join(rng.choice(["the", "an", "er", "on", "ti", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(8)
    out = ["\n".join(sentence(rng, rng.randint(6, 30)) for _ in range(rng.randint(1, 5))) for _ in range(40)]
    words = out[0].split(" ")
    out += [out[0], out[0], " ".join(words[:-1] + ["changed."]), out[1].upper(), out[1]]  # exact and near copies
    out += [None, "", " \n\t ", "one", "a b c d", "A B C D", "x" * 5000, " ".join(sentence(rng, 400) for _ in range(10))]
    out += ["### buy%%% now*** cheap$$$ deals### here&&& again%%% today*** only$$$ click###", "a | b | c | d | e\nhome | about | contact", "word " * 60]
    out += ["sigma ΟΔΟΣ İstanbul é e\u0301 naïve 日本語 <|endoftext|> don't 42!?"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ["s1", "s2", None][i % 3] if i % 5 else "hot", "en", None, 7, 0.5, None) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id here but a few words to count in it", "s1", None, None, None, None, None), (5, "another text under an id that exists already", "s2", None, 0, 0, 0.0, True)]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark, texts):
    rows = [(i, int(not ("%%%" in (t or "") or "|" in (t or ""))), int("idiot" in (t or ""))) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, 1, 0), (9999, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")

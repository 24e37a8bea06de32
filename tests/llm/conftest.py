import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """Writes rows as a table and reads it."""

    def make(rows, schema=SCHEMA, name="documents"):
        path = str(tmp_path_factory.mktemp("sf") / f"{name}.parquet")
        spark.createDataFrame(rows, schema).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Writes several tables into a folder, for whole queries."""

    def make(**tables):
        path = tmp_path_factory.mktemp("sf")
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return make


#: Texts that every operator must take.
ODD = [None, "", " \t\n\r\x0b\x0c ", "word", "ein Wort\nund\n\nnoch eins", "ÄÖÜ ñandú 🎉 \x00 \u00a0 x", "a" * 5000, "the cat sat on the mat " * 900, "same text twice here now", "same text twice here now"]


@pytest.fixture(scope="session")
def odd(table):
    """Null identifiers and columns, repeated rows, empty and long texts, and columns with names that operators use."""
    rows = [(i if i else None, t, None if i % 3 else "en", None if i % 2 else "s", None, i, float(i), "x") for i, t in enumerate(ODD)]
    rows.append(rows[5])
    return table(rows, SCHEMA + ", node long, score double, label string")


def prose(seed, n, words=400):
    rng = random.Random(seed)
    stock = ["".join(rng.choice(["th", "er", "ing", "on", "at", "re", "nd", "st"]) for _ in range(rng.randrange(1, 4))) for _ in range(words)]
    return " ".join(rng.choice(stock) for _ in range(n))

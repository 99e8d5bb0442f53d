import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the of and to in is that it for on with was as by this from ation ering onthe thing ounded hereat".split(),
    "fr": "le de la et que les des une dans est pour aux éleve çaion eaux oiré mentre élère ouchait vienne".split(),
}


def sentence(rng, lang="en", n=60):
    words = [rng.choice(WORDS[lang]) + rng.choice(["", "", "a", "er", "ol", "st", "ti"]) for _ in range(n)]
    return " ".join(words)


@pytest.fixture(scope="session")
def rows():
    """Plain documents, then the awkward ones: nulls in each column, empty, blank, tiny and very long texts, repeated rows, repeated ids."""
    rng = random.Random(5)
    out = []
    for i in range(120):
        lang = "fr" if i % 4 == 0 else "en"
        text = "\n".join(sentence(rng, lang, 20) for _ in range(4))
        out.append((i, text, lang, f"s{i % 12}", len(text)))
    long = "\n".join(sentence(rng, "en", 200) for _ in range(300))
    out += [
        (200, None, "en", "s1", None),
        (201, "", "en", "s1", 0),
        (202, " \n\t\r\n", None, "s2", 5),
        (203, "one", "en", None, 3),
        (204, "two words", "fr", "s3", 9),
        (205, long, "en", "s0", len(long)),
        (None, "a text without an id but with some words in it " * 3, "en", "s4", 141),
        (None, None, None, None, None),
        (206, "12 34 !? 56", "en", "s5", 11),
    ]
    out += [out[3], out[3], (5, out[6][1], "en", "s6", 7)]  # repeated rows; an id with two texts
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    made = [(r[0], 0 if r[2] == "fr" else 1, 1 if r[0] is not None and r[0] % 7 == 0 else 0) for r in rows if r[0] is not None and r[0] < 100]
    made += [(None, 1, 1), (3, None, None), (3, 1, 0), (9999, 1, 1)]
    return spark.createDataFrame(made, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def clashing(docs):
    """Further columns, named like what the operators add or use on the way."""
    from pyspark.sql import functions as F

    names = ["_k1", "_k2", "_row", "n_removed", "score", "copy", "rate", "n_copies", "shuffle_key", "class_id", "n_links", "_pos", "_h1", "kept", "llr", "item_id", "label", "_source", "cdf"]
    return docs.select("*", *[F.lit(f"mine {n}").alias(n) for n in names])

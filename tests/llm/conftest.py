import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, stems=("the", "of", "and", "to", "in", "on", "re", "er", "an", "ti", "ou", "ea", "nd", "st")):
    return " ".join("".join(rng.choices(stems, k=rng.randint(1, 4))) for _ in range(n))


def documents():
    """A corpus with equal and similar texts, repeated passages and lines, and every odd row."""
    rng = random.Random(5)
    rows, passage = [], words(rng, 60)
    for k in range(40):
        body = words(rng, rng.randint(30, 160))
        if k % 5 == 0:
            body += "\n" + passage
        if k % 3 == 0:
            body = "Home | About | Contact\n" + body
        rows.append((k, body, ("en", "de")[k % 2], f"src{k % 4}"))
    base = words(rng, 220).split()
    for k in range(40, 52):
        own = list(base)
        for _ in range(rng.randint(0, 12)):
            own[rng.randrange(len(own))] = words(rng, 1)
        rows.append((k, " ".join(own), "en", "src0"))
    rows += [(60, rows[3][1], "en", "src1"), (61, rows[3][1], "en", None), (62, rows[3][1], "de", "src2")]
    rows += [(70, None, "en", "src1"), (71, "", "en", "src1"), (72, " \t\n ", None, None), (73, "word", "en", "src3"), (74, "12 34 !!", "en", "src3")]
    rows += [(80, words(rng, 6_000), "en", "src0"), (81, "x" * 3_000, None, "src0")]
    rows += [(90, rows[7][1], "en", "src1"), (90, rows[7][1], "en", "src1"), (None, words(rng, 80), "en", "src1"), (91, None, None, None), (91, None, None, None)]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


#: Columns that operators use inside; a table may bring them along.
CLASHING = ("size", "target", "taken", "score", "lang_pred", "node", "rep", "key", "keys", "row", "n", "_text", "_doc", "_node", "_rep", "th", "runs", "a", "g", "stratum", "words", "place", "rk", "bucket", "nth", "times", "item_id", "quality", "good", "u", "v")


@pytest.fixture(scope="session")
def crowded(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("extra").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)


def same(df, expected_rows, *columns):
    """Rows of a DataFrame, as a multiset, equal those expected."""
    key = lambda r: tuple((x is not None, x) if not isinstance(x, float) else (True, round(x, 9)) for x in r)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    assert got == sorted(map(tuple, expected_rows), key=key)

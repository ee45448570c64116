import pytest

#: Column names that operators use inside; a table may have them already.
CLASHING = ["_doc", "fp", "text_key", "size", "_id", "words", "n", "row", "draw", "_tail", "part", "label"]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = [f"w{chr(97 + i % 26)}{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    x, out = seed * 7919 + 13, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)])
    return " ".join(out)


def odd_rows() -> list[tuple]:
    """Nulls, empty and long texts, ties and repeated rows."""
    base = prose(1, 120)
    return [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, None, "en", "a", None),
        (4, "", None, "b", 0),
        (5, " \n\t", "de", None, 0),
        (None, base, None, None, None),
        (None, None, None, None, None),
        (6, "É_È Ünïcode ²½ 日本語\x1c x y don't  stop\n\nnow ", "fr", "b", 9),
        (7, "x" * 300_000, "en", "b", 9),
        (8, prose(8, 30_000), "en", "c", 9),
        (9, base + " tail", "en", "c", 9),
        (10, prose(10, 3), "en", "é", 9),
        (11, "the end\U0001f600 <|endoftext|> of it\r\n", "en", "\U0001f600", 9),
        (-12, prose(12, 60), "en", "z", 9),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCUMENTS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


def clashing(df):
    """The same table with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    for c in CLASHING:
        df = df.withColumn(c, F.lit("own"))
    return df


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)

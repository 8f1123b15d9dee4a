"""A table of odd documents that every text operator has to take."""


LONG = "word " * 30_000 + "end"

ROWS = [
    (1, "The cat sat on the mat and looked at the moon, you see.", "en", 55),
    (1, "The cat sat on the mat and looked at the moon, you see.", "en", 55),  # repeated row
    (2, None, None, None),
    (3, "", "en", 0),
    (4, " \t\n ", "fr", 3),
    (None, "a row without a key", "en", 19),
    (5, LONG, None, len(LONG)),
    (6, "x" * 5_000, "de", 5_000),
    (7, "naïve café 日本 😀 <|endoftext|> ▁ \x00 ² end", "xx", 30),
    (8, "The cat sat on the mat and looked at the moon, you see.", "en", 55),  # copy under another key
]


def odd_documents(spark):
    """Extra columns take names that operators use inside."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, n_chars long")
    for name in ("score", "node", "n", "items", "word", "y", "part", "key", "at", "c"):
        df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df


def no_documents(spark):
    return odd_documents(spark).where("false")


def texts():
    return [(k, t or "") for k, t, *_ in ROWS]


def same(rows, expected):
    """Equal as bags of rows."""
    order = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r) for r in rows), key=order) == sorted(expected, key=order)


__all__ = ["LONG", "ROWS", "no_documents", "odd_documents", "same", "texts"]

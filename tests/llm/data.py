"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, extra columns."""

LONG = "The quick brown fox jumps over the lazy dog while seven wizards mix odd jars of quartz near a humming river bank. " * 3
ROWS = [
    (1, LONG + "First tail of some words here.", "en", "a", 10),
    (2, LONG + "First tail of some words here.", "en", "a", 10),
    (3, LONG + "Another  ending\taltogether with new words.", "en", "b", None),
    (4, None, None, None, None),
    (5, "", "de", "a", 0),
    (6, "   ", "de", "b", 3),
    (7, "x", "fr", None, 1),
    (7, "x", "fr", None, 1),
    (None, "a null id with a text of its own", "en", "c", 32),
    (9, "word " * 20000, "es", "a", 100000),
    (10, "Ünïcödé çà et là " * 30, "fr", "b", 500),
    (11, "First tail  of some words here.", "en", "b", 20),
    (12, "First tail of\nsome words here.", "en", "b", 20),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    """With a column whose name clashes with an inner one, and one more."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.selectExpr("*", "1 AS kept", "doc_id AS row", "'e' AS `a.b`")


def empty(spark):
    return documents(spark).limit(0)

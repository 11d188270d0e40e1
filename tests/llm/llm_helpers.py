"""Small tables with the awkward cases every operator has to take."""

import duckdb

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, Kept string, id string, key int"
LONG = "lorem ipsum dolor sit amet consectetur " * 6000


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, clashing names."""
    line = "this very line is in many of the documents"
    rows = [
        (1, f"first words here\n{line}\nlast words here", "en", "a"),
        (2, f"other words there\n  {line.upper()} \n", "en", "a"),
        (3, f"{line}\n{line}", "en", None),
        (3, f"{line}\n{line}", "en", None),
        (4, None, None, "b"),
        (5, "", "de", "b"),
        (6, " \t\n \x0b\x0c\r ", "de", ""),
        (7, LONG, "la", "c"),
        (8, LONG, "la", "c"),
        (9, "é" * 25 + "\nÀ À À", "fr", "a"),
        (None, "a row without an id", None, None),
        (None, None, None, None),
        (10, "x", "en", "a"),
        (11, "same id, one text", "en", "a"),
        (11, "same id, another text", "en", "a"),
    ]
    return spark.createDataFrame([(*r, 1, "w", "k", "i", 0) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(folder):
    return duckdb.sql(f"SELECT * FROM '{folder}/documents.parquet'").df().to_dict("records")

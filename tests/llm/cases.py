"""Small tables that every operator is held against."""

#: Extra columns with names that operators use inside.
EXTRA = "n_words int, size string, component_id long, digest string, `Text2` string"


def docs(spark, rows, source=True):
    """rows: (doc_id, text[, source]) → documents with clashing extra columns."""
    data = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), 1, "x", 5, "d", "t") for r in rows]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)


HARD = [(1, None), (2, ""), (3, " \n\t"), (None, "a row without an id"), (4, "word " * 5000), (4, "word " * 5000), (5, "é日本語 ÀÉ\x00 mixed \x1f case"), (6, "x" * 50_000)]

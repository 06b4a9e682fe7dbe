"""Small tables that hold every kind of row the operators must stand."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, key string, retained string, n_words int"
LONG = "alpha beta gamma delta " * 5000


def documents(spark, more=()):
    """Nulls in every column, empty and very long texts, ties and repeated rows, columns whose names the operators use inside."""
    texts = [
        (1, "The quick brown fox jumps over the lazy dog and runs away from the farm"),
        (2, "The quick brown fox jumps over the lazy dog and runs away from the farm"),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (6, LONG),
        (7, "Ünïcode Straße ﬁ É 漢字 𝒳 \u0000 ok"),
        (8, "one"),
        (8, "one"),
        (None, "no id here"),
        (9, "12345 67890 !!! ..."),
        (10, 'Released under the MIT License. password = "hunter2secret"'),
        *more,
    ]
    return spark.createDataFrame([(i, t, None if i == 1 else "en", "s", None if t is None else len(t), 7, "k", "r", 1) for i, t in texts], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)

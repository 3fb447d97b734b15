"""Small tables with the odd cases that every operator must stand."""

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows, extra=False):
    """rows: (doc_id, text[, lang[, source]]). ``extra`` adds columns with the names of results."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCUMENTS)
    if extra:
        from pyspark.sql import functions as F

        for name in ("id", "body", "size", "score", "held_out", "row", "band", "component", "n_words", "n_tokens", "target", "shard", "prefix", "value", "node", "items", "spans", "copies", "range", "part"):
            df = df.withColumn(name, F.lit("x"))
    return df


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id here at all"), (5, "A b C d E f g"), (6, "a B c D e F g"), (7, "word " * 20_000), (8, "é ß 日本 😀  x"), (9, "!!! ??? ...")]

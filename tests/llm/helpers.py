DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """documents from (doc_id, text[, lang[, source]]) tuples."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows], DOCS)

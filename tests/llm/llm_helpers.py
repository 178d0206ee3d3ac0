"""What the tests of this folder share."""

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    """A document table from (doc_id, text) or (doc_id, text, source) rows, with columns whose names operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, "x", 1, b"k") for r in rows]
    return spark.createDataFrame(full, DOCS + ", key string, size long, fp binary")

"""Small tables that hold the awkward cases: nulls, empty and long texts, ties, repeats, clashing columns."""

SF = "/root/testdata/sf0.001"


def awkward(spark, texts, extra=True):
    """doc_id 0.. with the texts, and columns whose names clash with what operators use inside."""
    rows = [(i, t, "en", "src", len(t or ""), -1, "x", True) for i, t in enumerate(texts)]
    cols = "doc_id long, text string, lang string, source string, n_chars long, n long, hash string, kept boolean"
    df = spark.createDataFrame(rows, cols)
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

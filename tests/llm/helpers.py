"""Small document tables with the awkward cases that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, seed long, h long, w string"


def documents(spark, texts, ids=None):
    """Rows with extra columns whose names clash with the operators' own."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, None, "s", None if t is None else len(t), 1, 2, "w") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion of quiet thunder tonight"
AWKWARD = [None, "", " \t\n", "a", "Ünïcödé ß 漢字 👩", PASSAGE, PASSAGE, "x " * 3000, PASSAGE + " and more words follow here to the end"]

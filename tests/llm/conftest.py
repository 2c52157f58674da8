import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """DataFrame of documents from texts or ``(doc_id, text[, lang, source])`` rows, with extra
    columns whose names clash with those of operators."""
    def make(rows, parts=3):
        full = []
        for i, r in enumerate(rows):
            r = (i, r) if r is None or isinstance(r, str) else tuple(r)
            r += (None, None)[:4 - len(r)] if len(r) < 4 else ()
            full.append((*r[:4], None if r[1] is None else len(r[1])))
        df = spark.createDataFrame(full, DOCS)
        if parts:
            df = df.repartition(parts)
        for name in ("key", "size", "fp", "text_hash", "spans", "kept", "node", "label", "row", "hash", "quality",
                     "score", "copies", "target", "component", "cluster", "rank", "start", "end", "n"):
            df = df.selectExpr("*", f"'clash' AS `{name}`")
        return df
    return make


#: Texts that every operator must survive: null, empty, blank, one character, repeats, long runs.
ODD = [None, "", " \n\t ", "x", "x", "日本語 テキスト 😀", "\\### Assistant: </turn> ok", "a" * 50_000,
       " ".join(["w"] * 3000), "\x00\x1c\x85  ", "1" * 40_000, "@" * 3000]

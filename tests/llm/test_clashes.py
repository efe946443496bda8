"""Extra columns that bear the names the operators use inside keep their values."""

from material import work  # noqa: F401

from groundtrace.llm import exact_dedup, mixing, near_dedup

NAMES = ("_gone", "_stays", "_dedup_row", "_MIX_ROW", "_taken_row", "_cut", "_cut_", "row", "id", "ids", "language")


def test_clashing_columns(spark, work):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` long" for n in NAMES)
    extra = tuple(range(100, 100 + len(NAMES)))
    rows = [(i, text, "en", source, len(text or ""), *extra) for i, text, source in (
        (1, "one two three four five six", "a"), (2, "one two three four five six", "a"), (3, "seven eight nine", "b"),
        (4, None, None), (1, "ten eleven", "b"))]
    docs = spark.createDataFrame(rows, schema)
    index = exact_dedup.DigestIndex(spark, f"{work.folder}/index", 2)
    exact = exact_dedup.keep_documents(docs, index, work)
    near = near_dedup.keep_documents(docs, work)
    mixed = mixing.mixed_documents(docs, work)
    for got, ids in ((exact, [1, 1, 3, 4]), (near, [1, 1, 3, 4])):
        assert sorted(r.doc_id for r in got.collect()) == ids
    assert {r.doc_id for r in mixed.collect()} == {1, 2, 3}
    for got in (exact, near, mixed):
        assert got.columns == docs.columns
        assert all(tuple(r)[5:] == extra for r in got.collect())

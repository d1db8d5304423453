import pytest

from spanforge.llm import registry
from tests.llm.conftest import SF


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, agree, name):
    assert agree(registry.queries()[name](spark, SF), registry.oracle_sql()[name]) > 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string"
ODD = [
    (0, None, None, None, 0, "x", "y"), (20, "", "en", "a", 0, "x", "y"), (40, " \n\t ", "en", "b", 0, "x", "y"), (None, "one two three four", "en", "a", 0, "x", "y"),
    (3, "one two three four", None, "a", 0, "x", "y"), (3, "one two three four", None, "a", 0, "x", "y"), (4, "ONE two three Four", "fr", None, 0, "x", "y"),
    (5, "é" * 50, "fr", "é", 0, "x", "y"), (6, "word " * 30_000, "fr", "\U0001F600", 0, "x", "y"), (7, "x", "de", "b", 0, None, None), (8, "12 34 !!", "de", "b", 0, None, None),
]


@pytest.mark.parametrize("name", ["op7_mixing", "op8_sharding", "op10_decontam", "op2_quality", "op4_recount", "op6_jaccard", "op9_langid"])
@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_documents(spark, write, agree, name, rows):
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 0), (3, 0, 0), (4, None, 0), (5, 1, 1), (None, 1, 0)] if rows else [], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "two three"), (1, "Three four"), (2, None), (None, "word word"), (3, ""), (4, "é" * 50)] if rows else [], "item_id long, text string")
    folder = write(documents=docs, labels=labels, benchmark=bench)
    df = registry.queries()[name](spark, folder)
    if name in registry.oracle_sql() and name != "op6_jaccard":  # equal doc_ids stand for several rows there
        assert agree(df, registry.oracle_sql()[name], folder) == len(rows)
    else:
        assert df.count() == len(rows)


def test_odd_vectors(spark, write, agree):
    rows = [(20, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [-0.5, 0.25]), (7, [-0.5, 0.25])]
    folder = write(embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert agree(registry.queries()["op3_topk"](spark, folder), registry.oracle_sql()["op3_topk"], folder) == 8
    folder = write(embeddings=spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert registry.queries()["op3_topk"](spark, folder).count() == 0


def test_odd_pages(spark, write, agree):
    rows = [(1, "http://a\r\nX: y", "same"), (2, None, "same"), (0, "u", None), (5, "u", ""), (7, "ü", "é\r\n\r\nWARC/1.1\r\n"), (None, "u", "same"), (None, "u", "lone"), (9, "u", "x" * 300_000)]
    folder = write(pages=spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert agree(registry.queries()["op1_warc"](spark, folder), registry.oracle_sql()["op1_warc"], folder) == len(rows)

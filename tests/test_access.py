from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import pages
from spanforge.sources import reports


def test_ids_and_texts_by_their_other_keys(spark):
    rows = spark.createDataFrame([("a", "x", "t", "u"), (None, "x", None, "u"), (None, None, None, None)], "report_id string, id string, text string, report_text string")
    assert sorted((r["report_id"], r["text"]) for r in reports.accessible(rows).collect()) == [("a", "t"), ("unknown", ""), ("x", "u")]
    bare = reports.accessible(spark.createDataFrame([(7,)], "id int")).head()
    assert (bare["report_id"], bare["text"]) == ("7", "")


def test_an_edit_revokes_the_approval(spark):
    before = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", None)], "document_id string, text string")
    marks = before.select("document_id", T.digest(F.col("text")).alias("approved_digest"))
    after = spark.createDataFrame([("a", "one"), ("b", "two."), ("c", None), ("d", "one")], "document_id string, text string")
    got = pages.approved(after, marks.unionByName(marks))
    assert got.columns == ["document_id", "text", "approved"]
    assert {r["document_id"]: r["approved"] for r in got.collect()} == {"a": True, "b": False, "c": False, "d": False}

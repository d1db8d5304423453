from spanforge.functions import patterns as P
from spanforge.operators import review


def test_variables_without_reviews_have_a_row(spark):
    log = spark.createDataFrame([("tumor_size", "corrected"), ("tumor_size", "accepted")], "variable_name string, action string")
    rows = review.corrections(log, spark.createDataFrame([(v,) for v in P.VARIABLES], "variable_name string")).collect()
    got = {r["variable_name"]: (r["corrected"], r["reviewed"], r["rate"]) for r in rows}
    assert got["tumor_size"] == (1, 2, 0.5) and got["histologic_diagnosis"] == (0, 0, None) and len(got) == 4

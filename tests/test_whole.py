"""Jobs that read every report once, and all of them."""

from pyspark.sql import functions as F

from spanforge.functions import patterns as P
from spanforge.operators import model, pipeline, review
from spanforge.plans import registry
from tests.sqlcheck import SF


def _tables(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


def _reads(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_the_reviewed_export_works_fields_out_once(spark):
    """The same rows as a join of fields, results, sessions and residual priorities, from one read of the reports."""
    texts = registry.texts(spark, _tables(spark)).limit(60).cache()
    fields, found = pipeline.fields(texts), pipeline.results(texts)
    session = {
        "reviewer_identity_verified": F.lit(True), "review_started_at": F.when(F.length("report_id") > 2, "2024-04-30T23:58:30Z"),
        "returned_for_clarification": F.col("report_id").endswith("3"), "overall_note": F.when(F.col("report_id").endswith("13"), "ask").otherwise(""),
    }
    drafted = registry._decided(fields)
    joined = review.snapshot(review.reviewed(review.sound(drafted), "2024-05-01T00:00:00Z", "A"), found, found.select("report_id", "method", *[c.alias(n) for n, c in session.items()]), "2024-04-30T00:00:00Z")
    once = review.snapshot_of_drafts(drafted, session, "2024-05-01T00:00:00Z", "A", "2024-04-30T00:00:00Z")
    rows = lambda df: sorted(repr(r) for r in df.select(sorted(joined.columns)).collect())
    assert sorted(once.columns) == sorted(joined.columns) and rows(once) == rows(joined) and len(rows(once)) > 100
    assert _reads(registry.queries()["reviewed_export"](spark, SF)) == 1


def test_values_of_methods_need_no_models(spark, monkeypatch):
    """Agreement is over values and statuses, which the classifiers never touch: none is fitted, and all three methods are there."""
    def fitted(*_):
        raise AssertionError("a model was asked for")

    monkeypatch.setattr(registry, "models", fitted)
    assert {r["fields"] for r in registry.queries()["method_agreement"](spark, SF).collect()} == {_tables(spark)("part").count()}
    texts = registry.texts(spark, _tables(spark)).limit(40).cache()
    by = {m: sorted(tuple(r)[:1] + tuple(r)[2:] for r in pipeline.values(texts, m).collect()) for m in ("evidence_first", "ml")}
    assert by["ml"] == by["evidence_first"] and len(by["ml"]) == 160
    assert pipeline.values(texts).groupBy("report_id", "variable_name").count().where("count = 3").count() == 160


def test_models_are_fitted_on_every_annotated_report(spark):
    """Every label and every n-gram of the annotated reports is in the models."""
    table = _tables(spark)
    gold, texts = registry.gold(spark, table), registry.texts(spark, table)
    fitted = registry.models(spark, table)
    known = gold.select("variable_name", model.label_of(F.col("gold_status"), F.col("gold_value")).alias("label")).distinct().collect()
    for v in P.VARIABLES:
        assert set(fitted[v].stages[0].labels) == {r["label"] for r in known if r["variable_name"] == v}
    grams = texts.select(F.explode(model.ngrams(F.col("text"))).alias("g")).distinct().collect()
    assert set(fitted[P.SIZE].stages[1].vocabulary) == {r["g"] for r in grams}

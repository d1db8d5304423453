"""Comparisons, splits and export layouts on small rows."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from spanforge.functions import patterns as P
from spanforge.operators import evaluate, model, pipeline
from spanforge.sources import sinks

H, S, PT, PN = P.VARIABLES


def test_methods_side_by_side(spark):
    found = spark.createDataFrame([("evidence_first", 0, "a", 0.75), ("baseline", 0, "a", 0.5), ("baseline", 1, "b", 0.25), ("ml", 0, "a", 1.0)], "method string, ord int, metric string, rate double")
    got = {r["metric"]: (r["evidence_first"], r["baseline"], r["delta"]) for r in evaluate.compared(found).collect()}
    assert got == {"a": (0.75, 0.5, 0.25), "b": (None, 0.25, None)}
    flat = spark.createDataFrame([("r", PN, "baseline", "pN0", "supported"), ("r", PN, "ml", None, "not_documented")], "report_id string, variable_name string, method string, extracted_value string, documentation_status string")
    (row,) = evaluate.matrix(flat).collect()
    assert (row["baseline"], row["evidence_first"], row["ml"]) == ("pN0 / supported", None, "- / not_documented")


def test_accepted_and_rejected_results(spark):
    found = spark.createDataFrame([("a", "m", []), ("b", "m", ["x", "y"])], "report_id string, method string, reject_reasons array<string>")
    assert [r["report_id"] for r in pipeline.accepted(found).collect()] == ["a"]
    assert sorted((r["report_id"], r["reason"]) for r in pipeline.rejects(found).collect()) == [("b", "x"), ("b", "y")]


def test_predictions_against_gold(spark):
    found = spark.createDataFrame([("a", PN, "pN0"), ("b", PN, "pN0")], "report_id string, variable_name string, label string")
    gold = spark.createDataFrame([("a", PN, "pN0", "supported"), ("b", PN, None, "negated"), ("c", PN, "x", "supported")], "report_id string, variable_name string, gold_value string, gold_status string")
    assert sorted(map(tuple, model.confusion(found, gold).collect())) == [(PN, "pN0", model.NEGATED, 1), (PN, "pN0", "pN0", 1)]


def test_evaluation_export_is_safe_for_spreadsheets(spark, tmp_path):
    rows = spark.createDataFrame([("=m", "a", 1, 3, 1 / 3, "of three"), ("m", "b", None, 0, None, "none, \"quoted\"\nover two lines")], "method string, metric string, numerator long, denominator long, rate double, definition string")
    out = sinks.evaluation_csv(rows)
    assert out.columns == list(sinks.EVALUATION)
    sinks.write_csv(out.coalesce(1), str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("part*.csv")
    with open(part, newline="") as f:
        got = {r["metric"]: r for r in csv.DictReader(f)}
    assert got["a"]["method"] == "'=m" and got["a"]["rate"] == "0.3333" and got["b"]["rate"] == "N/A" and got["b"]["numerator"] == ""
    assert got["b"]["definition"] == "none, \"quoted\"\nover two lines"
    with pytest.raises(ValueError):
        sinks.evaluation_csv(rows.drop("definition"))


def test_unreviewed_json_says_so(spark):
    (row,) = sinks.unreviewed_json(spark.createDataFrame([("r", "m", None)], "report_id string, method string, note string")).collect()
    body = json.loads(row["json"])
    assert body["metadata"]["review_state"] == "unreviewed" and body["extraction"] == {"report_id": "r", "method": "m", "note": None}


def test_status_counts_in_windows(spark, tmp_path):
    from datetime import datetime

    from spanforge.streaming import reports as stream

    kind = "at timestamp, documentation_status string"
    spark.createDataFrame([(datetime(2024, 5, 1, h), s) for h, s in ((1, "supported"), (1, "negated"), (2, "supported"), (9, "supported"))], kind).coalesce(1).write.parquet(f"{tmp_path}/in")
    read = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
    counts = stream.status_counts(read, "at").select(F.hour("window.start").alias("h"), "documentation_status", "count")
    counts.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [(1, "negated", 1), (1, "supported", 1), (2, "supported", 1)]

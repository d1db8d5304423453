"""Fit and save the field classifiers.

    spark-submit spanforge/jobs/train.py --reports REPORTS.json --gold GOLD.csv --output FOLDER [--most 96]

Fits on the reports that have annotations, at most --most of them, prints what the models rest on, and does nothing if the folder
holds models of these very texts and annotations."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from spanforge.operators import datacheck, model
from spanforge.sources import reports


def train(spark: SparkSession, reports_path: str, gold_path: str, output: str, most: int) -> dict:
    """The facts of the saved models, with fitted: whether they were fitted now. Rows with errors take no part."""
    texts = reports.synthetic(spark, reports_path, datacheck.WATERMARK).where("size(errors) = 0").select("report_id", "text")
    rows = reports.gold_parsed(reports.gold_csv(spark, gold_path), texts).where("size(errors) = 0")
    gold = model.cohort(rows.select("report_id", "variable_name", "gold_value", "gold_status"), most)
    before, now = model.manifest(spark, output), model.facts(gold, texts)
    if not now["reports"]:
        raise ValueError("no annotated report without errors")
    model.default(spark, output, gold, texts)
    return {**model.manifest(spark, output), "fitted": before is None or before.get("digest") != now["digest"]}


def main(arguments: list[str]) -> int:
    parser = argparse.ArgumentParser(description="Fit and save the field classifiers.")
    for name in ("--reports", "--gold", "--output"):
        parser.add_argument(name, required=True)
    parser.add_argument("--most", type=int, default=96, help="annotated reports to fit on at most (default: 96)")
    asked = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("train").getOrCreate()
    found = train(spark, asked.reports, asked.gold, asked.output, asked.most)
    print(f"{'Fitted and saved' if found['fitted'] else 'Already there'}: {asked.output}")
    print(f"Reports used: {found['reports']}")
    for variable, counts in found["label_counts"].items():
        print(f"  {variable}: {counts}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))

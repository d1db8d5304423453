"""Readers of reports and gold annotations, with explicit schemas. Bad rows go to a reject column, never to an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions import patterns as P
from spanforge.functions import text as T

REPORT = "report_id string, cancer_type string, is_synthetic boolean, scenario string, description string, text string"
GOLD_COLUMNS = (
    "report_id", "cancer_type", "variable_name", "gold_value", "evidence_text", "evidence_start_offset", "evidence_end_offset", "documentation_status",
    "manual_review_required", "notes",
)
CANCERS = ("LUAD", "LUSC")


def _named(rules: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())


def accessible(rows: DataFrame) -> DataFrame:
    """rows with report_id (else id, else 'unknown') and text (else report_text, else empty); a null counts as a missing key."""
    out = rows
    for name, other, default in (("report_id", "id", "unknown"), ("text", "report_text", "")):
        there = [F.col(c).cast("string") for c in (name, other) if c in rows.columns]
        out = out.withColumn(name, F.coalesce(*there, F.lit(default)))
    return out


def synthetic(spark: SparkSession, path: str, watermark: str) -> DataFrame:
    """Reports of JSON files ({"reports": [...]} or a bare list) with errors; a file without readable reports is one row of errors."""
    kind = f"array<struct<{REPORT.replace(' ', ':').replace(',:', ',')}>>"
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^[\\uFEFF\\s]+", "").alias("value"))
    found = F.when(F.col("value").startswith("["), F.from_json("value", kind)).otherwise(F.from_json("value", f"reports {kind}")["reports"])
    files = files.select(found.alias("reports"))
    bad = (F.coalesce(F.size("reports"), F.lit(-1)) < 1).alias("__bad")
    checked = synthetic_checked(files.select(bad, F.inline_outer("reports")), watermark)
    return checked.withColumn("errors", F.when(F.col("__bad"), F.array(F.lit("no readable reports in the file"))).otherwise(F.col("errors"))).drop("__bad")


def synthetic_checked(rows: DataFrame, watermark: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("report_id"))
    rules = {
        "id must start with SYN-": ~F.coalesce(F.col("report_id").startswith("SYN-"), F.lit(False)),
        "repeated id": F.col("__n") > 1,
        "not marked synthetic": ~F.coalesce("is_synthetic", F.lit(False)),
        "unknown cancer type": ~F.coalesce(F.col("cancer_type").isin(*CANCERS), F.lit(False)),
        "watermark missing": ~F.coalesce(F.col("text").startswith(watermark), F.lit(False)),
        "identifier label": F.size(T.identifier_labels(F.coalesce("text", F.lit("")))) > 0,
    }
    return rows.withColumn("__n", n).withColumn("errors", _named(rules)).drop("__n")


def prepared(rows: DataFrame) -> DataFrame:
    """rows (raw_text, source, approved, report_id?, description?, cancer_type?) -> canonical reports with errors."""
    out = rows.withColumn("text", T.sanitized(F.col("raw_text")))
    labels = T.identifier_labels(F.coalesce("text", F.lit("")))
    synth = F.col("source") == "synthetic"
    errors = _named({
        "unknown report source": ~F.coalesce(F.col("source").isin("synthetic", "pasted", "uploaded"), F.lit(False)),
        "not approved for local use": ~synth & ~F.coalesce("approved", F.lit(False)),
    })
    found = F.concat(errors, F.filter(F.array(T.length_error(F.col("text")), F.when(F.size(labels) > 0, F.concat(F.lit("direct identifiers: "), F.array_join(F.array_sort(labels), ", ")))), lambda x: x.isNotNull()))
    get = lambda c, default: F.coalesce(F.col(c), default) if c in rows.columns else default
    return out.select(
        get("report_id", T.local_id(F.col("text"))).alias("report_id"), get("cancer_type", F.lit(None).cast("string")).alias("cancer_type"),
        get("description", F.lit("Approved local report")).alias("description"), "text", "source", synth.alias("is_synthetic"),
        (synth | F.coalesce("approved", F.lit(False))).alias("approved_for_local_use"), found.alias("errors"),
    )


def uploaded(spark: SparkSession, path: str) -> DataFrame:
    """Text files of a folder: path, raw_text and the error that keeps a file out. Over-long files are not read."""
    files = spark.read.format("binaryFile").load(path)
    good = F.lower(F.col("path")).endswith(".txt")
    text = F.expr("try_validate_utf8(content)")
    error = (
        F.when(~good, "Upload a UTF-8 plain-text file with a .txt extension.").when(F.col("length") == 0, "The uploaded file is empty.")
        .when(F.col("length") > P.REPORT_BYTES, f"The uploaded file exceeds the {P.REPORT_BYTES // 1024} KB local limit.")
        .when(text.isNull(), "The uploaded file must be valid UTF-8 text.")
    )
    return files.select("path", F.regexp_replace(F.when(error.isNull(), text), "^﻿", "").alias("raw_text"), error.alias("error"))


def gold_csv(spark: SparkSession, path: str) -> DataFrame:
    """Annotations as strings, by header name."""
    schema = ", ".join(f"{c} string" for c in GOLD_COLUMNS)
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("enforceSchema", False).csv(path)


def gold_parsed(raw: DataFrame, texts: DataFrame) -> DataFrame:
    """Typed annotations with errors: status, offsets, booleans, keys, known reports, exact evidence, four fields a report."""
    full = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    number = lambda c: F.col(c).try_cast("int")
    flag = F.lower(F.trim("manual_review_required"))
    key = Window.partitionBy("report_id", "variable_name")
    rows = raw.join(texts.select("report_id", "text"), "report_id", "left")
    status = F.lower(F.trim("documentation_status"))
    start, stop = number("evidence_start_offset"), number("evidence_end_offset")
    digits = lambda c: full(c).isNotNull() & ~F.col(c).rlike("^[0-9]+$")
    some = (full("evidence_text").isNotNull()).cast("int") + full("evidence_start_offset").isNotNull().cast("int") + full("evidence_end_offset").isNotNull().cast("int")
    rows = rows.withColumn("__n", F.count("*").over(key)).withColumn("__v", F.size(F.collect_set("variable_name").over(Window.partitionBy("report_id"))))
    errors = _named({
        "unknown status": ~status.isin(*P.STATUSES), "unknown variable": ~F.col("variable_name").isin(*P.VARIABLES), "offsets must be digits": digits("evidence_start_offset") | digits("evidence_end_offset"),
        "boolean must be true or false": ~flag.isin("true", "false"), "repeated annotation": F.col("__n") > 1, "unknown report": F.col("text").isNull(),
        "evidence needs text and both offsets": ~some.isin(0, 3), "evidence is not at its offsets": (some == 3) & ~F.coalesce(F.substring(F.col("text"), start + 1, stop - start) == F.col("evidence_text"), F.lit(False)),
        "a report needs each variable once": F.col("__v") != len(P.VARIABLES), "a value is required": status.isin("supported", "uncertain", "superseded") & full("gold_value").isNull(),
        "only supported fields may skip review": (status != "supported") & (flag == "false"),
    })
    return rows.select(
        "report_id", "cancer_type", "variable_name", full("gold_value").alias("gold_value"), full("evidence_text").alias("evidence_text"), start.alias("evidence_start_offset"),
        stop.alias("evidence_end_offset"), status.alias("gold_status"), (flag == "true").alias("gold_review"), "notes", errors.alias("errors"),
    )

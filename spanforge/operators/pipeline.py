"""Reports in, validated results out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions import patterns as P
from spanforge.operators import extract, model, validate
from spanforge.operators.extract import ISSUES

FIELD = f"struct<variable_order:int,variable_name:string,extracted_value:string,documentation_status:string,evidence:{extract.EVIDENCE},alternatives:array<string>,notes:string>"


def fields(reports: DataFrame, *methods: str, models: dict | None = None) -> DataFrame:
    """Fields of all reports with their issues, one pass for all methods; the text is still on the row. Method `ml` needs models
    (model.fit_all)."""
    methods = methods or ("evidence_first",)
    if unknown := set(methods) - set(P.METHODS):
        raise ValueError(f"unknown method {sorted(unknown)[0]!r}")
    if "ml" in methods and not models:
        raise ValueError("method 'ml' needs models")
    if "ml" not in methods:
        return validate.with_qa(validate.checked(extract.fields(reports, *methods)))
    # fields need the confidences only; the probabilities of all labels would go along on every row
    sure = F.transform("predictions", lambda p: F.struct(p["variable_name"].alias("variable_name"), p["confidence"].alias("confidence")))
    known = model.annotated(reports, models).withColumn("predictions", sure)
    return validate.with_qa(validate.checked(model.noted(extract.fields(known, *methods, dealt=True))))


def results(reports: DataFrame, *methods: str, models: dict | None = None) -> DataFrame:
    """One row for each report and method: its four fields, issues, priority and provenance. Reports whose fields break the
    schema are marked in reject_reasons instead of failing the job."""
    return gathered(fields(reports, *methods, models=models), *methods).drop("kept")


def gathered(rows: DataFrame, *methods: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """fields -> results, in one shuffle without texts; kept: columns of the fields that go along, as an array of structs in the
    order of variables."""
    rows = rows.withColumn("__amended", F.when(F.col("method") != "baseline", validate.amendments(F.col("text"), F.col("sections"))))
    rows = rows.withColumn("source_report_digest", F.concat(F.lit("sha256:"), F.sha2("text", 256))).withColumn("__empty", F.length(F.trim("text")) == 0)
    if "document_issues" not in rows.columns:
        rows = rows.withColumn("document_issues", F.array().cast(ISSUES))
    field = F.struct("variable_order", "variable_name", "extracted_value", "documentation_status", "evidence", "alternatives", "notes").cast(FIELD)
    own = F.struct(*kept) if kept else F.lit(None).cast("string")
    grouped = rows.groupBy("report_id", "method").agg(
        F.array_sort(F.collect_list(F.struct("variable_order", field.alias("field"), F.col("extract_issues").alias("e"), F.col("validate_issues").alias("v"), F.col("qa_issues").alias("q"), F.col("violations").alias("bad"), own.alias("own")))).alias("__f"),
        F.first("__amended").alias("__amended"), F.first("source_report_digest").alias("source_report_digest"), F.first("document_issues").alias("__doc"), F.first("__empty").alias("__empty"),
    )
    each = lambda c: F.transform("__f", lambda f: f[c])
    all_of = lambda c: F.flatten(each(c))
    grouped = grouped.withColumn("variables", each("field")).withColumn(
        "qa_issues", F.concat(all_of("q"), F.filter(F.array("__amended"), lambda i: i.isNotNull()), "__doc").cast(ISSUES)
    )
    level, reason = validate.priority(F.col("qa_issues"), final=True)
    if "baseline" in methods:
        first = F.col("method") == "baseline"
        first_level, first_reason = validate.priority(all_of("e").cast(ISSUES), final=False)
        critical = F.exists(all_of("v"), lambda i: i["severity"] == "critical")
        denied = F.exists(all_of("v"), lambda i: i["issue_type"] == "negated")
        level = F.when(~first, level).when(critical, "critical").when(denied & (first_level == "low"), "high").otherwise(first_level)
        reason = F.when(~first, reason).when(critical, "Critical evidence validation failure requires manual review.").when(denied, "A proposed value was explicitly negated and was removed.").otherwise(first_reason)
    rejects = F.concat(F.array_distinct(all_of("bad")), F.when(F.col("__empty"), F.array(F.lit("empty text"))).otherwise(F.array().cast("array<string>")))
    return grouped.select(
        "report_id", "method", "source_report_digest", "variables", "qa_issues", level.alias("review_priority"), reason.alias("review_priority_reason"),
        (level != "low").alias("manual_review_required"), rejects.alias("reject_reasons"), each("own").alias("kept"),
    )


def values(reports: DataFrame, *methods: str) -> DataFrame:
    """Value and status of every field: a row for each report, field and method (all of them, unless some are named). Those of
    `ml` are the evidence-first ones: its models lead its notes and nothing else (model.noted), so none are needed here."""
    wanted = methods or P.METHODS
    own = [m for m in P.METHODS if m in wanted and m != "ml" or m == "evidence_first" and "ml" in wanted]
    same = F.array(*[F.lit(m) for m in wanted if m != "baseline"]).cast("array<string>")
    rows = validate.checked(extract.fields(reports, *own)).select("report_id", "method", "variable_name", "extracted_value", "documentation_status")
    return rows.withColumn("method", F.explode(F.when(F.col("method") == "baseline", F.array("method")).otherwise(same)))


def every_method(reports: DataFrame, models: dict | None = None) -> DataFrame:
    """The results of all methods; of those without a model if there are no models."""
    return results(reports, *[m for m in P.METHODS if models or m != "ml"], models=models)


def rejects(found: DataFrame) -> DataFrame:
    """(report_id, method, reason) of results that may not be used."""
    return found.select("report_id", "method", F.explode("reject_reasons").alias("reason"))


def accepted(found: DataFrame) -> DataFrame:
    return found.where(F.size("reject_reasons") == 0).drop("reject_reasons")


def flat(found: DataFrame) -> DataFrame:
    """Results as one row for each field."""
    return found.select("report_id", "method", "manual_review_required", "review_priority", F.inline("variables"))

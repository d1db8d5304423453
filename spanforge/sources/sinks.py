"""Export layouts: rows ready for CSV or JSON writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import patterns as P
from spanforge.functions import text as T

LABEL_REVIEWED = "Illustrative synthetic or approved local results"
LABEL_EVALUATION = "Illustrative synthetic results"
# Column order of the exports.
REVIEWED = (
    "export_label", "report_id", "method", "model_version", "source_report_digest", "extraction_timestamp", "document_provenance_json", "reviewer_identity",
    "reviewer_identity_verified", "review_id", "reviewed_at", "review_started_at", "review_duration_seconds", "returned_for_clarification", "original_review_priority",
    "original_review_priority_reason", "residual_review_priority", "residual_review_priority_reason", "variable_name", "original_value", "original_status",
    "review_action", "reviewed_value", "reviewed_status", "reviewed_alternatives_json", "review_reason", "evidence_json", "overall_note",
)
AUDIT = (
    "export_label", "audit_id", "review_id", "timestamp", "report_id", "method", "model_version", "source_report_digest", "extraction_timestamp", "reviewer_identity",
    "reviewer_identity_verified", "variable_name", "original_value", "original_status", "reviewer_action", "corrected_value", "resulting_value", "resulting_status",
    "resulting_alternatives_json", "review_reason", "original_evidence_json", "resulting_evidence_json",
)
EVALUATION = ("export_label", "method", "metric", "numerator", "denominator", "rate", "definition")


def whole_json(value: Column) -> Column:
    """JSON that keeps nulls."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def laid_out(rows: DataFrame, columns: tuple[str, ...], label: str) -> DataFrame:
    """rows with exactly these columns, strings safe for spreadsheets, booleans as True or False; a missing column is an error."""
    kinds = dict(rows.dtypes)
    if missing := [c for c in columns if c not in kinds and c != "export_label"]:
        raise ValueError(f"columns missing for the export: {', '.join(missing)}")

    def one(c: str) -> Column:
        if c == "export_label":
            return F.lit(label).alias(c)
        if kinds[c] == "boolean":
            return F.when(F.col(c), "True").when(~F.col(c), "False").otherwise("").alias(c)
        if kinds[c] == "string":
            return T.spreadsheet_safe(F.coalesce(F.col(c), F.lit(""))).alias(c)
        return F.col(c)

    return rows.select(*map(one, columns))


def reviewed_csv(fields: DataFrame) -> DataFrame:
    rows = fields.withColumn("reviewed_alternatives_json", whole_json(F.col("alternatives"))).withColumn("evidence_json", whole_json(F.col("evidence")))
    return laid_out(rows, REVIEWED, LABEL_REVIEWED)


def audit_csv(fields: DataFrame) -> DataFrame:
    rows = fields.select(
        "*", F.col("reviewed_at").alias("timestamp"), F.col("review_action").alias("reviewer_action"), F.col("reviewed_value").alias("resulting_value"),
        F.when(F.col("review_action") == "corrected", F.col("reviewed_value")).alias("corrected_value"), F.col("reviewed_status").alias("resulting_status"),
        whole_json(F.col("alternatives")).alias("resulting_alternatives_json"), whole_json(F.col("evidence")).alias("resulting_evidence_json"),
        whole_json(F.col("original_evidence")).alias("original_evidence_json"),
    )
    return laid_out(rows, AUDIT, LABEL_REVIEWED)


def evaluation_csv(metrics: DataFrame) -> DataFrame:
    rate = F.coalesce(F.format_string("%.4f", "rate"), F.lit("N/A"))
    return laid_out(metrics.withColumn("rate", F.when(F.col("rate").isNull(), F.lit("N/A")).otherwise(rate)), EVALUATION, LABEL_EVALUATION)


#: Columns of a review that its fields share, in the order of the document.
REVIEW = (
    "review_id", "report_id", "method", "model_version", "source_report_digest", "extraction_timestamp", "document_provenance_json", "reviewer_identity", "reviewer_identity_verified",
    "reviewed_at", "review_started_at", "review_duration_seconds", "returned_for_clarification", "original_review_priority", "original_review_priority_reason",
    "residual_review_priority", "residual_review_priority_reason", "overall_note",
)
DISCLAIMER = "Research and review prototype; not for diagnosis or clinical use."
_ORIGINAL = (("extracted_value", "original_value"), ("documentation_status", "original_status"), ("evidence", "original_evidence"), ("alternatives", "original_alternatives"))
_FIELD = ("variable_name", "reviewed_value", "reviewed_status", "review_action", "review_reason", "evidence", "alternatives")
_RECORD = (
    "audit_id", "review_id", "report_id", "method", "model_version", "source_report_digest", "extraction_timestamp", "reviewer_identity", "reviewer_identity_verified", "variable_name",
    "reviewer_action", "corrected_value", "resulting_value", "resulting_status", "resulting_evidence", "resulting_alternatives", "review_reason", "timestamp",
)


def reviewed_json(fields: DataFrame, audit: DataFrame | None = None) -> DataFrame:
    """One JSON document for each review: metadata, the review with all its columns and its fields in the order of variables, and
    its audit history in the order of time. Nulls are kept; columns that are not there are null.

    Fields and history are of two grains, so each is gathered by review_id first and then joined, a review to a review. A review has a
    field for each variable; its history grows with its corrections only."""
    there = lambda df, names, place=None: F.struct(*[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in names], *(place or []))
    original = lambda df: F.struct(*[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(n) for n, c in _ORIGINAL]).alias("original_output")
    order = F.array_position(F.array(*map(F.lit, P.VARIABLES)), F.col("variable_name"))
    one = F.struct(order.alias("o"), "variable_name", there(fields, _FIELD, [original(fields)]).alias("f"))
    grouped = fields.groupBy("review_id").agg(F.first(there(fields, REVIEW)).alias("review"), F.array_sort(F.collect_list(one)).alias("fields"))
    if audit is None:
        grouped = grouped.withColumn("history", F.array().cast("array<string>"))
    else:
        event = F.struct("timestamp", "audit_id", there(audit, _RECORD, [original(audit)]).alias("a"))
        history = audit.groupBy("review_id").agg(F.array_sort(F.collect_list(event)).alias("__h"))
        grouped = grouped.join(history, "review_id", "left").withColumn("history", F.coalesce(F.transform("__h", lambda x: x["a"]), F.array()))
    meta = F.struct(F.lit(LABEL_REVIEWED).alias("label"), F.lit(DISCLAIMER).alias("disclaimer"))
    review = F.struct("review.*", F.transform("fields", lambda x: x["f"]).alias("fields"))
    body = F.struct(meta.alias("metadata"), review.alias("reviewed_abstraction"), F.col("history").alias("audit_history"))
    return grouped.select("review_id", whole_json(body).alias("json"))


def unreviewed_json(results: DataFrame) -> DataFrame:
    body = F.struct(F.struct(F.lit("unreviewed").alias("review_state"), F.lit(LABEL_REVIEWED).alias("export_label")).alias("metadata"), F.struct(*results.columns).alias("extraction"))
    return results.select("report_id", "method", whole_json(body).alias("json"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)

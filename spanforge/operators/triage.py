"""What a reviewer sees first: reasons to look at a field, the order of fields, queues, filters, labels and workspace counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import patterns as P

# Reasons, markers, labels and notes that must read as given.
REASON_OF_STATUS = {
    "conflicting": "Conflicting evidence",
    "not_documented": "Missing or unassignable documentation",
    "cannot_be_assigned": "Missing or unassignable documentation",
    "uncertain": "Uncertain, low-confidence, or unsupported output",
    "unsupported": "Uncertain, low-confidence, or unsupported output",
    "manual_review_required": "Uncertain, low-confidence, or unsupported output",
    "superseded": "Corrected or superseded statement",
    "negated": "Explicitly negated finding",
}
WEAK = "Uncertain, low-confidence, or unsupported output"
WEAK_NOTES = ("low-confidence", "not decisive", "withheld")
DISAGREE = "Extraction methods disagree"
CORRECTING = "Reviewer correction in progress"
SEVERITIES = ("critical", "high", "medium", "low")
VARIABLE_LABELS = {
    "histologic_diagnosis": "Histologic diagnosis",
    "tumor_size": "Tumor size",
    "pathological_t_category": "Pathological T category",
    "pathological_n_category": "Pathological N category",
}
ACTION_LABELS = {"pending": "Pending", "accepted": "Accept", "corrected": "Correct", "rejected": "Reject", "flagged_for_review": "Flag"}
PN0_NOTE = "Explicit pN0: the report documents pathological N0. This is not pNX or Not documented."
PNX_NOTE = "pNX / Cannot be assigned: this is not pN0 or Not documented."
NO_PN_NOTE = "Not documented: no explicit pathological N category is present. This is not pN0 or pNX."


def looked_up(key: Column, table: dict[str, str]) -> Column:
    """The entry of a small fixed table; null for other keys."""
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def variable_label(name: Column) -> Column:
    return F.coalesce(looked_up(name, VARIABLE_LABELS), F.initcap(F.replace(name, F.lit("_"), F.lit(" "))))


# Label, tone and description of each status.
STATUS = {
    "supported": ("Supported", "positive", "An exact report span supports the proposed value."),
    "not_documented": ("Not documented", "neutral", "The report does not explicitly document this field."),
    "cannot_be_assigned": ("Cannot be assigned", "neutral", "The report explicitly says the category cannot be assigned."),
    "negated": ("Negated", "neutral", "The report explicitly denies the candidate finding."),
    "uncertain": ("Uncertain", "warning", "The report qualifies the candidate as uncertain or provisional."),
    "conflicting": ("Conflicting", "danger", "Different report statements cannot be safely reconciled."),
    "superseded": ("Superseded", "warning", "A later explicitly linked statement replaces this finding."),
    "unsupported": ("Unsupported", "danger", "The proposed value does not have valid exact evidence."),
    "manual_review_required": ("Manual review required", "danger", "The field is intentionally withheld for reviewer resolution."),
}


def status_presentation(status: Column) -> Column:
    """label, tone and description of a status; a null struct for what is none."""
    part = lambda i: looked_up(status, {k: v[i] for k, v in STATUS.items()})
    shown = F.struct(part(0).alias("label"), part(1).alias("tone"), part(2).alias("description"))
    return F.when(status.isin(*STATUS), shown)


def nodal_note(variable: Column, value: Column, status: Column) -> Column:
    """Which of pN0, pNX and not documented an N category is; null for other variables and values."""
    of_n = F.when(value == "pN0", PN0_NOTE).when((value == "pNX") | (status == "cannot_be_assigned"), PNX_NOTE).when(status == "not_documented", NO_PN_NOTE)
    return F.when(variable == P.PN, of_n)


def triaged(every: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """every: flat results of all methods (report_id, method, variable_order, variable_name, extracted_value,
    documentation_status, notes), without texts -> the same rows with triage_reasons, empty for routine fields, and
    review_place, from 1 in each report and method: fields with reasons first, else the order of variables.

    One aggregate over the reports: a report has one row for each variable and method, so its group is small. Methods disagree where they give
    a variable different values or statuses; nulls are equal. decisions (report_id, method, variable_name, action) may be missing."""
    rows = every
    if decisions is None:
        rows = rows.withColumn("__action", F.lit(None).cast("string"))
    else:
        taken = decisions.select("report_id", "method", "variable_name", F.col("action").alias("__action"))
        rows = rows.join(taken.hint("merge"), ["report_id", "method", "variable_name"], "left")
    notes = F.lower(F.coalesce("notes", F.lit("")))
    weak = F.lit(False)
    for marker in WEAK_NOTES:
        weak = weak | notes.contains(marker)
    by_status = looked_up(F.col("documentation_status"), REASON_OF_STATUS)
    own = F.array(by_status, F.when(weak & ~by_status.eqNullSafe(WEAK), WEAK))
    keep = [c for c in rows.columns if c not in ("report_id", "__action")]
    field = F.struct("variable_order", "method", F.struct(*keep).alias("row"), own.alias("own"), (F.col("__action") == "corrected").alias("correcting"))
    grouped = rows.groupBy("report_id").agg(F.array_sort(F.collect_list(field)).alias("__f"))

    def differs(x: Column) -> Column:
        same = lambda a, b: (a["row"]["extracted_value"].eqNullSafe(b["row"]["extracted_value"])) & (a["row"]["documentation_status"].eqNullSafe(b["row"]["documentation_status"]))
        return F.exists("__f", lambda y: (y["row"]["variable_name"] == x["row"]["variable_name"]) & ~same(x, y))

    def told(x: Column) -> Column:
        reasons = F.filter(F.concat(x["own"], F.array(F.when(differs(x), DISAGREE), F.when(x["correcting"], CORRECTING))), lambda r: r.isNotNull())
        return F.struct(x["row"].alias("row"), reasons.alias("reasons"), x["method"].alias("method"), x["variable_order"].alias("variable_order"))

    def placed(x: Column) -> Column:
        key = lambda y: F.struct((F.size(y["reasons"]) == 0).alias("routine"), y["variable_order"].alias("o"))
        before = F.filter("__t", lambda y: (y["method"] == x["method"]) & (key(y) < key(x)))
        return F.struct(x["row"].alias("row"), x["reasons"].alias("triage_reasons"), (F.size(before) + 1).cast("int").alias("review_place"))

    told_rows = grouped.select("report_id", F.transform("__f", told).alias("__t"))
    out = told_rows.select("report_id", F.inline(F.transform("__t", placed)))
    return out.select("report_id", "row.*", "triage_reasons", "review_place")


def queue(reports: DataFrame, found: DataFrame, preferred: DataFrame) -> DataFrame:
    """reports with queue_method: the preferred method (report_id, method) if it has a result, else evidence_first, else the
    first there is in the order of P.METHODS; without any result the preferred one, or evidence_first."""
    have = found.groupBy("report_id").agg(F.collect_set("method").alias("__have"))
    rows = reports.join(have.hint("merge"), "report_id", "left").join(preferred.select("report_id", F.col("method").alias("__wish")).hint("merge"), "report_id", "left")
    there = lambda m: F.coalesce(F.array_contains("__have", m), F.lit(False))
    first = F.coalesce(*[F.when(there(F.lit(m)), F.lit(m)) for m in P.METHODS])
    chosen = F.when(there(F.col("__wish")), F.col("__wish")).when(there(F.lit("evidence_first")), "evidence_first").otherwise(F.coalesce(first, "__wish", F.lit("evidence_first")))
    return rows.withColumn("queue_method", chosen).drop("__have", "__wish")


CASE_STATUSES = ("Needs review", "In progress", "Completed")


def queue_cases(queued: DataFrame, found: DataFrame, decisions: DataFrame, snapshots: DataFrame, dirty: DataFrame | None = None, only: str = "All") -> DataFrame:
    """queued (report_id, queue_method, ...) with case_status of the queued method, of one status only unless that is All.

    Completed: there is a snapshot (report_id, method). Needs review: there is no result (report_id, method), or nothing was begun. In progress:
    a decision other than pending, or a draft with unsaved changes (dirty) beside any decision."""
    if only not in ("All", *CASE_STATUSES):
        raise ValueError(f"unknown case status {only!r}")
    key = lambda df, flag: df.groupBy("report_id", F.col("method").alias("queue_method")).agg(F.lit(True).alias(flag)).hint("merge")
    rows = queued.join(key(snapshots, "__done"), ["report_id", "queue_method"], "left").join(key(found, "__has"), ["report_id", "queue_method"], "left")
    taken = decisions.groupBy("report_id", F.col("method").alias("queue_method")).agg(F.bool_or(F.col("action") != "pending").alias("__begun"), F.lit(True).alias("__any"))
    rows = rows.join(taken.hint("merge"), ["report_id", "queue_method"], "left")
    rows = rows.join(key(dirty, "__dirty"), ["report_id", "queue_method"], "left") if dirty is not None else rows.withColumn("__dirty", F.lit(None).cast("boolean"))
    begun = F.col("__has") & F.col("__any") & (F.col("__begun") | F.coalesce("__dirty", F.lit(False)))
    out = rows.withColumn("case_status", F.when(F.col("__done"), "Completed").when(begun, "In progress").otherwise("Needs review"))
    out = out.drop("__done", "__has", "__begun", "__any", "__dirty")
    return out if only == "All" else out.where(F.col("case_status") == only)


def issues_shown(issues: DataFrame, severities: tuple[str, ...] = (), types: tuple[str, ...] = ()) -> DataFrame:
    """Issues (severity, issue_type, ...) of the chosen severities and types; an empty choice takes all."""
    out = issues
    for column, chosen in (("severity", severities), ("issue_type", types)):
        if chosen:
            out = out.where(F.col(column).isin(*chosen))
    return out


def audit_of(audit: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The audit rows of the given reviews."""
    return audit.join(snapshots.select("review_id"), "review_id", "left_semi")


def workspace(reports: DataFrame, found: DataFrame, snapshots: DataFrame, audit: DataFrame) -> DataFrame:
    """One row: how many reports, results, reviews and audit records there are."""
    n = lambda df, name: df.select(F.lit(name).alias("kind"))
    kinds = ("reports_loaded", "extractions_run", "reviews_saved", "audit_records")
    rows = n(reports, kinds[0])
    for df, name in zip((found, snapshots, audit), kinds[1:]):
        rows = rows.unionByName(n(df, name))
    return rows.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])

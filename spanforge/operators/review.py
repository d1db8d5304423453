"""Human review: drafts, checks of decisions, snapshots, audit trail, and the figures over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import patterns as P
from spanforge.functions import spans
from spanforge.operators import pipeline, support, validate, versions
from spanforge.operators.extract import EVIDENCE

NEED_VALUE = ("supported", "uncertain", "superseded")
NO_VALUE = ("not_documented", "negated", "conflicting", "unsupported", "manual_review_required")
NEED_EVIDENCE = ("supported", "cannot_be_assigned", "negated", "uncertain", "conflicting", "superseded")
MEANING = (*NEED_EVIDENCE, "not_documented")
HIGH = ("conflicting", "unsupported", "manual_review_required")
MOST_EVIDENCE = 10_000


def drafts(fields: DataFrame) -> DataFrame:
    """A pending decision for each field, filled in with the proposal."""
    return fields.select(
        "report_id", "method", "variable_name", F.lit("pending").alias("action"), *[F.col(c).alias(n) for n, c in PROPOSED.items()],
        F.array().cast("array<string>").alias("corrected_evidence_texts"), F.lit("").alias("reason"),
    )


#: What decisions are held against, and the field that fills in each part of a draft.
JUDGED = ("text", "extracted_value", "documentation_status", "evidence", "alternatives")
PROPOSED = {"corrected_value": "extracted_value", "corrected_status": "documentation_status", "conflicting_alternatives": "alternatives"}


def _full(texts: str) -> Column:
    return F.filter(F.transform(F.coalesce(F.col(texts), F.array().cast("array<string>")), F.trim), lambda t: t != "")


def checked(fields: DataFrame, decisions: DataFrame) -> DataFrame:
    """fields (report_id, method, variable_name, text, ...) joined with decisions (see drafts): errors, an array of messages.

    Fields without a decision, and decisions without a field, are errors too."""
    keys = ["report_id", "method", "variable_name"]
    rows = fields.select(*keys, *JUDGED, F.lit(True).alias("__field")).join(decisions.withColumn("__decision", F.lit(True)).hint("merge"), keys, "full")
    return _judged(rows)


def checked_drafts(fields: DataFrame, action: Column, reason: Column) -> DataFrame:
    """Like `checked`, for decisions that are the fields' own drafts under these actions and reasons: they stand on the field's
    row, so the fields are read once and no text is shuffled. report_id, method and variable_name tell the fields apart; other
    columns stay."""
    draft = [F.col(c).alias(n) for n, c in PROPOSED.items()]
    rows = fields.select("*", F.lit(True).alias("__field"), action.alias("action"), *draft, F.array().cast("array<string>").alias("corrected_evidence_texts"), reason.alias("reason"), F.lit(True).alias("__decision"))
    return _judged(rows)


def _judged(rows: DataFrame) -> DataFrame:
    """Fields beside their decisions, held against all rules."""
    state, variable, text = F.col("corrected_status"), F.col("variable_name"), F.col("text")
    fix = F.col("action") == "corrected"
    rows = rows.withColumn("__v", F.when(F.trim("corrected_value") != "", F.trim("corrected_value"))).withColumn("__e", _full("corrected_evidence_texts"))
    rows = rows.withColumn("__a", F.when(state == "conflicting", _full("conflicting_alternatives")).otherwise(F.array().cast("array<string>")))
    value, ev, alts = F.col("__v"), F.col("__e"), F.col("__a")
    times = lambda t: ((F.length(text) - F.length(F.replace(text, t, F.lit("")))) / F.length(t)).cast("int")
    rows = rows.withColumn("__once", F.filter(ev, lambda t: times(t) == 1))
    place = lambda t: F.call_function("locate", t, text) - 1
    span = lambda t: F.struct(t.alias("text"), place(t).cast("int").alias("start_offset"), (place(t) + F.length(t)).cast("int").alias("end_offset"))
    rows = rows.withColumn("__spans", F.transform("__once", span).cast(EVIDENCE)).withColumn("__ctx", support.contexts_of(text, F.col("__spans")))
    rows = rows.withColumn("__p", F.when(value.isNotNull(), support.value_pattern(variable, value)))
    need = F.when(state == "conflicting", 2).when(state.isin(*NEED_EVIDENCE), 1).otherwise(0)
    whole = F.size("__spans") == F.size(ev)
    states = F.exists(F.zip_with(support.texts_of(F.col("__spans")), F.col("__ctx"), lambda e, c: support.supports_value(variable, value, F.col("__p"), e, c)), lambda x: x)
    carries = support.supports_status(variable, state, value, F.col("__p"), support.texts_of(F.col("__spans")), F.col("__ctx"), alts)
    broken = F.size(validate.contract_violations(variable, value, state, F.col("__spans"), alts)) > 0
    rules = [
        (F.col("__decision").isNull(), "no review decision"), (F.col("__field").isNull(), "unexpected review decision"),
        (F.col("action") == "pending", "choose Accept, Correct, Reject, or Flag"), (~F.col("action").isin(*P.ACTIONS), "unknown action"),
        (fix & state.isNull(), "choose a corrected QA status"),
        (fix & F.exists(ev, lambda t: F.length(t) > MOST_EVIDENCE), "each corrected evidence span must be 10,000 characters or fewer"),
        (fix & (F.size(F.array_distinct(ev)) < F.size(ev)), "corrected evidence spans must be distinct"),
        (fix & (state == "conflicting") & ((F.size(alts) < 2) | (F.size(alts) != F.size(ev))), "one distinct alternative is needed for each of at least two spans"),
        (fix & (state == "conflicting") & (F.size(F.array_distinct(F.transform(alts, F.lower))) < F.size(alts)), "conflicting alternatives must be distinct"),
        (fix & state.isin(*NEED_VALUE) & value.isNull(), "a corrected value is required"),
        (fix & state.isin(*NO_VALUE) & value.isNotNull(), "this status requires an empty corrected value"),
        (fix & (state == "cannot_be_assigned") & value.isNotNull() & ~(((variable == P.PN) & (value == "pNX")) | ((variable == P.PT) & (value == "pTX"))), "only explicit pNX or pTX may carry a cannot-be-assigned value"),
        (fix & (F.size(ev) < need), "more distinct exact evidence is required for the corrected status"),
        (fix & F.exists(ev, lambda t: ~text.contains(t)), "corrected evidence must be an exact report substring"),
        (fix & F.exists(ev, lambda t: text.contains(t) & (times(t) != 1)), "corrected evidence occurs more than once"),
        (fix & value.isNotNull() & (state != "superseded") & (F.size(ev) > 0) & ~states, "corrected evidence does not state the corrected value"),
        (fix & state.isin(*MEANING) & whole & (F.size("__spans") >= need) & ~carries, "corrected evidence does not support the corrected status"),
        (fix & whole & (F.size("__spans") >= need) & (~state.isin(*NEED_VALUE) | value.isNotNull()) & broken, "corrected value or status violates the field schema"),
        (F.col("action").isin("corrected", "rejected", "flagged_for_review") & (F.trim(F.coalesce("reason", F.lit(""))) == ""), "explain this reviewer action"),
    ]
    errors = F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in rules]), lambda m: m.isNotNull())
    kept = [c for c in rows.columns if not c.startswith("__")]
    return rows.select(*kept, F.col("__spans").alias("corrected_spans"), value.alias("clean_value"), alts.alias("clean_alternatives"), errors.alias("errors"))


def sound(rows: DataFrame) -> DataFrame:
    """The fields of reviews of which every field is free of errors; rows without a report or method belong to no review and stay.

    A window over the few fields of a review: a join of the rows with their own errors would work them out twice."""
    bad = F.bool_or(F.size("errors") > 0).over(Window.partitionBy("report_id", "method"))
    named = F.col("report_id").isNotNull() & F.col("method").isNotNull()
    return rows.withColumn("__bad", named & bad).where(~F.col("__bad")).drop("__bad")


def reviewed(rows: DataFrame, reviewed_at: str, reviewer: str = "Unassigned") -> DataFrame:
    """One row for each field of sound reviews: what the reviewer's action makes of it, with ids that reruns repeat."""
    return rows.select(*reviewed_columns(reviewed_at, reviewer))


def reviewed_columns(reviewed_at: str, reviewer: str) -> list[Column]:
    a = F.col("action")
    by = lambda accepted, corrected, rejected, flagged: F.when(a == "accepted", accepted).when(a == "corrected", corrected).when(a == "rejected", rejected).otherwise(flagged)
    null, none = F.lit(None).cast("string"), F.array().cast(EVIDENCE)
    ident = lambda kind, *parts: F.concat(F.lit(kind), F.upper(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)))
    return [
        F.col("report_id"), F.col("method"), F.col("variable_name"), F.col("extracted_value").alias("original_value"), F.col("documentation_status").alias("original_status"),
        a.alias("review_action"), by(F.col("extracted_value"), F.col("clean_value"), null, null).alias("reviewed_value"),
        by(F.col("documentation_status"), F.col("corrected_status"), F.lit("unsupported"), F.lit("manual_review_required")).alias("reviewed_status"),
        by(F.col("evidence").cast(EVIDENCE), F.col("corrected_spans").cast(EVIDENCE), none, none).alias("evidence"),
        by(F.col("alternatives"), F.col("clean_alternatives"), F.array().cast("array<string>"), F.array().cast("array<string>")).alias("alternatives"),
        F.when((a == "accepted") & (F.trim("reason") == ""), "Reviewer accepted the proposed value and QA status.").otherwise(F.trim("reason")).alias("review_reason"),
        F.col("evidence").cast(EVIDENCE).alias("original_evidence"), F.lit(reviewed_at).alias("reviewed_at"), F.lit(reviewer).alias("reviewer_identity"),
        ident("REV-", "report_id", "method", F.lit(reviewed_at)).alias("review_id"), ident("AUD-", "report_id", "method", F.lit(reviewed_at), "variable_name").alias("audit_id"),
    ]


def session_errors(reviewer: str | Column) -> Column:
    """What keeps a review (returned_for_clarification, overall_note) from being completed: an array of messages."""
    who = F.trim(F.coalesce(F.lit(reviewer) if isinstance(reviewer, str) else reviewer, F.lit("")))
    return F.filter(
        F.array(
            F.when(who.isin("", "Unassigned"), F.lit("a reviewer must be assigned")),
            F.when(F.coalesce("returned_for_clarification", F.lit(False)) & (F.trim(F.coalesce("overall_note", F.lit(""))) == ""), F.lit("a return for clarification needs a note")),
        ),
        lambda x: x.isNotNull(),
    )


def snapshot(fields: DataFrame, results: DataFrame, sessions: DataFrame, extracted_at: str) -> DataFrame:
    """fields (see reviewed) with the provenance and priority of the proposal (results), the session of their review and the
    priority that it leaves.

    sessions: report_id, method, reviewer_identity_verified, review_started_at (ISO, null: unknown, so no duration),
    returned_for_clarification, overall_note. Fields of sessions that may not be completed are left out. The digest of the
    report binds the review to its text: `approved` tells whether a text is still the one that was reviewed."""
    header = results.select(
        "report_id", "method", "source_report_digest", F.col("review_priority").alias("original_review_priority"),
        F.col("review_priority_reason").alias("original_review_priority_reason"),
        (F.col("document_provenance_json") if "document_provenance_json" in results.columns else F.lit("null")).alias("document_provenance_json"),
    )
    left = residual_priority(fields).select(
        "review_id", F.col("review_priority").alias("residual_review_priority"), F.col("review_priority_reason").alias("residual_review_priority_reason")
    )
    whole = fields.join(header.hint("merge"), ["report_id", "method"]).join(sessions.hint("merge"), ["report_id", "method"]).join(left.hint("merge"), "review_id")
    return _closed(whole, extracted_at)


def snapshot_of_drafts(drafted: DataFrame, session: dict[str, Column], reviewed_at: str, reviewer: str, extracted_at: str) -> DataFrame:
    """Like `snapshot` of the sound reviews among checked_drafts of whole fields (pipeline.fields), with sessions that follow from
    the report's id and method: a review is one group of its fields, so they are worked out once and shuffled once, without texts."""
    own = reviewed_columns(reviewed_at, reviewer)
    names = drafted.select(*own).columns
    rows = drafted.withColumn("__own", F.struct(*own)).withColumn("__sound", F.size("errors") == 0)
    reviews = pipeline.gathered(rows, kept=("__own", "__sound")).where("report_id is not null and method is not null").where(F.forall("kept", lambda k: k["__sound"]))
    level, reason = residual(F.transform("kept", lambda k: k["__own"]))
    whole = reviews.withColumns({
        "document_provenance_json": F.lit("null"), "residual_review_priority": level, "residual_review_priority_reason": reason, **session,
    }).withColumnsRenamed({"review_priority": "original_review_priority", "review_priority_reason": "original_review_priority_reason"})
    shared = ("source_report_digest", "original_review_priority", "original_review_priority_reason", "document_provenance_json", *session, "residual_review_priority", "residual_review_priority_reason")
    each = whole.select(*shared, F.explode("kept").alias("__k")).select(*shared, *[F.col(f"__k.__own.{c}").alias(c) for c in names])
    return _closed(each, extracted_at)


def _closed(rows: DataFrame, extracted_at: str) -> DataFrame:
    """Fields of sessions that may be completed, with how long the session took and what made the proposal."""
    seconds = F.unix_timestamp(F.try_to_timestamp("reviewed_at")) - F.unix_timestamp(F.try_to_timestamp("review_started_at"))
    return (
        rows.where(F.size(session_errors(F.col("reviewer_identity"))) == 0)
        .withColumn("review_duration_seconds", F.greatest(seconds, F.lit(0)).cast("double"))
        .withColumn("model_version", versions.version(F.col("method")))
        .withColumn("extraction_timestamp", F.lit(extracted_at))
    )


def approved(snapshots: DataFrame, reports: DataFrame) -> DataFrame:
    """reports (report_id, text) with approved: there is a review whose digest is that of the text; an edit revokes it."""
    digests = snapshots.select("report_id", F.col("source_report_digest").alias("__digest")).distinct().withColumn("approved", F.lit(True))
    named = reports.withColumn("__digest", F.concat(F.lit("sha256:"), F.sha2("text", 256)))
    return named.join(digests.hint("merge"), ["report_id", "__digest"], "left").withColumn("approved", F.coalesce("approved", F.lit(False))).drop("__digest")


def residual_priority(fields: DataFrame) -> DataFrame:
    """Priority that the reviewed fields leave, with the fields named in their order."""
    order = F.array_position(F.array(*map(F.lit, P.VARIABLES)), F.col("variable_name"))
    grouped = fields.groupBy("review_id", "report_id", "method").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "variable_name", "reviewed_status"))).alias("f"))
    level, reason = residual(F.col("f"))
    return grouped.select("review_id", "report_id", "method", level.alias("review_priority"), reason.alias("review_priority_reason"))


def residual(fields: Column) -> tuple[Column, Column]:
    """Level and reason of the priority that an array of reviewed fields, in the order of variables, leaves."""
    names = lambda keep: F.array_join(F.transform(F.filter(fields, keep), lambda x: F.replace(x["variable_name"], F.lit("_"), F.lit(" "))), ", ")
    high, other = (lambda x: x["reviewed_status"].isin(*HIGH)), (lambda x: ~x["reviewed_status"].isin(*HIGH) & (x["reviewed_status"] != "supported"))
    level = F.when(F.exists(fields, high), "high").when(F.exists(fields, other), "medium").otherwise("low")
    reason = (
        F.when(level == "high", F.concat(F.lit("Reviewer decisions leave unresolved high-impact fields: "), names(high), F.lit(".")))
        .when(level == "medium", F.concat(F.lit("Reviewer decisions retain non-routine documentation states: "), names(other), F.lit(".")))
        .otherwise("Reviewer decisions leave all four fields explicitly supported.")
    )
    return level, reason


def efficiency(log: DataFrame) -> DataFrame:
    """log (reviewer, report_id, action, seconds, returned) -> per reviewer: acceptance, median of the summed seconds of a
    report, reports returned, share of reports without an edit."""
    per = log.groupBy("reviewer", "report_id").agg(
        F.sum("seconds").alias("seconds"), F.count("*").alias("n"), F.count_if(F.col("action") == "accepted").alias("ok"),
        F.bool_and(F.col("action") == "accepted").alias("clean"), F.bool_or("returned").alias("returned"),
    )
    return per.groupBy("reviewer").agg(
        F.sum("n").alias("fields"), F.sum("ok").alias("accepted"), F.median("seconds").alias("median_seconds"), F.count_if("returned").alias("returned_reports"),
        F.count("*").alias("reports"), F.count_if("clean").alias("edit_free"),
    )


def corrections(log: DataFrame, variables: DataFrame) -> DataFrame:
    """Corrected and reviewed fields of each variable, also of those never reviewed."""
    n = log.groupBy("variable_name").agg(F.count_if(F.col("action") == "corrected").alias("corrected"), F.count("*").alias("reviewed"))
    out = variables.join(n, "variable_name", "left").fillna(0, ["corrected", "reviewed"])
    return out.withColumn("rate", F.when(F.col("reviewed") > 0, F.col("corrected") / F.col("reviewed")))


def disagreements(log: DataFrame) -> DataFrame:
    """Actions other than acceptance by how often they occur."""
    return log.where(F.col("action") != "accepted").groupBy("variable_name", "action").count().withColumnRenamed("count", "n").orderBy(F.desc("n"), "variable_name", "action")


def newest_first(audit: DataFrame, per: list[str], keep: int) -> DataFrame:
    """The latest `keep` audit records of each group; equal times in the order of appending."""
    w = Window.partitionBy(*per).orderBy(F.desc("timestamp"), "seq")
    return audit.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)


def searched(audit: DataFrame, needle: str, columns: list[str], **equal) -> DataFrame:
    """Audit records that hold a text in any of the columns and whose columns are among the values given (none: all)."""
    out = audit
    for c, values in equal.items():
        if values:
            out = out.where(F.col(c).isin(*values))
    return out.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lower(F.lit(needle)))) if needle else out


def progress(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("report_id", "method").agg(F.count_if(F.col("action") != "pending").alias("decided"), F.count("*").alias("fields"))


def case_status(reports: DataFrame, decisions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Completed if a snapshot exists, In progress if a decision was taken, else Needs review."""
    done = snapshots.select("report_id").distinct().withColumn("done", F.lit(True))
    begun = decisions.where(F.col("action") != "pending").select("report_id").distinct().withColumn("begun", F.lit(True))
    state = F.when(F.col("done"), "Completed").when(F.col("begun"), "In progress").otherwise("Needs review")
    return reports.select("report_id").join(done.hint("merge"), "report_id", "left").join(begun.hint("merge"), "report_id", "left").select("report_id", state.alias("case_status"))

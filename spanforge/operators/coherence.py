"""Coherence of saved reviews: every reviewed field and audit record in itself, the two against each other, and a review as a
whole. All checks are null-safe; the result names the broken rule, nothing is raised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import patterns as P
from spanforge.operators import validate
from spanforge.operators.extract import EVIDENCE

KEYS = ("review_id", "variable_name")
#: Columns that a reviewed field and its audit record share; (name in the field, name in the record).
SHARED = (
    ("report_id", "report_id"), ("method", "method"), ("audit_id", "audit_id"), ("original_value", "original_value"), ("original_status", "original_status"), ("original_evidence", "original_evidence"),
    ("original_alternatives", "original_alternatives"), ("review_action", "reviewer_action"), ("reviewed_value", "resulting_value"), ("reviewed_status", "resulting_status"),
    ("evidence", "resulting_evidence"), ("alternatives", "resulting_alternatives"), ("review_reason", "review_reason"), ("reviewed_at", "timestamp"), ("reviewer_identity", "reviewer_identity"),
)


def audit_records(fields: DataFrame) -> DataFrame:
    """The audit record of each reviewed field (review.reviewed)."""
    names = dict(SHARED)
    rest = [F.col(c).alias(names.get(c, c)) for c in fields.columns]
    return fields.select(*rest, F.when(F.col("review_action") == "corrected", F.col("reviewed_value")).alias("corrected_value"))


def _rules(action: Column, value: Column, status: Column, evidence: Column, alternatives: Column, reason: Column) -> dict[str, Column]:
    """What holds for a reviewed field as for its audit record."""
    same = lambda a, b: a.eqNullSafe(F.col(b))
    kept = same(value, "original_value") & same(status, "original_status") & same(evidence, "original_evidence") & same(alternatives, "original_alternatives")
    held = lambda state: value.isNull() & status.eqNullSafe(F.lit(state)) & (F.size(evidence) == 0)
    broken = validate.contract_violations(F.col("variable_name"), value, status, evidence, alternatives)
    return {
        "unknown action": ~F.coalesce(action.isin(*P.ACTIONS), F.lit(False)), "still pending": action == "pending", "no reason": F.coalesce(F.trim(reason) == "", F.lit(True)),
        "unknown variable": ~F.coalesce(F.col("variable_name").isin(*P.VARIABLES), F.lit(False)), "breaks the field schema": F.size(broken) > 0,
        "acceptance changes the proposal": (action == "accepted") & ~kept, "rejection keeps something": (action == "rejected") & ~held("unsupported"),
        "flag keeps something": (action == "flagged_for_review") & ~held("manual_review_required"),
    }


def _list(c: str, kind: str) -> Column:
    return F.coalesce(F.col(c), F.array()).cast(kind)


def _even(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Null and empty lists are the same."""
    kinds = {c: EVIDENCE if "evidence" in c else "array<string>" for c in names if "evidence" in c or "alternatives" in c}
    return rows.withColumns({c: _list(c, k) for c, k in kinds.items()})


def _told(rows: DataFrame, rules: dict[str, Column], what: str) -> DataFrame:
    each = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{what}: {name}")) for name, bad in rules.items()])
    return rows.select(*KEYS, F.explode(F.filter(each, lambda r: r.isNotNull())).alias("rule"))


def field_errors(fields: DataFrame) -> DataFrame:
    """(review_id, variable_name, rule) of reviewed fields that break a rule."""
    rows = _even(fields, tuple(a for a, _ in SHARED))
    c = F.col
    return _told(rows, _rules(c("review_action"), c("reviewed_value"), c("reviewed_status"), c("evidence"), c("alternatives"), c("review_reason")), "field")


def audit_errors(audit: DataFrame) -> DataFrame:
    """The same for audit records; a corrected value belongs to a correction and equals its result."""
    rows = _even(audit, tuple(b for _, b in SHARED))
    c = F.col
    rules = _rules(c("reviewer_action"), c("resulting_value"), c("resulting_status"), c("resulting_evidence"), c("resulting_alternatives"), c("review_reason"))
    fixed = c("reviewer_action") == "corrected"
    rules["corrected value is not the result"] = fixed & ~c("corrected_value").eqNullSafe(c("resulting_value"))
    rules["corrected value without a correction"] = ~F.coalesce(fixed, F.lit(False)) & c("corrected_value").isNotNull()
    return _told(rows, rules, "audit")


def review_errors(fields: DataFrame) -> DataFrame:
    """Reviews that don't hold each variable once (variable_name is null)."""
    names = fields.groupBy("review_id").agg(F.array_sort(F.collect_list("variable_name")).alias("have"), F.count("*").alias("n"))
    want = F.array_sort(F.array(*map(F.lit, sorted(P.VARIABLES))))
    bad = names.where((F.col("n") != len(P.VARIABLES)) | (F.col("have") != want))
    return bad.select("review_id", F.lit(None).cast("string").alias("variable_name"), F.lit("review: not each variable once").alias("rule"))


def reconciled(fields: DataFrame, audit: DataFrame) -> DataFrame:
    """(review_id, variable_name, rule) where the two exports disagree: a record or a field is missing, or a shared column differs.

    A full outer join on null-safe keys (as structs), so rows without a key meet each other too. Keys that occur more than once
    on a side are compared row by row, as often as they meet: their own duplicate rule (review_errors) names them."""
    key = lambda: F.struct(*[F.coalesce(F.col(k), F.lit("")).alias(k) for k in KEYS], *[F.col(k).isNull().alias(f"{k}_null") for k in KEYS])
    left = _even(fields, tuple(a for a, _ in SHARED)).select(key().alias("__key"), F.struct(*[F.col(a) for a, _ in SHARED]).alias("f"), F.struct(*KEYS).alias("fk"))
    right = _even(audit, tuple(b for _, b in SHARED)).select(key().alias("__key"), F.struct(*[F.col(b).alias(a) for a, b in SHARED]).alias("a"), F.struct(*KEYS).alias("ak"))
    both = left.join(right, "__key", "full").withColumn("__k", F.coalesce("fk", "ak"))
    rules = {"no audit record": F.col("a").isNull(), "no reviewed field": F.col("f").isNull()}
    for name, _ in SHARED:
        rules[f"{name} differs"] = F.col("a").isNotNull() & F.col("f").isNotNull() & ~F.col(f"f.{name}").eqNullSafe(F.col(f"a.{name}"))
    return _told(both.select("__k.*", "f", "a"), rules, "both")


def errors(fields: DataFrame, audit: DataFrame) -> DataFrame:
    """All that is incoherent in saved reviews; empty for sound ones."""
    return field_errors(fields).unionByName(audit_errors(audit)).unionByName(review_errors(fields)).unionByName(reconciled(fields, audit))

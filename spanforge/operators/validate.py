"""Fail-closed checks of fields against their report, and the documentation QA that follows.

All checks are expressions on the field's row (see extract.fields); only the summary of a report groups rows, and then the
text is no longer there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import patterns as P
from spanforge.functions import spans
from spanforge.operators import support
from spanforge.operators.extract import EVIDENCE, ISSUES, issue, some

LITERAL = lambda x: F.concat(F.lit("'"), x, F.lit("'"))
NO_ISSUES = F.array


def _none() -> Column:
    return F.array().cast(ISSUES)


def contract_violations(variable: Column, value: Column, status: Column, evidence: Column, alternatives: Column) -> Column:
    """Rules of the field schema that a field breaks; empty if it is sound."""
    n = F.size(evidence)
    spans_of = F.transform(evidence, lambda e: F.struct(e["start_offset"], e["end_offset"]))
    lowered = F.transform(alternatives, lambda a: F.lower(F.trim(a)))
    own = F.zip_with(alternatives, F.slice(evidence, 1, F.greatest(F.size(alternatives), F.lit(1))), lambda a, e: spans.let(support.value_pattern(variable, a), lambda p: support.supports_value(variable, a, p, e["text"], e["text"])))
    known = F.when(variable == P.PT, F.coalesce(value.isin(*P.CATEGORIES[P.PT]), F.lit(True))).when(variable == P.PN, F.coalesce(value.isin(*P.CATEGORIES[P.PN]), F.lit(True))).when(variable == P.SIZE, F.coalesce(value.rlike(r"^\d+(?:\.\d+)? cm$"), F.lit(True))).otherwise(F.lit(True))
    x = F.coalesce(value.isin("pTX", "pNX"), F.lit(False))
    allowed_x = F.coalesce(((variable == P.PT) & (value == "pTX")) | ((variable == P.PN) & (value == "pNX")), F.lit(False))
    rules = {
        "value without evidence": value.isNotNull() & (n == 0),
        "value required": status.isin("supported", "uncertain", "superseded") & value.isNull(),
        "value not allowed": status.isin("not_documented", "unsupported", "manual_review_required", "negated", "conflicting") & value.isNotNull(),
        "evidence required": status.isin("negated", "uncertain", "superseded", "cannot_be_assigned") & (n == 0),
        "only explicit pTX or pNX": (status == "cannot_be_assigned") & value.isNotNull() & ~allowed_x,
        "pTX or pNX cannot be assigned": x & (status != "cannot_be_assigned"),
        "not a canonical value": ~known,
        "alternatives only in conflicts": (status != "conflicting") & (F.size(alternatives) > 0),
        "too many alternatives": F.size(alternatives) > 8,
        "conflicts need two distinct spans": (status == "conflicting") & ((n < 2) | (F.size(F.array_distinct(spans_of)) != n)),
        "conflicts need an alternative for each span": (status == "conflicting") & ((F.size(alternatives) != n) | (F.size(F.array_distinct(lowered)) != F.size(alternatives))),
        "alternative not stated by its span": (status == "conflicting") & (F.size(alternatives) == n) & F.exists(own, lambda ok: ~ok),
    }
    return F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda r: r.isNotNull())


def checked(fields: DataFrame) -> DataFrame:
    """fields (text, variable_name, extracted_value, documentation_status, evidence, alternatives, ...) with violations,
    validate_issues, and the field as it stands after unsafe candidates have been withheld."""
    text, variable, value, status, ev = (F.col(c) for c in ("text", "variable_name", "extracted_value", "documentation_status", "evidence"))
    rows = fields.withColumn("evidence", F.coalesce("evidence", F.array().cast(EVIDENCE)))
    rows = rows.withColumn("violations", contract_violations(variable, value, status, ev, F.col("alternatives")))
    rows = rows.withColumn("__ctx", support.contexts_of(text, ev)).withColumn("__p", F.when(value.isNotNull(), support.value_pattern(variable, value)))
    missing = F.when(value.isNotNull() & (F.size(ev) == 0), issue("unsupported_evidence", variable, F.lit("A non-null candidate has no evidence span."), "critical", F.lit(None), "Abstain unless exact supporting evidence is supplied."))

    def exact(e: Column) -> Column:
        s, t, n = e["start_offset"], e["end_offset"], F.length(text)
        inside = (s >= 0) & (s < t) & (t <= n)
        there = spans.slice_of(text, s, t)
        return some(
            F.when(~text.contains(e["text"]), issue("unsupported_evidence", variable, F.concat(F.lit("Evidence is not an exact report substring: "), LITERAL(F.substring(e["text"], 1, 100)), F.lit(".")), "critical", F.lit(None), "Copy evidence verbatim from the submitted report.")),
            F.when(~inside, issue("offset_mismatch", variable, F.format_string("Evidence offsets are outside the report: start=%d, end=%d, report_length=%d.", s, t, n), "critical", F.lit(None), "Use zero-based, end-exclusive character offsets."))
            .when(there != e["text"], issue("evidence_mismatch", variable, F.concat(F.lit("Evidence offsets resolve to "), LITERAL(F.substring(there, 1, 50)), F.lit(", not "), LITERAL(F.substring(e["text"], 1, 50)), F.lit(".")), "critical", F.lit(None), "Recompute offsets against the unmodified report text.")),
        )

    applies = value.isNotNull() & (status != "negated") & ~((variable == P.PN) & (value == "pN0"))

    def denied(e: Column) -> Column:
        first = lambda around: spans.first_of(around, [P.I + p for p in P.NEGATED_LOCAL], support.quoted(value))
        found = spans.let(spans.statement(text, e["start_offset"], e["end_offset"]), first)
        return spans.shifted(found, spans.statement_start(text, e["start_offset"]))

    cue = F.exists("__ctx", lambda c: c.rlike(P.I + r"\b(?:no|negative|absence|not|concern)\b"))
    rows = rows.withColumn("__denied", F.when(applies & cue, F.get(F.filter(F.transform("evidence", denied), lambda s: s.isNotNull()), F.lit(0))))
    negated = F.when(F.col("__denied").isNotNull(), issue("negated", variable, F.lit("The proposed value is explicitly negated in its local context."), "high", F.array("__denied").cast(EVIDENCE), "Abstain and classify the field as negated."))
    stated = F.exists(F.zip_with(support.texts_of(ev), F.col("__ctx"), lambda e, c: support.supports_value(variable, value, F.col("__p"), e, c)), lambda x: x)
    rows = rows.withColumn("stated", F.coalesce(value.isNotNull() & stated, F.lit(False)))
    rows = rows.withColumn("__value_bad", F.coalesce((status != "superseded") & value.isNotNull() & (F.size(ev) > 0) & ~F.col("stated"), F.lit(False)))
    carried = support.supports_status(variable, status, value, F.col("__p"), support.texts_of(ev), F.col("__ctx"), F.col("alternatives"), F.col("stated"))
    rows = rows.withColumn("__status_bad", ~F.col("__value_bad") & ~carried)
    positive = F.col("__denied").isNull()
    value_issue = F.when(positive & F.col("__value_bad"), issue("unsupported_evidence", variable, F.concat(F.lit("The proposed value "), LITERAL(value), F.lit(" is not supported by its exact evidence in local context.")), "critical", ev, "Abstain or attach evidence that explicitly states the value for this variable in the current context."))
    status_issue = F.when(positive & F.col("__status_bad"), issue("unsupported_evidence", variable, F.concat(F.lit("The evidence does not support documentation status "), LITERAL(status), F.lit(" in local context.")), "critical", ev, "Correct the status or attach exact evidence with the required semantics."))
    found = F.concat(some(missing), F.coalesce(F.flatten(F.transform("evidence", exact)), _none()), some(negated, value_issue, status_issue))
    rows = rows.withColumn("validate_issues", found)
    critical = F.exists("validate_issues", lambda i: i["severity"] == "critical")
    denied_now = F.col("__denied").isNotNull()
    held = lambda c, bad, denied_value: F.when(F.col("__critical"), bad).when(denied_now, denied_value).otherwise(F.col(c))
    none = F.lit(None).cast("string")
    out = rows.withColumn("__critical", critical).withColumn("proposed_value", F.col("extracted_value")).withColumn("proposed_status", F.col("documentation_status"))
    return out.select(
        *[c for c in out.columns if c not in ("extracted_value", "documentation_status", "evidence", "alternatives", "notes") and not c.startswith("__")],
        held("extracted_value", none, none).alias("extracted_value"),
        held("documentation_status", F.lit("unsupported"), F.lit("negated")).alias("documentation_status"),
        F.when(~F.col("__critical") & denied_now, F.array("__denied").cast(EVIDENCE)).otherwise(F.col("evidence")).alias("evidence"),
        F.when(F.col("__critical") | denied_now, F.array().cast("array<string>")).otherwise(F.col("alternatives")).alias("alternatives"),
        held("notes", F.lit("Candidate removed because deterministic evidence validation failed."), F.lit("Candidate removed because it is explicitly negated.")).alias("notes"),
    )


def amendments(text: Column, sections: Column) -> Column:
    """The report-level issue that headings or addenda raise about revised documentation; null if none."""
    span = lambda s: F.struct(s["text"].alias("text"), s["start"].alias("start_offset"), s["stop"].alias("end_offset"))
    before = lambda s: F.exists(sections, lambda p: (p["kind"] == "preliminary") & (p["start"] < s["start"]))
    plain = F.transform(F.filter(sections, lambda s: s["kind"].isin("revised", "amended") | ((s["kind"] == "final") & before(s))), span)
    update = lambda s: spans.shifted(spans.first_span(spans.slice_of(text, s["start"], s["section_end"]), P.I + P.UPDATE), s["start"])
    added = F.flatten(F.transform(F.filter(sections, lambda s: s["kind"] == "addendum"), lambda s: F.when(update(s).isNotNull(), F.array(span(s), update(s))).otherwise(F.array().cast(EVIDENCE))))
    evidence = F.array_distinct(F.concat(plain.cast(EVIDENCE), added.cast(EVIDENCE)))
    text_ = "The report explicitly identifies preliminary, revised, amended, or corrected documentation."
    return F.when(F.size(evidence) > 0, issue("superseded", F.lit(None).cast("string"), F.lit(text_), "high", evidence, "Confirm the selected current value and retain older evidence in the audit trail."))


def with_qa(rows: DataFrame) -> DataFrame:
    """checked fields with qa_issues: those of extraction and validation, then what QA adds under a new type (not for the baseline)."""
    text, variable, value, status = (F.col(c) for c in ("text", "variable_name", "extracted_value", "documentation_status"))
    stage = variable.isin(P.PT, P.PN) & value.isNull() & text.rlike(P.I + P.SYNOPTIC)
    axis = F.when(variable == P.PT, "pT").otherwise("pN")
    absent = F.when(variable == P.PT, ~text.rlike(P.I + P.CANDIDATES[P.PT])).otherwise(~text.rlike(P.I + P.CANDIDATES[P.PN]))
    nodes, pnx = spans.first_span(text, P.I + P.QA_NO_NODES), spans.first_span(text, P.I + r"\bpNX\b")
    found = some(
        F.when(status == "conflicting", issue("conflicting", variable, F.lit("The extractor abstained because explicit alternatives conflict."), "high", F.col("evidence"), "Resolve the alternatives manually.")),
        F.when(status == "uncertain", issue("uncertain", variable, F.lit("The retained candidate is qualified by uncertainty language."), "medium", F.col("evidence"), "Review the candidate before acceptance.")),
        F.when(stage & absent, issue("ocr_quality", variable, F.concat(F.lit("A synoptic report is present, but no explicit "), axis, F.lit(" category was captured in the accepted text. The staging table may be incomplete.")), "high",
               F.array(spans.first_span(text, P.I + P.SYNOPTIC)), F.concat(F.lit("Compare the staging section with the page image and rerun OCR on the relevant page. Do not derive "), axis, F.lit(" from tumor size or node counts.")))),
        F.when((variable == P.PN) & nodes.isNotNull() & ((value == "pN0") | (status == "supported")), issue("conflicting", variable, F.lit("The extraction assigns a supported pN category although the report states that lymph nodes were not assessed."), "high", F.array(nodes), "Use cannot_be_assigned and do not infer pN0 from absent assessment.")),
        F.when((variable == P.PN) & pnx.isNotNull() & (value != "pNX"), issue("conflicting", variable, F.concat(F.lit("The report explicitly states pNX but the extraction returns "), LITERAL(value), F.lit(".")), "high", F.array(pnx), "Keep pNX distinct from pN0 and from not_documented.")),
    )
    rows = rows.withColumn("__found", found)
    types = F.transform("__before", lambda i: i["issue_type"])
    fresh = F.filter("__found", lambda i, n: ~F.array_contains(types, i["issue_type"]) & ~F.exists(F.slice(F.col("__found"), F.lit(1), n), lambda j: j["issue_type"] == i["issue_type"]))
    qa = F.when(F.col("method") == "baseline", F.col("__before")).otherwise(F.concat("__before", fresh))
    return without_repeats(rows).withColumn("qa_issues", qa).drop("__found", "__before")


def without_repeats(rows: DataFrame) -> DataFrame:
    """rows with __before: issues of extraction, then those of validation whose type and description are new."""
    known = F.transform("extract_issues", lambda i: F.struct(i["issue_type"].alias("t"), i["description"].alias("d")))
    key = lambda i: F.struct(i["issue_type"].alias("t"), i["description"].alias("d"))
    v = F.col("validate_issues")
    fresh = F.filter(v, lambda i, n: ~F.array_contains(known, key(i)) & ~F.array_contains(F.transform(F.slice(v, F.lit(1), n), key), key(i)))
    return rows.withColumn("__before", F.concat("extract_issues", fresh))


def priority(issues: Column, final: bool) -> tuple[Column, Column]:
    """Review priority and its reason from all issues of a report."""
    names = lambda cond: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(issues, cond), lambda i: F.coalesce(i["variable_name"], F.lit("report"))))), ", ")
    kind = lambda k: lambda i: i["issue_type"] == k
    severity = lambda s: lambda i: i["severity"] == s
    any_ = lambda cond: F.exists(issues, cond)
    text = lambda a, cond: F.concat(F.lit(a), names(cond), F.lit("."))
    rest = "Documentation requires review: " if final else "Documentation is incomplete or requires review: "
    level = F.when(F.size(issues) == 0, "low").when(any_(severity("critical")), "critical").when(any_(kind("conflicting")) | any_(kind("superseded")) | any_(severity("high")), "high").otherwise("medium")
    reason = (
        F.when(F.size(issues) == 0, "No documentation issues detected.")
        .when(any_(severity("critical")), "Critical evidence validation failure requires manual review.")
        .when(any_(kind("conflicting")), text("Conflicting documentation requires review: ", kind("conflicting")))
        .when(any_(kind("superseded")), "An explicit amendment or final revision supersedes older documentation.")
        .when(any_(severity("high")), text("High-impact documentation issue requires review: ", severity("high")))
        .when(any_(kind("uncertain")), text("Uncertain documentation requires review: ", kind("uncertain")))
        .otherwise(text(rest, lambda i: F.lit(True)))
    )
    return level, reason

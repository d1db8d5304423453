"""Scoring of methods against gold annotations.

Tables that grow with the reports are joined by sorting both sides (hint merge): by the size of their compressed files or
shuffles they look small enough to be broadcast, and would go whole through the driver and into every task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import patterns as P
from spanforge.operators import support
from spanforge.operators.extract import EVIDENCE

COUNTS = ("tp", "fp", "fn", "tn", "unsupported", "abstained", "evidence_correct", "evidence_total", "status_correct", "status_total")
#: Metric name -> (numerator, denominator, definition), in the order of the evaluation export.
METRICS = {
    "unsupported_extraction_rate": ("unsupported", "evidence_total", "Returned values without exact supporting evidence"),
    "overall_precision": ("tp", "returned", "Correct values among returned values"),
    "overall_recall": ("tp", "gold_values", "Correct values among gold values"),
    "overall_f1": (None, None, "Harmonic mean of precision and recall"),
    "coverage": ("covered", "fields", "Fields with a returned value"),
    "appropriate_abstention_rate": ("abstained_right", "abstain_expected", "Abstentions where gold has no value"),
    "false_positive_rate_undocumented": ("undocumented_fp", "undocumented", "Values returned for undocumented fields"),
    "documentation_status_accuracy": ("status_correct", "fields", "Status equal to gold status"),
    "exact_evidence_rate": ("evidence_correct", "evidence_total", "Returned values with exact supporting evidence"),
    "manual_review_referral_rate": ("referred", "reports", "Reports sent to manual review"),
    "manual_review_referral_precision": ("referral_tp", "referred", "Referred reports that gold refers too"),
    "manual_review_referral_recall": ("referral_tp", "referral_expected", "Gold referrals that were referred"),
    "schema_validity_rate": ("valid", "reports", "Reports with four sound, exactly anchored fields"),
}


def values_match(value: Column, gold: Column) -> Column:
    """Equal, equal letters and digits, or equal numbers of centimetres."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    cm = lambda c: F.lower(c).contains("cm")
    num = lambda c: F.regexp_extract(c, r"(\d+\.?\d*)", 1).try_cast("decimal(38,10)")
    equal = (value == gold) | (bare(value) == bare(gold)) | F.coalesce(cm(value) & cm(gold) & (num(value) == num(gold)), F.lit(False))
    return F.when(value.isNull() | gold.isNull(), value.isNull() & gold.isNull()).otherwise(equal)


def exact(text: Column, evidence: Column) -> Column:
    """There is evidence and all of it stands at its offsets."""
    ok = lambda e: (e["start_offset"] >= 0) & (e["start_offset"] < e["end_offset"]) & (e["end_offset"] <= F.length(text)) & (F.substring(text, e["start_offset"] + 1, e["end_offset"] - e["start_offset"]) == e["text"])
    return (F.size(evidence) > 0) & F.forall(evidence, ok)


def anchored(fields: DataFrame) -> DataFrame:
    """fields with exact_evidence and supported (the value follows from exact evidence). Checked fields (validate.checked) bring
    `stated` along; for others it is worked out here."""
    out = fields.withColumn("exact_evidence", exact(F.col("text"), F.col("evidence")))
    if "stated" not in fields.columns:
        ctx, ev = support.contexts_of(F.col("text"), F.col("evidence")), support.texts_of(F.col("evidence"))
        out = out.withColumn("__p", F.when(F.col("extracted_value").isNotNull(), support.value_pattern(F.col("variable_name"), F.col("extracted_value"))))
        states = F.exists(F.zip_with(ev, ctx, lambda e, c: support.supports_value(F.col("variable_name"), F.col("extracted_value"), F.col("__p"), e, c)), lambda x: x)
        out = out.withColumn("stated", states).drop("__p")
    return out.withColumn("supported", F.coalesce(F.col("extracted_value").isNotNull() & F.col("exact_evidence") & F.col("stated"), F.lit(False)))


def scored(fields: DataFrame, gold: DataFrame) -> DataFrame:
    """fields (report_id, method, variable_name, extracted_value, documentation_status, supported) joined with gold (report_id,
    variable_name, gold_value, gold_status): one flag for each count."""
    v, g = F.col("extracted_value"), F.col("gold_value")
    hit = values_match(v, g)
    return fields.join(gold.hint("merge"), ["report_id", "variable_name"]).select(
        "report_id", "method", "variable_name",
        (v.isNotNull() & g.isNotNull() & hit).alias("tp"),
        (v.isNotNull() & (g.isNull() | ~hit)).alias("fp"),
        (g.isNotNull() & (v.isNull() | ~hit)).alias("fn"),
        (v.isNull() & g.isNull()).alias("tn"),
        (v.isNotNull() & ~F.col("supported")).alias("unsupported"),
        v.isNull().alias("abstained"),
        (v.isNotNull() & F.col("supported")).alias("evidence_correct"),
        v.isNotNull().alias("evidence_total"),
        (F.col("documentation_status") == F.col("gold_status")).alias("status_correct"),
        F.lit(True).alias("status_total"),
        g.isNull().alias("abstain_expected"), (g.isNull() & v.isNull()).alias("abstained_right"),
        (F.col("gold_status") == "not_documented").alias("undocumented"), ((F.col("gold_status") == "not_documented") & v.isNotNull()).alias("undocumented_fp"),
    )


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision.isNotNull() & recall.isNotNull(), F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0)))


def by_variable(flags: DataFrame) -> DataFrame:
    """Counts and unrounded precision, recall and F1 of each method and variable."""
    return by_level(flags).where("level = 0").drop("level")


def by_level(flags: DataFrame) -> DataFrame:
    """Counts, precision, recall and F1 of each method and variable, and of each method over all variables (variable_name is
    null, level 1), in one aggregate over one shuffle."""
    sums = flags.rollup("method", "variable_name").agg(F.grouping_id().cast("int").alias("level"), *[F.count_if(c).alias(c) for c in COUNTS]).where("level < 3")
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select("*", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def referrals(reports: DataFrame, gold: DataFrame) -> DataFrame:
    """Counts of reports sent to review against those that gold sends (reports: report_id, method, manual_review_required, valid)."""
    expected = gold.groupBy("report_id").agg(F.bool_or("gold_review").alias("expected"))
    both = reports.join(expected.hint("merge"), "report_id", "left").withColumn("expected", F.coalesce("expected", F.lit(False)))
    sent = F.col("manual_review_required")
    return both.groupBy("method").agg(
        F.count("*").alias("reports"), F.count_if(sent).alias("referred"), F.count_if(sent & F.col("expected")).alias("referral_tp"),
        F.count_if(F.col("expected")).alias("referral_expected"), F.count_if("valid").alias("valid"),
    )


def overall(flags: DataFrame, reports: DataFrame, gold: DataFrame) -> DataFrame:
    """One row for each method: all counts of the metrics."""
    sums = flags.groupBy("method").agg(*[F.count_if(c).alias(c) for c in (*COUNTS, "abstain_expected", "abstained_right", "undocumented", "undocumented_fp")], F.count("*").alias("fields"))
    sums = sums.withColumn("returned", F.col("tp") + F.col("fp")).withColumn("gold_values", F.col("tp") + F.col("fn")).withColumn("covered", F.col("fields") - F.col("abstained"))
    return sums.join(referrals(reports, gold), "method")


def metrics(counts: DataFrame) -> DataFrame:
    """overall counts -> one row for each method and metric: numerator, denominator, unrounded rate, definition."""
    p, r = ratio(F.col("tp"), F.col("returned")), ratio(F.col("tp"), F.col("gold_values"))
    rows = []
    for n, (name, (a, b, text)) in enumerate(METRICS.items()):
        num = F.col(a).cast("long") if a else F.lit(None).cast("long")
        den = F.col(b).cast("long") if b else F.lit(None).cast("long")
        rate = ratio(num, den) if a else f1(p, r)
        rows.append(F.struct(F.lit(n).alias("ord"), F.lit(name).alias("metric"), num.alias("numerator"), den.alias("denominator"), rate.alias("rate"), F.lit(text).alias("definition")))
    return counts.select("method", F.inline(F.array(*rows)))


def compared(found: DataFrame, a: str = "evidence_first", b: str = "baseline") -> DataFrame:
    """metrics of two methods side by side with their difference."""
    wide = found.groupBy("metric", "ord").pivot("method", [a, b]).agg(F.first("rate"))
    return wide.withColumn("delta", F.col(a) - F.col(b)).orderBy("ord")


def changes(found: DataFrame, first: str = "evidence_first", base: str = "baseline") -> DataFrame:
    """One row: how four metrics differ between two methods, from rates rounded to four places; null where a rate is."""
    rate = lambda method, metric: F.max(F.when((F.col("method") == method) & (F.col("metric") == metric), F.round("rate", 4)))
    gain = lambda metric: F.round(rate(first, metric) - rate(base, metric), 4)
    return found.agg(
        F.round(rate(base, "unsupported_extraction_rate") - rate(first, "unsupported_extraction_rate"), 4).alias("unsupported_rate_reduction"),
        gain("overall_precision").alias("precision_improvement"), gain("overall_recall").alias("recall_change"), gain("coverage").alias("coverage_change"),
    )


COHORT_KEYS = ("report_id", "method")


def cohort_errors(results: DataFrame, gold: DataFrame, texts: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """(rule, report_id) of what keeps a cohort from being scored. results: report_id, method; gold: report_id, variable_name and, if
    there, cancer_type, gold_value, gold_status, evidence_text and offsets; texts: report_id, text and, if there, cancer_type;
    fields: results by field (report_id, method, variable_name).

    Coverage both ways, results and gold without text, repeated results, methods over different reports, missing or repeated gold fields,
    result fields that are not each variable once, gold cancer types that vary or differ from the report's, statuses whose value or evidence
    is missing or not allowed, evidence that is not where it says. Tables are aggregated by report before they are joined."""
    named = lambda df, *flags: df.select("report_id", F.explode(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags]), lambda x: x.isNotNull())).alias("rule"))
    have = gold.columns
    opt = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    status, value, said = opt("gold_status", "string"), opt("gold_value", "string"), opt("evidence_text", "string")
    n_methods = results.agg(F.countDistinct("method").alias("__methods"))
    r = results.groupBy("report_id").agg(F.count("*").alias("r_n"), F.countDistinct("method").alias("r_methods"))
    needs, bans = status.isin("supported", "uncertain", "superseded") & value.isNull(), status.isin("not_documented", "unsupported", "manual_review_required", "negated", "conflicting") & value.isNotNull()
    g = gold.groupBy("report_id").agg(
        F.count("*").alias("g_n"), F.countDistinct("variable_name").alias("g_v"), F.count_if(F.col("variable_name").isin(*P.VARIABLES)).alias("g_known"),
        F.countDistinct(opt("cancer_type", "string")).alias("g_cancers"), F.min(opt("cancer_type", "string")).alias("g_cancer"),
        F.bool_or(needs).alias("g_needs"), F.bool_or(bans).alias("g_bans"), F.bool_or(status.isin("negated", "uncertain", "superseded", "supported") & said.isNull()).alias("g_bare") if "evidence_text" in have else F.lit(False).alias("g_bare"),
    )
    t = texts.groupBy("report_id").agg(F.lit(True).alias("t"), F.min(F.col("cancer_type") if "cancer_type" in texts.columns else F.lit(None).cast("string")).alias("t_cancer"))
    whole = r.join(g.hint("merge"), "report_id", "full").join(t.hint("merge"), "report_id", "full").join(F.broadcast(n_methods))
    n = len(P.VARIABLES)
    flags = [
        ("result without gold", F.col("r_n").isNotNull() & F.col("g_n").isNull()), ("gold without result", F.col("g_n").isNotNull() & F.col("r_n").isNull()),
        ("result without text", F.col("r_n").isNotNull() & F.col("t").isNull()), ("gold without text", F.col("g_n").isNotNull() & F.col("t").isNull()),
        ("repeated result", F.col("r_n") > F.col("r_methods")), ("not a result of every method", F.col("r_methods") < F.col("__methods")),
        ("gold needs each variable once", (F.col("g_n") != n) | (F.col("g_v") != n) | (F.col("g_known") != n)), ("gold cancer types differ", F.col("g_cancers") > 1),
        ("gold cancer type is not the report's", F.col("g_cancer") != F.col("t_cancer")), ("gold status needs a value", F.col("g_needs")), ("gold status allows no value", F.col("g_bans")),
        ("gold status needs evidence", F.col("g_bare")),
    ]
    found = named(whole, *flags)
    if fields is not None:
        per = fields.groupBy("report_id", "method").agg(F.count("*").alias("n"), F.countDistinct("variable_name").alias("v"))
        found = found.unionByName(named(per, ("result needs each variable once", (F.col("n") != n) | (F.col("v") != n))))
    if "evidence_text" in have:
        there = F.substring(F.col("text"), F.col("evidence_start_offset") + 1, F.col("evidence_end_offset") - F.col("evidence_start_offset"))
        wrong = gold.where("evidence_text is not null").select("report_id", "evidence_text", "evidence_start_offset", "evidence_end_offset").join(texts.select("report_id", "text").hint("merge"), "report_id").where(~F.coalesce(there == F.col("evidence_text"), F.lit(False)))
        found = found.unionByName(wrong.select("report_id", F.lit("gold evidence is not at its offsets").alias("rule")).distinct())
    return found.select("rule", "report_id")


def agreement(flat_results: DataFrame) -> DataFrame:
    """Per report and field: does every method give the same value and status? Nulls are equal."""
    same = F.countDistinct(F.struct(F.coalesce("extracted_value", F.lit("\0")), "documentation_status")) == 1
    return flat_results.groupBy("report_id", "variable_name").agg(same.alias("agree"), F.count("*").alias("n_methods"))


def matrix(flat_results: DataFrame) -> DataFrame:
    """Per report and field, value and status of each method side by side."""
    cell = F.concat_ws(" / ", F.coalesce("extracted_value", F.lit("-")), "documentation_status")
    return flat_results.groupBy("report_id", "variable_name").pivot("method", list(P.METHODS)).agg(F.first(cell))


def per_field(fields: DataFrame, gold: DataFrame) -> DataFrame:
    """Each field held against its gold annotation: has_evidence, value_correct, status_correct and evidence_valid.

    Evidence is valid if each span contains the gold span or lies in it and its wording carries the status. Fields without
    evidence, or without gold, have a null there; evidence where gold has none is not valid. Fields without gold are wrong."""
    marks = ["gold_value", "gold_status", "evidence_text", "evidence_start_offset", "evidence_end_offset"]
    rows = fields.join(gold.select("report_id", "variable_name", *marks, F.lit(True).alias("__gold")).hint("merge"), ["report_id", "variable_name"], "left")
    v, text, ev = F.col("extracted_value"), F.col("text"), F.coalesce("evidence", F.array().cast(EVIDENCE))
    rows = rows.withColumn("__p", F.when(v.isNotNull(), support.value_pattern(F.col("variable_name"), v)))
    carries = support.supports_status(
        F.col("variable_name"), F.col("documentation_status"), v, F.col("__p"), support.texts_of(ev), support.contexts_of(text, ev), F.coalesce("alternatives", F.array().cast("array<string>"))
    )
    sound = F.when(exact(text, ev), carries).otherwise(F.col("documentation_status") == "not_documented")
    a, b = F.col("evidence_start_offset"), F.col("evidence_end_offset")
    nested = F.forall(ev, lambda e: ((a <= e["start_offset"]) & (e["end_offset"] <= b)) | ((e["start_offset"] <= a) & (b <= e["end_offset"])))
    there, known = F.size(ev) > 0, F.coalesce(F.col("__gold"), F.lit(False))
    unmarked = F.col("evidence_text").isNull() | a.isNull() | b.isNull()
    valid = F.when(known & there & unmarked, False).when(known & there & (F.col("evidence_text") != ""), nested & sound)
    return rows.select(
        "report_id", "method", "variable_name", "extracted_value", "documentation_status", there.alias("has_evidence"),
        (known & values_match(v, F.col("gold_value"))).alias("value_correct"),
        (known & F.coalesce(F.col("documentation_status") == F.col("gold_status"), F.lit(False))).alias("status_correct"), valid.alias("evidence_valid"),
    )

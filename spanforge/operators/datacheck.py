"""Checks of an annotated data set: reports, gold annotations and the annotation template, each against its rules.

Rules of a row are expressions on that row, so a table is read once and its failures come out of one generator; rules over
several rows (unique keys, coverage, expected spot values) are grouped or joined. The result is a table (rule, subject): nothing is collected,
and a data set of any size can be checked. `counted` also counts the failures of each rule while they are written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spanforge.functions import patterns as P

# Fixed values.
WATERMARK = "SYNTHETIC DEMONSTRATION REPORT — NO REAL PATIENT DATA"
SCENARIOS = ("complete", "no_nodes_cannot_be_assigned", "pn_not_documented", "explicit_pnx", "amended", "conflicting", "uncertain", "negated")
CANCERS = ("LUAD", "LUSC")
IDENTIFIER = r"(?iU)\b(?:patient\s+name|medical\s+record(?:\s+number)?|mrn|date\s+of\s+birth|dob)\b"
SPOT = (
    ("complete", P.PN, "pN0", "supported"), ("no_nodes_cannot_be_assigned", P.PN, "", "cannot_be_assigned"), ("pn_not_documented", P.PN, "", "not_documented"),
    ("explicit_pnx", P.PN, "pNX", "cannot_be_assigned"), ("amended", P.SIZE, "4.1 cm", "supported"), ("amended", P.PT, "pT2b", "supported"),
    ("negated", P.HISTOLOGY, "", "negated"),
)

REPORT_RULES = (
    "report: id", "report: cancer type", "report: not marked synthetic", "report: no scenario", "report: description", "report: watermark", "report: identifier label",
)
GOLD_RULES = (
    "gold: unknown report", "gold: variable", "gold: status", "gold: review flag", "gold: cancer type", "gold: offsets are no integers",
    "gold: offsets outside the text", "gold: evidence is not at its offsets", "gold: offsets without evidence", "gold: evidence missing",
)
GROUP_RULES = (
    "report: duplicate id", "report: coverage of variables", "gold: duplicate key", "spot: value", "spot: status", "template: variables", "reports: count",
    "reports: scenarios", "gold: count", "template: count",
)


def _failed(rows: DataFrame, subject: Column, rules: dict[str, Column]) -> DataFrame:
    """(rule, subject) of the rules that are true on a row; a null rule holds."""
    each = F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()])
    return rows.select(F.explode(F.filter(each, lambda r: r.isNotNull())).alias("rule"), subject.alias("subject"))


def report_errors(reports: DataFrame, prefix: str = "SYN-", scenarios: tuple = SCENARIOS, count: int | None = None) -> DataFrame:
    """reports (report_id, cancer_type, is_synthetic, scenario, description, text). Null text or id breaks its rule; ids that occur
    n times are n - 1 duplicates. An empty table lacks every scenario."""
    no = lambda c: F.coalesce(~c, F.lit(True))
    subject = F.coalesce("report_id", F.lit("null"))
    text = F.col("text")
    own = _failed(reports, subject, dict(zip(REPORT_RULES, (
        no(F.startswith("report_id", F.lit(prefix))), no(F.col("cancer_type").isin(*CANCERS)), no(F.col("is_synthetic")), F.col("scenario").isNull(),
        no(F.contains(F.lower("description"), F.lit("synthetic"))), no(F.startswith(text, F.lit(WATERMARK))), text.rlike(IDENTIFIER),
    ))))
    twice = reports.where("report_id is not null").groupBy("report_id").agg(F.count("*").alias("n")).where("n > 1")
    double = twice.select(F.lit("report: duplicate id").alias("rule"), F.explode(F.transform(F.sequence(F.lit(2), "n"), lambda i: F.col("report_id"))).alias("subject"))
    want = F.array_sort(F.array(*map(F.lit, sorted(scenarios))))
    totals = reports.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("scenario")).alias("have"))
    rules = {"reports: scenarios": F.col("have") != want}
    if count is not None:
        rules["reports: count"] = F.col("n") != count
    return own.unionByName(double).unionByName(_failed(totals, F.lit("all"), rules))


def gold_errors(gold: DataFrame, reports: DataFrame, spot: tuple = SPOT, count: int | None = None) -> DataFrame:
    """gold: raw text columns of an annotation file (report_id, cancer_type, variable_name, gold_value, evidence_text, evidence_start_offset,
    evidence_end_offset, documentation_status, manual_review_required). Null and empty mean the same. Every report needs each
    variable once; spot values are looked for in the annotations of all reports of their scenario."""
    raw = ("report_id", "cancer_type", "variable_name", "gold_value", "evidence_text", "evidence_start_offset", "evidence_end_offset", "documentation_status", "manual_review_required")
    rows = gold.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in raw])
    # one row a report id, and texts only where evidence is to be found in them
    known = reports.groupBy("report_id").agg(F.first("cancer_type").alias("__cancer"), F.first("scenario").alias("__scenario"), F.max("text").alias("__text"), F.lit(True).alias("__known"))
    rows = rows.join(known.hint("merge"), "report_id", "left")
    start, end = F.col("evidence_start_offset").try_cast("int"), F.col("evidence_end_offset").try_cast("int")
    there, evidence = F.col("__known").isNotNull(), F.col("evidence_text")
    ints = start.isNotNull() & end.isNotNull()
    inside = ints & (0 <= start) & (start < end) & (end <= F.length(F.coalesce("__text", F.lit(""))))
    subject = F.concat_ws("/", "report_id", "variable_name")
    own = _failed(rows, subject, dict(zip(GOLD_RULES, (
        ~there, ~F.col("variable_name").isin(*P.VARIABLES), ~F.col("documentation_status").isin(*P.STATUSES), ~F.col("manual_review_required").isin("True", "False"),
        there & ~F.col("cancer_type").eqNullSafe(F.col("__cancer")), there & (evidence != "") & ~ints, there & (evidence != "") & ints & ~inside,
        there & (evidence != "") & inside & (F.substring(F.col("__text"), start + 1, end - start) != evidence),
        there & (evidence == "") & ((F.col("evidence_start_offset") != "") | (F.col("evidence_end_offset") != "")),
        there & (evidence == "") & (F.col("documentation_status") != "not_documented"),
    ))))
    keys = rows.groupBy("report_id", "variable_name").agg(F.count("*").alias("n"))
    double = keys.where("n > 1").select(F.lit("gold: duplicate key").alias("rule"), F.explode(F.transform(F.sequence(F.lit(2), "n"), lambda i: subject)).alias("subject"))
    has = keys.groupBy("report_id").agg(F.array_sort(F.collect_set("variable_name")).alias("__have"))
    lacking = known.select("report_id").where("report_id is not null").join(has.hint("merge"), "report_id", "left")
    covered = F.coalesce(F.col("__have") == F.array_sort(F.array(*map(F.lit, sorted(P.VARIABLES)))), F.lit(False))
    coverage = _failed(lacking, F.col("report_id"), {"report: coverage of variables": ~covered})
    parts = [own, double, coverage]
    if spot:
        wanted = rows.sparkSession.createDataFrame(list(spot), "__scenario string, variable_name string, value string, status string")
        found = wanted.join(rows.select("__scenario", "variable_name", "gold_value", "documentation_status"), ["__scenario", "variable_name"], "left")
        parts.append(_failed(found, F.concat_ws("/", "__scenario", "variable_name"), {
            "spot: value": ~F.coalesce(F.col("gold_value") == F.col("value"), F.lit(False)), "spot: status": ~F.coalesce(F.col("documentation_status") == F.col("status"), F.lit(False)),
        }))
    if count is not None:
        parts.append(_failed(rows.agg(F.count("*").alias("n")), F.lit("all"), {"gold: count": F.col("n") != count}))
    return reduce(DataFrame.unionByName, parts)


def template_errors(template: DataFrame) -> DataFrame:
    """template (variable_name, ...): one row for each variable."""
    n = template.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("variable_name")).alias("have"))
    want = F.array_sort(F.array(*map(F.lit, sorted(P.VARIABLES))))
    return _failed(n, F.lit("template"), {"template: count": F.col("n") != len(P.VARIABLES), "template: variables": F.col("have") != want})


def errors(reports: DataFrame, gold: DataFrame, template: DataFrame | None = None, *, n_reports: int | None = None, n_gold: int | None = None,
           scenarios: tuple = SCENARIOS, spot: tuple = SPOT, prefix: str = "SYN-") -> DataFrame:
    """(rule, subject) of everything that is wrong with a data set; empty for a sound one."""
    out = report_errors(reports, prefix, scenarios, n_reports).unionByName(gold_errors(gold, reports, spot, n_gold))
    return out.unionByName(template_errors(template)) if template is not None else out


def counted(found: DataFrame, name: str = "datacheck") -> tuple[DataFrame, Observation]:
    """The errors, and an observation that holds the failures of each rule (and in all) once they have been written or counted."""
    seen = Observation(name)
    counts = [F.count_if(F.col("rule") == r).alias(r) for r in (*REPORT_RULES, *GOLD_RULES, *GROUP_RULES)]
    return found.observe(seen, F.count(F.lit(1)).alias("failures"), *counts), seen

import pytest
from pyspark.sql import functions as F

from spanforge.functions import patterns as P
from spanforge.functions import text as T
from spanforge.operators import evaluate, triage
from tests.test_parts import FIELD, field

H, S, PT, PN = P.VARIABLES
ROW = "report_id string, method string, variable_order int, variable_name string, extracted_value string, documentation_status string, notes string"


def test_reasons_and_order(spark):
    made = [
        ("a", "m", 1, H, "x", "supported", None), ("a", "m", 2, S, None, "not_documented", ""), ("a", "m", 3, PT, "pT1", "supported", "Candidate Withheld here"),
        ("a", "m", 4, PN, "pN0", "supported", ""),
    ]
    other = [("a", "n", 1, H, None, "supported", ""), ("a", "n", 4, PN, "pN0", "supported", "")]
    fields = spark.createDataFrame(made, ROW)
    decisions = spark.createDataFrame([("a", "m", PT, "corrected"), ("a", "m", PN, "accepted")], "report_id string, method string, variable_name string, action string")
    rows = triage.triaged(fields.unionByName(spark.createDataFrame(other, ROW)), decisions).where("method = 'm'")
    got = {r["variable_name"]: (r["review_place"], r["triage_reasons"]) for r in rows.collect()}
    assert got == {
        H: (1, [triage.DISAGREE]), S: (2, ["Missing or unassignable documentation"]), PT: (3, [triage.WEAK, triage.CORRECTING]), PN: (4, []),
    }


def test_weak_notes_do_not_repeat_the_reason(spark):
    fields = spark.createDataFrame([("a", "m", 1, H, "x", "uncertain", "not decisive")], ROW)
    assert triage.triaged(fields).head()["triage_reasons"] == [triage.WEAK]


@pytest.mark.parametrize(("have", "wish", "want"), [(["baseline", "ml"], "ml", "ml"), (["baseline", "evidence_first"], "ml", "evidence_first"), (["ml", "baseline"], None, "baseline"), ([], "ml", "ml"), ([], None, "evidence_first")])
def test_queue(spark, have, wish, want):
    ids = spark.createDataFrame([("a",)], "report_id string")
    pairs = "report_id string, method string"
    found, preferred = spark.createDataFrame([("a", m) for m in have], pairs), spark.createDataFrame([("a", wish)] if wish else [], pairs)
    assert triage.queue(ids, found, preferred).head()["queue_method"] == want


def test_filters_and_audit(spark):
    issues = spark.createDataFrame([("high", "missing"), ("low", "missing"), ("high", "negated")], "severity string, issue_type string")
    assert triage.issues_shown(issues).count() == 3 and triage.issues_shown(issues, ("high",)).count() == 2 and triage.issues_shown(issues, ("high",), ("missing",)).count() == 1
    audit = spark.createDataFrame([("r1", 1), ("r1", 2), ("r2", 3)], "review_id string, seq int")
    assert triage.audit_of(audit, spark.createDataFrame([("r1",), ("r1",)], "review_id string")).count() == 2


def test_fields_against_gold(spark):
    text = "Tumor size: 3.2 cm. pT2a. pN0. Adenocarcinoma."
    rows = [field(text, S, "3.2 cm", "supported", ["Tumor size: 3.2 cm"]), field(text, PT, "pT2a", "supported", ["pT2a"]), field(text, PN, "pN0", "supported", ["pN0"]), field(text, H, None, "not_documented", [])]
    at = text.find("3.2 cm")
    gold = [("r", S, "3.2cm", "supported", "3.2 cm", at, at + 6), ("r", PT, "pT2b", "supported", "pT2a. pN0", text.find("a. pN0"), text.find(". Adeno")), ("r", PN, "pN0", "uncertain", None, None, None)]
    schema = "report_id string, variable_name string, gold_value string, gold_status string, evidence_text string, evidence_start_offset int, evidence_end_offset int"
    got = {r["variable_name"]: (r["has_evidence"], r["value_correct"], r["status_correct"], r["evidence_valid"]) for r in evaluate.per_field(spark.createDataFrame(rows, FIELD), spark.createDataFrame(gold, schema)).collect()}
    assert got == {S: (True, True, True, True), PT: (True, False, True, False), PN: (True, True, False, False), H: (False, False, False, None)}


def test_labels(spark):
    rows = spark.createDataFrame([(PN, "pN0", "supported"), (PN, "pNX", "cannot_be_assigned"), (PN, None, "not_documented"), (PN, "pN1", "supported"), (S, None, "not_documented")], "v string, x string, s string")
    got = [r[0] for r in rows.select(triage.nodal_note(F.col("v"), F.col("x"), F.col("s"))).collect()]
    assert got == [triage.PN0_NOTE, triage.PNX_NOTE, triage.NO_PN_NOTE, None, None]
    names = spark.createDataFrame([(S,), ("lymph_node",)], "v string").select(triage.variable_label(F.col("v"))).collect()
    assert [r[0] for r in names] == ["Tumor size", "Lymph Node"]


def test_changes_between_methods(spark):
    rates = {"unsupported_extraction_rate": (0.2, 0.05), "overall_precision": (0.33333, 0.66667), "overall_recall": (None, 0.5), "coverage": (0.9, 0.8)}
    rows = [(m, k, v[i]) for k, v in rates.items() for i, m in enumerate(("baseline", "evidence_first"))]
    assert tuple(evaluate.changes(spark.createDataFrame(rows, "method string, metric string, rate double")).head()) == (0.15, 0.3334, None, -0.1)


def test_durations_and_sizes(spark):
    rows = spark.createDataFrame([(None, 256), (59.5, 1024), (0.5, 1 << 20), (125.4, 1572864)], "s double, n long")
    assert [tuple(r) for r in rows.select(T.duration(F.col("s")), T.file_size(F.col("n"))).collect()] == [("N/A", "0.2 KB"), ("1m 00s", "1.0 KB"), ("0s", "1.0 MB"), ("2m 05s", "1.5 MB")]

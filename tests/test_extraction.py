import pytest

from spanforge.functions import patterns as P
from spanforge.operators import pipeline

H, S, T, N = P.VARIABLES
CLEAN = "FINAL DIAGNOSIS:\n- Invasive adenocarcinoma.\n- Tumor size: 2.4 cm in greatest dimension.\n- Pathological T category: pT1c.\n- Pathological N category: pN0."
CASES = {
    "clean": (CLEAN, {H: ("supported", "Invasive adenocarcinoma"), S: ("supported", "2.4 cm"), T: ("supported", "pT1c"), N: ("supported", "pN0")}, "low"),
    "silent": ("Nothing of interest was found in this small sample.", {H: ("not_documented", None), N: ("not_documented", None)}, "high"),
    "revised": (
        "PRELIMINARY DIAGNOSIS:\nTumor size: 2.0 cm. pT1b\n\nREVISED FINAL DIAGNOSIS:\nSquamous cell carcinoma.\nTumor size: 5.1 cm. pT3, pN1",
        {S: ("supported", "5.1 cm"), T: ("supported", "pT3"), N: ("supported", "pN1")}, "high",
    ),
    "unrelated addendum": ("FINAL DIAGNOSIS: pT1a\nADDENDUM: molecular results follow. pT2", {T: ("conflicting", None)}, "high"),
    "update addendum": ("FINAL DIAGNOSIS: pT1a\nADDENDUM: the stage is revised. The category is pT2.", {T: ("supported", "pT2")}, "high"),
    "inline": ("Pathological T category: pT2a (amended from pT1c).", {T: ("supported", "pT2a")}, "high"),
    "negated": ("No evidence of squamous cell carcinoma is identified.", {H: ("negated", None)}, "high"),
    "uncertain": ("Tumor size: approximately 3.1 cm in total.", {S: ("uncertain", "3.1 cm")}, "high"),
    "favored": ("Invasive adenocarcinoma is favored here.", {H: ("unsupported", None)}, "critical"),
    "margin": ("The tumor measures 2 cm. The margin is 0.4 cm from the lesion margin.", {}, None),
    "pnx": ("Pathological N category: pNX.", {N: ("cannot_be_assigned", "pNX")}, "high"),
    "nodes": ("No regional lymph nodes were submitted.", {N: ("cannot_be_assigned", None)}, "high"),
    "multi": ("Tumor size: 3.3 x 2.5 x 1.0 cm.", {S: ("supported", "3.3 cm")}, "high"),
    "upper": ("DIAGNOSIS: INVASIVE ADENOCARCINOMA, PT2A, PN0", {H: ("supported", "Invasive adenocarcinoma"), T: ("supported", "pT2a"), N: ("supported", "pN0")}, "medium"),
    "astral": ("\U0001F600\U0001F600 pT3 here\n", {T: ("supported", "pT3")}, "high"),
    "boundary": ("pT2 and 13 cm tumor", {T: ("supported", "pT2"), S: ("supported", "13 cm")}, "high"),
    "empty": ("", {}, None),
    "negated stage": ("no tumor seen, pN0", {N: ("unsupported", None)}, "critical"),
}


@pytest.fixture(scope="module")
def results(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "report_id string, text string")
    return {r["report_id"]: r for r in pipeline.results(df).collect()}


@pytest.mark.parametrize("name", CASES)
def test_case(results, name):
    text, want, priority = CASES[name]
    row = results[name]
    got = {v["variable_name"]: v for v in row["variables"]}
    assert list(got) == list(P.VARIABLES)
    for variable, (status, value) in want.items():
        assert (got[variable]["documentation_status"], got[variable]["extracted_value"]) == (status, value)
    if priority:
        assert row["review_priority"] == priority and row["manual_review_required"] == (priority != "low")
    for v in row["variables"]:
        for e in v["evidence"]:
            assert text[e["start_offset"] : e["end_offset"]] == e["text"]


def test_empty_text_is_rejected_not_fatal(results):
    assert "empty text" in results["empty"]["reject_reasons"] and not results["clean"]["reject_reasons"]


def test_unstated_conflict_is_rejected(spark):
    text = "maximum tumor dimension 3.2 cm. gross section records 4.0 cm"
    row = pipeline.results(spark.createDataFrame([("a", text)], "report_id string, text string")).head()
    assert row["reject_reasons"] == ["alternative not stated by its span"]


def test_issues_are_not_repeated(results):
    for r in results.values():
        keys = [(i["issue_type"], i["variable_name"], i["description"]) for i in r["qa_issues"]]
        assert len(keys) == len(set(keys))


def test_baseline_abstains_where_revision_is_needed(spark):
    df = spark.createDataFrame([("r", CASES["revised"][0]), ("c", CLEAN)], "report_id string, text string")
    got = {(r["report_id"], r["variable_name"]): r for r in pipeline.fields(df, "baseline").collect()}
    assert got["r", S]["documentation_status"] == "conflicting" and got["r", S]["alternatives"] == ["2.0 cm", "5.1 cm"]
    assert got["c", N]["extracted_value"] == "pN0"
    with pytest.raises(ValueError):
        pipeline.fields(df, "other")


def test_plan_shuffles_fields_once_and_without_the_text(spark):
    df = spark.createDataFrame([("c", CLEAN)], "report_id string, text string")
    plan = pipeline.results(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Scan") == 1 and "BatchEvalPython" not in plan

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from spanforge.functions import patterns as P
from spanforge.functions import text as T
from spanforge.operators import evaluate, pages, pipeline, review, validate
from spanforge.sources import reports, sinks, uploads
from spanforge.streaming import reports as stream

H, S, PT, PN = P.VARIABLES


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).head()[0]


def test_sanitizer(spark):
    assert one(spark, " a\r\nb \t\r\x07ć \n\n", T.sanitized) == "a\nb\nć".replace("ć", "ć")
    assert one(spark, "short", T.length_error).startswith("Report text must contain") and one(spark, "x" * 20, T.length_error) is None
    assert "100,000" in one(spark, "x" * 100_001, T.length_error)


def test_identifiers(spark):
    text = "Patient name: [REDACTED]\nMRN: 123\n  DOB:  n/a\nmedical record number : 5"
    assert one(spark, text, T.identifier_labels) == ["medical record number"]
    assert one(spark, "patient name: A. B.", T.identifier_labels) == ["patient name"]


def test_quality(spark):
    assert one(spark, "", T.quality)["label"] == "Poor"
    assert one(spark, "plain words " * 40, T.quality)["label"] == "Good"
    assert one(spark, "?? !! ** " * 30, T.quality)["label"] == "Poor"
    assert "continuation" in one(spark, "SYNOPTIC REPORT " + "text " * 60 + "\npTNM:", T.quality)["reasons"][0]


def test_spreadsheet_and_names(spark):
    assert one(spark, " =1+1", T.spreadsheet_safe) == "' =1+1" and one(spark, "a=1", T.spreadsheet_safe) == "a=1"
    assert one(spark, "..a b/c..", T.safe_filename) == "a_b_c" and one(spark, "///", T.safe_filename) == "report"
    assert one(spark, 125.0, T.duration, "double") == "2m 05s"


FIELD = "report_id string, method string, text string, variable_name string, extracted_value string, documentation_status string, evidence array<struct<text:string,start_offset:int,end_offset:int>>, alternatives array<string>, notes string, extract_issues array<struct<issue_type:string,variable_name:string,description:string,severity:string,evidence:array<struct<text:string,start_offset:int,end_offset:int>>,suggestion:string>>"


def field(text, variable, value, status, quotes, alternatives=(), shift=0):
    return ("r", "evidence_first", text, variable, value, status, [(q, text.find(q) + shift, text.find(q) + len(q) + shift) for q in quotes], list(alternatives), "", [])


def test_validator(spark):
    text = "Tumor size: 3.2 cm. The margin is 0.5 cm. Prior pT1a. pT2a, pN0. Adenocarcinoma is pending. pT2a was amended to pT3. Not pN1."
    rows = [
        (field(text, S, "3.2 cm", "supported", ["Tumor size: 3.2 cm"]), None), (field(text, S, "3.2 cm", "supported", []), "unsupported_evidence"),
        (field(text, S, "3.2 cm", "supported", ["Tumor size: 3.2 cm"], shift=1), "evidence_mismatch"), (field(text, S, "3.2 cm", "supported", ["Tumor size: 3.2 cm"], shift=900), "offset_mismatch"),
        (field(text, S, "0.5 cm", "supported", ["0.5 cm"]), "unsupported_evidence"), (field(text, S, "2 cm", "supported", ["3.2 cm"]), "unsupported_evidence"),
        (field(text, PT, "pT1a", "supported", ["pT1a"]), "unsupported_evidence"), (field(text, PN, "pN0", "supported", ["pN0"]), None), (field(text, PN, "pN1", "supported", ["pN1"]), "negated"),
        (field(text, H, "Adenocarcinoma", "supported", ["Adenocarcinoma"]), "unsupported_evidence"), (field(text, H, "Adenocarcinoma", "uncertain", ["Adenocarcinoma"]), None),
        (field(text, PT, None, "not_documented", []), None),
    ]
    df = spark.createDataFrame([(*r, i) for i, (r, _) in enumerate(rows)], FIELD + ", i int")
    for r in validate.checked(df).orderBy("i").collect():
        found, want = [x["issue_type"] for x in r["validate_issues"]], rows[r["i"]][1]
        assert (found == []) if want is None else (want in found), (r["i"], found)
        if want == "negated":
            assert (r["documentation_status"], r["extracted_value"]) == ("negated", None)
        elif want:
            assert (r["documentation_status"], r["extracted_value"]) == ("unsupported", None)


def test_contract(spark):
    ok = ("pT1a", "supported", 1)
    cases = [(ok, []), (("pT9", "supported", 1), ["not a canonical value"]), ((None, "supported", 0), ["value required"]), (("pTX", "supported", 1), ["pTX or pNX cannot be assigned"]), (("pTX", "cannot_be_assigned", 1), []), (("pT1", "negated", 1), ["value not allowed"]), ((None, "negated", 0), ["evidence required"])]
    df = spark.createDataFrame([(i, PT, v, s, [("e", k, k + 1) for k in range(n)], []) for i, ((v, s, n), _) in enumerate(cases)], "i int, v string, x string, s string, e array<struct<text:string,start_offset:int,end_offset:int>>, a array<string>")
    got = df.select("i", validate.contract_violations(F.col("v"), F.col("x"), F.col("s"), F.col("e"), F.col("a")).alias("bad")).orderBy("i").collect()
    assert [r["bad"] for r in got] == [w for _, w in cases]


def test_wrong_values_count_twice_and_abstention_gives_no_rate(spark):
    rows = [("a", "m", PT, "pT1", "supported", True), ("b", "m", PT, None, "not_documented", False), ("c", "m", PN, None, "negated", False)]
    gold = [("a", PT, "pT2", "supported"), ("b", PT, None, "not_documented"), ("c", PN, None, "negated")]
    f = spark.createDataFrame(rows, "report_id string, method string, variable_name string, extracted_value string, documentation_status string, supported boolean")
    flags = evaluate.scored(f, spark.createDataFrame(gold, "report_id string, variable_name string, gold_value string, gold_status string"))
    got = {r["variable_name"]: r for r in evaluate.by_variable(flags).collect()}
    assert (got[PT]["tp"], got[PT]["fp"], got[PT]["fn"], got[PT]["tn"], got[PT]["f1"]) == (0, 1, 1, 1, 0.0)
    assert got[PN]["precision"] is None and got[PN]["f1"] is None


DRAFT = "report_id string, method string, variable_name string, action string, corrected_value string, corrected_status string, conflicting_alternatives array<string>, corrected_evidence_texts array<string>, reason string"


def test_review(spark):
    text = "Tumor size: 3.2 cm. pT2a. pN0 and pN0. Adenocarcinoma."
    fix = lambda value, status, quotes: ("corrected", value, status, [], quotes, "why")
    plain = {H: ("accepted", None, None, [], [], ""), S: fix("3.2 cm", "supported", ["Tumor size: 3.2 cm"]), PT: ("rejected", None, None, [], [], "no"), PN: ("flagged_for_review", None, None, [], [], "look")}
    cases = {
        "": {}, "more than once": {PN: fix("pN0", "supported", ["pN0"])}, "explain": {PT: ("rejected", None, None, [], [], " ")}, "exact report substring": {S: fix("3.2 cm", "supported", ["size 3.2"])},
        "does not state": {S: fix("9.9 cm", "supported", ["Tumor size: 3.2 cm"])}, "no review decision": {H: None}, "choose Accept": {H: ("pending", None, None, [], [], "")},
        "value is required": {S: fix(" ", "supported", ["Tumor size: 3.2 cm"])},
    }
    fields = pipeline.fields(spark.createDataFrame([(c, text) for c in cases], "report_id string, text string"))
    made = [(c, "evidence_first", v, *{**plain, **change}[v]) for c, change in cases.items() for v in P.VARIABLES if {**plain, **change}[v]]
    rows = review.checked(fields, spark.createDataFrame(made, DRAFT)).cache()
    errors = {}
    for r in rows.select("report_id", "errors").collect():
        errors.setdefault(r["report_id"], []).extend(r["errors"])
    assert errors.pop("") == [] and all(any(c in e for e in found) for c, found in errors.items()), errors
    out = review.reviewed(review.sound(rows), "2024-01-01T00:00:00Z").cache()
    got = {r["variable_name"]: r for r in out.collect()}
    assert len(got) == out.count() == 4 and got[PT]["reviewed_status"] == "unsupported" and got[PN]["reviewed_status"] == "manual_review_required" and got[S]["reviewed_value"] == "3.2 cm"
    assert review.residual_priority(out).head()["review_priority"] == "high" and len({r["audit_id"] for r in got.values()}) == 4
    report = out.select("report_id", "method").distinct().withColumns({"source_report_digest": F.concat(F.lit("sha256:"), F.sha2(F.lit(text), 256)), "review_priority": F.lit("low"), "review_priority_reason": F.lit("none")})
    session = lambda started, returned, note: out.select("report_id", "method").distinct().withColumns({"reviewer_identity_verified": F.lit(True), "review_started_at": F.lit(started), "returned_for_clarification": F.lit(returned), "overall_note": F.lit(note)})
    named = out.withColumn("reviewer_identity", F.lit("A"))
    whole = review.snapshot(named, report, session("2023-12-31T23:59:00Z", True, "ask"), "2023-12-31T00:00:00Z").cache()
    csv = sinks.reviewed_csv(whole)
    one = csv.where(F.col("variable_name") == S).head()
    assert len(csv.columns) == 28 and csv.count() == 4 and all(str(v) for c, v in one.asDict().items() if c != "report_id"), one
    assert (one["review_duration_seconds"], one["returned_for_clarification"], one["residual_review_priority"]) == (60.0, "True", "high") and one["model_version"].startswith("evidence_first-sha256:")
    audit = sinks.audit_csv(whole)
    assert len(audit.columns) == 22 and "start_offset" in audit.where(F.col("variable_name") == S).head()["original_evidence_json"]
    assert review.snapshot(named, report, session(None, True, " "), "x").count() == 0 and review.snapshot(out, report, session(None, False, ""), "x").count() == 0
    texts = spark.createDataFrame([("", text), ("", text + "!")], "report_id string, text string")
    assert sorted(r["approved"] for r in review.approved(whole, texts).collect()) == [False, True]
    with pytest.raises(ValueError, match="missing"):
        sinks.reviewed_csv(out)
    assert '"reviewed_value":null' in sinks.reviewed_json(out).head()["json"]


def test_pages(spark):
    events = [("d", 1, 1, "accept", "one"), ("d", 1, 2, "rotate", None), ("d", 2, 1, "blank", None), ("d", 2, 2, "rotate", None), ("d", 3, 1, "accept", "x"), ("d", 3, 2, "reset", None)]
    got = {r["page_number"]: tuple(r)[2:] for r in pages.folded(spark.createDataFrame(events, "document_id string, page_number int, seq int, event string, text string")).collect()}
    assert got == {1: ("one", False, False), 2: (None, True, True), 3: (None, False, False)}
    rows = spark.createDataFrame([("d", 1, "ab", True, False), ("d", 2, "", True, True), ("d", 3, "cde", True, False)], "document_id string, page_number int, text string, accepted boolean, excluded_as_blank boolean")
    row = pages.assembled(rows).select("*", *[pages.page_for(F.col("page_ranges"), F.lit(i)).alias(f"p{i}") for i in (0, 1, 2, 4, 6, 7)]).head()
    assert row["text"] == "ab\n\ncde" and [row[f"p{i}"] for i in (0, 1, 2, 4, 6, 7)] == [1, 1, None, 3, 3, None] and row["error"] is None
    old = rows.withColumn("corrected_text", F.lit("fixed"))
    merged = {r["page_number"]: r for r in pages.merged(old, spark.createDataFrame([("d", 1, "new"), ("d", 2, "n")], "document_id string, page_number int, text string")).collect()}
    assert (merged[1]["text"], merged[1]["accepted"], merged[1]["corrected_text"]) == ("new", False, "fixed") and merged[2]["accepted"] and merged[3]["accepted"]


def test_prepared_and_synthetic_reports(spark):
    text = "A long enough report text."
    rows = [(text, "pasted", True), (text, "pasted", False), (text, "other", True), ("MRN: 77 and a long enough text", "uploaded", True), (text, "synthetic", None), ("short", "pasted", True)]
    got = [r["errors"] for r in reports.prepared(spark.createDataFrame(rows, "raw_text string, source string, approved boolean")).collect()]
    assert [bool(e) for e in got] == [False, True, True, True, False, True]
    rows = [("SYN-1", "LUAD", True, "s", "d", "MARK a"), ("SYN-2", "LUAD", True, "s", "d", "MARK b"), ("SYN-2", "X", False, "s", "d", "c")]
    bad = {r["text"]: r["errors"] for r in reports.synthetic_checked(spark.createDataFrame(rows, reports.REPORT), "MARK").collect()}
    assert bad["MARK a"] == [] and bad["MARK b"] == ["repeated id"] and len(bad["c"]) == 4


def test_gold(spark, tmp_path):
    text = "Tumor size: 3.2 cm, said twice: yes"
    head = ",".join(reports.GOLD_COLUMNS)
    lines = [f'r,LUAD,{S},3.2 cm,"Tumor size: 3.2 cm, said",0,24,supported,False,n', f"r,LUAD,{H},,,,,not_documented,True,", f"r,LUAD,{PT},,,,,nonsense,maybe,", f"r,LUAD,{PN},pN0,x,1,2,supported,False,"]
    (tmp_path / "gold.csv").write_text("\n".join([head, *lines]))
    texts = spark.createDataFrame([("r", text)], "report_id string, text string")
    got = {r["variable_name"]: r for r in reports.gold_parsed(reports.gold_csv(spark, str(tmp_path / "gold.csv")), texts).collect()}
    assert got[S]["errors"] == [] and got[S]["evidence_end_offset"] == 24 and got[H]["errors"] == [] and got[H]["gold_value"] is None
    assert set(got[PT]["errors"]) == {"unknown status", "boolean must be true or false"} and got[PN]["errors"] == ["evidence is not at its offsets"]


def test_uploads(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("[Content_Types].xml", "x")
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>One</w:t><w:t> two</w:t></w:p><w:p/><w:p><w:t>Three</w:t></w:p></w:document>')
    files = {"a.docx": buffer.getvalue(), "b.pdf": b"%PDF-1.7", "c.pdf": b"nope", "d.exe": b"MZ", "e.txt": "﻿héllo".encode(), "f.txt": b"\xff\xfe", "g.png": b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (100_000).to_bytes(4, "big") * 2}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r for r in uploads.read(spark, str(tmp_path)).withColumn("text", F.when(F.col("kind") == "docx", uploads.docx_text(F.col("content")))).collect()}
    assert got["a.docx"]["text"] == "One two\n\nThree" and got["b.pdf"]["error"] is None
    assert got["c.pdf"]["error"] and got["d.exe"]["error"] and got["g.png"]["error"] == "the image has too many pixels"
    said = {r["path"].rsplit("/", 1)[1]: r for r in reports.uploaded(spark, str(tmp_path)).collect()}
    assert said["e.txt"]["raw_text"] == "héllo" and said["f.txt"]["error"].endswith("UTF-8 text.") and said["d.exe"]["error"]


def test_stream_of_reports(spark, tmp_path):
    spark.createDataFrame([("a", "pT2a"), ("b", "pN1")], stream.SCHEMA).write.parquet(f"{tmp_path}/in")
    q = stream.appended(stream.fields(stream.incoming(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/state")
    q.awaitTermination(120)
    got = {(r["report_id"], r["variable_name"]): r["extracted_value"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got["a", PT] == "pT2a" and got["b", PN] == "pN1" and len(got) == 8


def test_both_json_shapes_and_unreadable_files(spark, tmp_path):
    from spanforge.sources import reports

    one = '{"report_id":"SYN-%d","cancer_type":"LUAD","is_synthetic":true,"text":"WM some text"}'
    for name, content in (("a", '{"reports":[' + one % 1 + "]}"), ("b", "[" + one % 2 + "]"), ("c", '{"reports":[{"rep'), ("d", "[]")):
        (tmp_path / f"{name}.json").write_text(content)
    got = sorted((r["report_id"] or "", r["errors"]) for r in reports.synthetic(spark, str(tmp_path), "WM").collect())
    bad = ("", ["no readable reports in the file"])
    assert got == [bad, bad, ("SYN-1", []), ("SYN-2", [])]


def test_damaged_docx_members_give_no_text(spark):
    import io
    import zipfile

    from pyspark.sql import functions as F

    from spanforge.sources import uploads

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "x")
        z.writestr("word/document.xml", "<a>" + "word " * 500 + "</a>")
    data = bytearray(out.getvalue())
    at = data.find(b"word/document.xml") + 20
    data[at : at + 6] = b"\xff" * 6
    rows = spark.createDataFrame([(bytes(data),)], "content binary").select(uploads.docx_text(F.col("content")).alias("t")).collect()
    assert rows[0]["t"] is None


def test_drafts_on_their_own_rows_are_checked_like_a_join_of_them(spark):
    texts = spark.createDataFrame([(f"R{i}", "FINAL DIAGNOSIS:\n- Invasive adenocarcinoma.\n- Tumor size: 2.1 cm.") for i in range(3)], "report_id string, text string")
    fields = pipeline.fields(texts).cache()
    action = F.when(F.col("report_id") == "R0", "pending").when(F.col("report_id") == "R1", "rejected").otherwise("accepted")
    reason = F.when(F.col("variable_name") == "tumor_size", "").otherwise("seen")
    joined = review.checked(fields, review.drafts(fields).withColumn("action", action).withColumn("reason", reason))
    beside = review.checked_drafts(fields, action, reason)
    rows = lambda df: sorted(repr(r) for r in df.select(sorted(joined.columns)).collect())
    assert rows(beside) == rows(joined) and len(rows(joined)) == 12
    assert {r[0] for r in review.sound(beside).select("report_id").collect()} == {"R2"}
    # the fields are worked out once: one read of the table in the plan
    plan = review.sound(beside)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1 and "Join" not in plan

"""Checks of data sets, saved reviews and cohorts; the sweep over pages; review JSON."""

import json

import pytest
from pyspark.sql import functions as F

from spanforge.functions import patterns as P
from spanforge.operators import coherence, datacheck, evaluate, highlight, pages, triage
from spanforge.plans import registry
from spanforge.sources import sinks, uploads

H, S, PT, PN = P.VARIABLES
SF = "/root/testdata/sf0.001"
REPORT = "report_id string, cancer_type string, is_synthetic boolean, scenario string, description string, text string"
GOLD = "report_id string, cancer_type string, variable_name string, gold_value string, evidence_text string, evidence_start_offset string, evidence_end_offset string, documentation_status string, manual_review_required string"
STATED = {
    "complete": {PN: ("pN0", "supported")}, "no_nodes_cannot_be_assigned": {PN: ("", "cannot_be_assigned")}, "pn_not_documented": {PN: ("", "not_documented")},
    "explicit_pnx": {PN: ("pNX", "cannot_be_assigned")}, "amended": {S: ("4.1 cm", "supported"), PT: ("pT2b", "supported")}, "negated": {H: ("", "negated")},
}


def sound():
    reports = [(f"SYN-{i}", "LUAD", True, s, "a synthetic case", f"{datacheck.WATERMARK}\nfound here") for i, s in enumerate(datacheck.SCENARIOS)]
    start = len(datacheck.WATERMARK) + 1
    gold = []
    for i, s in enumerate(datacheck.SCENARIOS):
        for v in P.VARIABLES:
            value, status = STATED.get(s, {}).get(v, ("x", "supported"))
            bare = status == "not_documented"
            gold.append((f"SYN-{i}", "LUAD", v, value, None if bare else "found", None if bare else str(start), None if bare else str(start + 5), status, "True"))
    return reports, gold, [(v,) for v in P.VARIABLES]


def found(spark, reports, gold, template):
    df = datacheck.errors(spark.createDataFrame(reports, REPORT), spark.createDataFrame(gold, GOLD), spark.createDataFrame(template, "variable_name string"), n_reports=8, n_gold=32)
    return sorted((r["rule"], r["subject"]) for r in df.collect())


def test_sound_data_set(spark):
    assert found(spark, *sound()) == []


@pytest.mark.parametrize("change,want", [
    ({"r0": ("X-0", None, None, None, None, None)}, {"report: id", "report: cancer type", "report: not marked synthetic", "report: no scenario", "report: description", "report: watermark", "reports: scenarios", "gold: unknown report", "report: coverage of variables", "spot: value", "spot: status"}),
    ({"r1": None}, {"reports: count", "reports: scenarios", "gold: unknown report", "spot: value", "spot: status"}),
    ({"g0": None}, {"gold: count", "report: coverage of variables"}),
    ({"g1": ("SYN-0", "LUSC", S, "x", "found", "a", "b", "odd", "yes")}, {"gold: cancer type", "gold: offsets are no integers", "gold: status", "gold: review flag"}),
    ({"g1": ("SYN-0", "LUAD", S, "x", "found", "5", "5", "supported", "True")}, {"gold: offsets outside the text"}),
    ({"g1": ("SYN-0", "LUAD", S, "x", "found", "0", "5", "supported", "True")}, {"gold: evidence is not at its offsets"}),
    ({"g1": ("SYN-0", "LUAD", S, "x", "", "1", "", "supported", "True")}, {"gold: offsets without evidence", "gold: evidence missing"}),
    ({"g1": ("SYN-0", "LUAD", H, "x", "", "", "", "not_documented", "True")}, {"gold: duplicate key", "report: coverage of variables"}),
    ({"t0": None}, {"template: count", "template: variables"}),
])
def test_planted_faults(spark, change, want):
    tables = dict(zip("rgt", map(list, sound())))
    for where, row in change.items():
        rows, i = tables[where[0]], int(where[1:])
        rows[i : i + 1] = [row] if row else []
    assert {r for r, _ in found(spark, tables["r"], tables["g"], tables["t"])} == want


def test_counts_come_with_the_rows(spark):
    reports, gold, template = sound()
    reports[0] = (*reports[0][:2], False, *reports[0][3:])
    rows, seen = datacheck.counted(datacheck.report_errors(spark.createDataFrame(reports, REPORT), count=8))
    assert rows.count() == 1
    assert seen.get["failures"] == 1 and seen.get["report: not marked synthetic"] == 1 and seen.get["report: id"] == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], REPORT), spark.createDataFrame([], GOLD)
    assert {r["rule"] for r in datacheck.errors(*none).collect()} == {"reports: scenarios", "spot: value", "spot: status"}


def test_sound_reviews_are_coherent(spark):
    table = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    fields, audit = (registry._review_side(spark, table, s).where("m not in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15)") for s in ("field", "audit"))
    assert fields.count() > 100 and coherence.errors(fields, audit).count() == 0
    assert coherence.errors(fields, coherence.audit_records(fields.drop("m", "v"))).count() == 0


def test_every_rule_of_reviews_is_met(spark):
    told = {r["rule"] for r in registry.queries()["review_coherence"](spark, SF).select("rule").distinct().collect()}
    for rule in ("still pending", "no reason", "unknown variable", "breaks the field schema", "acceptance changes the proposal", "rejection keeps something", "flag keeps something"):
        assert f"field: {rule}" in told
    assert {"audit: corrected value is not the result", "audit: corrected value without a correction", "both: no audit record", "both: no reviewed field", "both: reviewed_at differs", "review: not each variable once"} <= told


def test_review_json_keeps_nulls_and_order(spark):
    doc = {r["review_id"]: json.loads(r["json"]) for r in registry.queries()["reviewed_json"](spark, SF).collect()}
    one = doc["REV-1"]
    assert [f["variable_name"] for f in one["reviewed_abstraction"]["fields"]] == list(P.VARIABLES)
    assert set(one["reviewed_abstraction"]) == {*sinks.REVIEW, "fields"} and one["reviewed_abstraction"]["review_started_at"] is None
    assert len(one["audit_history"]) == 4 and {a["reviewer_action"] for a in one["audit_history"]} <= set(P.ACTIONS)
    alone = spark.createDataFrame([("R", PN), ("R", H)], "review_id string, variable_name string")
    (row,) = sinks.reviewed_json(alone).collect()
    body = json.loads(row["json"])
    assert body["audit_history"] == [] and [f["variable_name"] for f in body["reviewed_abstraction"]["fields"]] == [H, PN]


@pytest.mark.parametrize("bin_chars", [1, 7, 1 << 20])
def test_sweep_finds_the_page_of_every_offset(spark, bin_chars):
    spans = [("a", 1, 0, 10), ("a", 2, 12, 12), ("a", 3, 14, 40), ("b", 1, 0, 3)]
    offsets = [(d, o, f"x{o}") for d in ("a", "b", "c") for o in [*range(-2, 45), None, 13, 13]]
    df = spark.createDataFrame(offsets, "document_id string, offset long, note string")
    out = pages.located(df, spark.createDataFrame(spans, "document_id string, page_number long, start int, stop int"), bin_chars)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = sorted(repr(tuple(r)) for r in out.collect())
    want = [(d, o, n, next((p for e, p, a, b in spans if e == d and o is not None and a <= o < b), None)) for d, o, n in offsets]
    assert got == sorted(map(repr, want))


def test_scores_of_both_levels_in_one_aggregate(spark):
    flags = spark.createDataFrame([("m", "a", True, False), ("m", "a", False, True), ("m", "b", True, False), ("n", "a", False, False)], "method string, variable_name string, tp boolean, fp boolean")
    flags = flags.withColumns({c: F.lit(False) for c in evaluate.COUNTS if c not in ("tp", "fp")})
    out = evaluate.by_level(flags)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r["method"], r["variable_name"]): (r["tp"], r["fp"], r["precision"], r["recall"], r["f1"], r["level"]) for r in out.collect()}
    assert got == {("m", "a"): (1, 1, 0.5, 1.0, 2 / 3, 0), ("m", "b"): (1, 0, 1.0, 1.0, 1.0, 0), ("n", "a"): (0, 0, None, None, None, 0), ("m", None): (2, 1, 2 / 3, 1.0, 0.8, 1), ("n", None): (0, 0, None, None, None, 1)}


def test_highlight(spark):
    text = "a<b> pT2 & pT2, 3 cm\nend"
    at = lambda t, n=0: [i for i in range(len(text)) if text.startswith(t, i)][n]
    span = lambda t, n=0: (t, at(t, n), at(t, n) + len(t))
    evidence = {PT: [span("pT2", 1), span("pT2", 0)], S: [span("pT2, 3 cm"), ("3 cm", 0, 4), ("x", -1, 2), (text + "x", 0, len(text) + 1)], H: [], "other": [span("end")]}
    kind = "report_id string, variable_name string, evidence array<struct<text:string,start_offset:int,end_offset:int>>"
    fields = spark.createDataFrame([("r", v, e) for v, e in evidence.items()] + [("gone", PT, [("a", 0, 1)])], kind)
    reports = spark.createDataFrame([("r", text), ("plain", "<&>"), ("null", None)], "report_id string, text string")
    got = {r["report_id"]: r["html"] for r in highlight.highlighted(reports, fields, focused=S).collect()}
    assert got["plain"] == "&lt;&amp;&gt;" and got["null"] is None and set(got) == {"r", "plain", "null"}
    anchor = lambda v: f'<span class="evidence-anchor" id="evidence-{v.replace("_", "-")}"></span>'
    mark = lambda names, said, focus=False: f'<mark class="evidence-mark{" evidence-mark--focused" if focus else ""}" title="Evidence for {names}">{said}</mark>'
    t, s = "Pathological T category", "Tumor size"
    assert got["r"] == "a&lt;b&gt; " + anchor(PT) + mark(t, "pT2") + " &amp; " + anchor(S) + mark(f"{t}, {s}", "pT2", True) + mark(s, ", 3 cm", True) + "\nend"


def test_highlight_of_many_spans(spark):
    """Nested, equal, touching and overlapping spans: every character stands once, marked with what covers it."""
    import random
    import re

    draw, text = random.Random(2), "".join("abc<&"[i % 5] for i in range(200))
    spans = [(v, a, min(200, a + draw.randint(1, 30))) for v in P.VARIABLES for a in (draw.randrange(200) for _ in range(25))]
    fields = spark.createDataFrame([("r", v, [(text[a:b], a, b)]) for v, a, b in spans], "report_id string, variable_name string, evidence array<struct<text:string,start_offset:int,end_offset:int>>")
    (row,) = highlight.highlighted(spark.createDataFrame([("r", text)], "report_id string, text string"), fields).collect()
    label = dict(zip(P.VARIABLES, ("Histologic diagnosis", "Tumor size", "Pathological T category", "Pathological N category")))
    seen = []
    for title, marked, plain in re.findall(r'<mark class="evidence-mark" title="Evidence for ([^"]*)">([^<]*)</mark>|((?:[^<]|<span[^>]*></span>)+)', row["html"]):
        said = re.sub(r"<span[^>]*></span>", "", marked or plain).replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")
        seen += [(c, title) for c in said]
    want = [(c, ", ".join(label[v] for v in sorted({v for v, a, b in spans if a <= i < b}))) for i, c in enumerate(text)]
    assert seen == want and row["html"].count("evidence-anchor") == 4


def jpeg(width, height, extra=b"", frame=0xC0):
    return b"\xff\xd8\xff\xe0\x00\x10JFIF" + b"\0" * 10 + extra + bytes([0xFF, frame, 0, 17, 8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\3" + b"\0" * 9 + b"\xff\xda\x00\x08data\xff\xd9"


def test_images_show_their_size(spark, tmp_path):
    exif = b"\xff\xff\xe1" + (60_000).to_bytes(2, "big") + b"\xff\xc0" * 29_999
    png = lambda w, h: b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big")
    files = {
        "a.jpg": jpeg(640, 480), "b.jpeg": jpeg(640, 480, exif * 40, 0xC2), "big.jpg": jpeg(8000, 6000), "cut.jpg": jpeg(640, 480)[:25], "scan.jpg": b"\xff\xd8\xff\xda\0\2", "zero.jpg": jpeg(0, 10),
        "short.jpg": b"\xff\xd8\xff\xe0\0\1", "huffman.jpg": jpeg(10, 10, b"\xff\xc4\0\5abc\xff\xd0"), "c.png": png(10, 20), "big.png": png(100_000, 100_000), "d.png": b"\x89PNG\r\n\x1a\n",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r["error"] for r in uploads.read(spark, str(tmp_path)).collect()}
    none, many = "the image has no readable size", "the image has too many pixels"
    assert got == {"a.jpg": None, "b.jpeg": None, "big.jpg": many, "cut.jpg": none, "scan.jpg": none, "zero.jpg": none, "short.jpg": none, "huffman.jpg": None, "c.png": None, "big.png": many, "d.png": none}
    sizes = spark.createDataFrame([(bytearray(files["b.jpeg"]),)], "content binary").select(uploads.jpeg_size(F.col("content")).alias("s")).head()["s"]
    assert (sizes["width"], sizes["height"]) == (640, 480)


def test_why_a_document_gives_no_text(spark):
    import io
    import zipfile

    def docx(body, name="word/document.xml"):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("[Content_Types].xml", "x")
            z.writestr(name, body)
        return out.getvalue()

    head = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p>'
    rows = [(1, docx(f"{head}<w:t> a </w:t></w:p></w:document>")), (2, docx(f"{head}</w:p></w:document>")), (3, docx("x", "other.xml")), (4, b"PK nothing"), (5, docx("<broken"))]
    out = spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "i int, content binary").select("i", uploads.docx_read(F.col("content")).alias("r"))
    got = {r["i"]: (r["r"]["text"], r["r"]["error"]) for r in out.collect()}
    damaged = (None, "the document is damaged or unreadable")
    assert got == {1: ("a", None), 2: (None, "the document contains no extractable text"), 3: (None, "the archive is not a Word document"), 4: damaged, 5: damaged}


def test_status_presentation(spark):
    rows = spark.createDataFrame([(s,) for s in (*P.STATUSES, "odd", None)], "s string").select("s", triage.status_presentation(F.col("s")).alias("p")).collect()
    got = {r["s"]: r["p"] for r in rows}
    assert got["odd"] is None and got[None] is None and all(got[s]["label"] and got[s]["description"] for s in P.STATUSES)
    assert (got["conflicting"]["tone"], got["supported"]["tone"], got["cannot_be_assigned"]["label"]) == ("danger", "positive", "Cannot be assigned")


def test_queue_by_case_status(spark):
    pair = "report_id string, method string"
    queued = spark.createDataFrame([(r, "m") for r in "abcdefg"], "report_id string, queue_method string")
    found = spark.createDataFrame([(r, "m") for r in "abcdf"] + [("e", "n")], pair)
    decisions = spark.createDataFrame([("b", "m", "accepted"), ("b", "m", "pending"), ("c", "m", "pending"), ("d", "n", "accepted"), ("e", "m", "accepted"), ("f", "m", "pending")], pair + ", action string")
    snapshots, dirty = spark.createDataFrame([("a", "m"), ("c", "n")], pair), spark.createDataFrame([("f", "m"), ("g", "m")], pair)
    of = lambda **kw: {r["report_id"]: r["case_status"] for r in triage.queue_cases(queued, found, decisions, snapshots, dirty, **kw).collect()}
    todo, begun = "Needs review", "In progress"
    assert of() == {"a": "Completed", "b": begun, "c": todo, "d": todo, "e": todo, "f": begun, "g": todo}
    assert set(of(only=begun)) == {"b", "f"}
    with pytest.raises(ValueError):
        of(only="Done")


def test_every_rule_of_a_decision_is_reached(spark):
    got = {r["error"] for r in registry.queries()["review_errors"](spark, "/root/testdata/sf0.01").select("error").distinct().collect()}
    assert len(got) == 19


@pytest.mark.parametrize("name", ["eval_confusion", "eval_scores", "eval_metrics"])
def test_annotations_are_never_broadcast(spark, name):
    """They grow with the reports, however small their compressed files look."""
    out = registry.queries()[name](spark, SF)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    # eval_metrics joins one row a method with one row a method at the end: that may be broadcast
    assert plan.count("SortMergeJoin") >= 1 and plan.count("BroadcastHashJoin") <= 2 * (name == "eval_metrics")


def test_parts_of_a_table_follow_its_bytes(spark, tmp_path, monkeypatch):
    """Otherwise a task would hold more rows of a larger table."""
    from spanforge.operators import extract

    spark.range(100_000).select(F.col("id").alias("report_id"), F.rand(1).alias("x")).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(extract, "TASK_BYTES", 20_000)
    cores = spark.sparkContext.defaultParallelism
    assert cores < extract.spread(table, "report_id").rdd.getNumPartitions() <= cores * extract.WAVES
    monkeypatch.setattr(extract, "WAVES", 2)
    assert extract.spread(table).rdd.getNumPartitions() == 2 * cores
    assert extract.spread(spark.read.parquet(f"{SF}/region.parquet")).rdd.getNumPartitions() == cores

"""The classifier against its definition, computed by hand."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from spanforge.functions import patterns as P
from spanforge.operators import model, pipeline

TEXTS = ["Tumor size: 2.1 cm. Tumor is a adenocarcinoma", "tumor size 3.0 cm\n squamous", "no tumor seen, a a a", "Large cell carcinoma 3.0 cm"]
LABELS = ["x", "y", "x", "z"]


def grams(text):
    """Character n-grams of 3 to 5 of words between blanks; a padded word shorter than n gives none of that length."""
    out = []
    for w in text.lower().split():
        w = f" {w} "
        out += [w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)]
    return out


def weights(texts):
    counts = [Counter(grams(t)) for t in texts]
    seen = Counter(g for c in counts for g in c)
    names = sorted(seen)
    x = np.array([[(1 + math.log(c[g])) * (1 + math.log((1 + len(texts)) / (1 + seen[g]))) if g in c else 0.0 for g in names] for c in counts])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def rows(spark):
    made = [(i, t, y, 4 / (3 * LABELS.count(y))) for i, (t, y) in enumerate(zip(TEXTS, LABELS))]
    return spark.createDataFrame(made, "i int, text string, label string, weight double")


@pytest.fixture(scope="module")
def fitted(rows):
    return model.fit(rows)


def test_terms_and_probabilities(rows, fitted):
    index, terms, weigh, unit, regression = fitted.stages
    assert sorted(terms.vocabulary) == sorted({g for t in TEXTS for g in grams(t)})  # every n-gram has its own place
    got = unit.transform(weigh.transform(model.weighted_terms(rows, terms))).orderBy("i").collect()
    x = np.stack([r["__features"].toArray() for r in got])
    want = weights(TEXTS)
    assert np.allclose(x @ x.T, want @ want.T, atol=1e-9)  # the same angles, wherever the n-grams stand
    assert list(index.labels) == ["x", "y", "z"]
    w, b = regression.coefficientMatrix.toArray(), regression.interceptVector.toArray()
    z = x @ w.T + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    y = np.eye(3)[["xyz".index(v) for v in LABELS]]
    m = np.array([4 / (3 * LABELS.count(v)) for v in LABELS])
    assert np.abs(((p - y) * m[:, None]).T @ x + w).max() < 0.02 and np.abs(((p - y) * m[:, None]).sum(0)).max() < 0.02  # no slope left
    found = model.annotated(rows, {P.PN: fitted}).orderBy("i").collect()
    for r, q in zip(found, p):
        one = r["predictions"][0]
        assert one["label"] == "xyz"[q.argmax()] and abs(one["confidence"] - q.max()) < 1e-9 and len(one["probabilities"]) == 3


def test_labels_and_what_they_stand_for(spark):
    cases = [
        ("conflicting", "v", model.CONFLICT, None, "conflicting"), ("negated", None, model.NEGATED, None, "negated"), ("not_documented", None, model.ABSENT, None, "not_documented"),
        ("cannot_be_assigned", " ", model.CANNOT_ASSIGN, None, "cannot_be_assigned"), ("cannot_be_assigned", "pNX", "pNX", "pNX", None), ("supported", "", model.ABSENT, None, "not_documented"),
        ("uncertain", " 2 cm", model.UNCERTAIN + "2 cm", "2 cm", "uncertain"), ("supported", "pT1", "pT1", "pT1", None),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s string, v string, label string, value string, status string")
    for r in df.select("*", model.label_of(F.col("s"), F.col("v")).alias("l"), model.decoded(F.col("label")).alias("d")).collect():
        assert (r["l"], r["d"]["value"], r["d"]["status"]) == (r["label"], r["value"], r["status"])


GOLD = "report_id string, variable_name string, gold_value string, gold_status string"


def test_training_rows_balance_labels_and_contrast_a_single_one(spark):
    gold = spark.createDataFrame([("a", P.PN, "pN0", "supported"), ("b", P.PN, "pN0", "supported"), ("c", P.PN, "pN0", "supported"), ("a", P.PT, "pT1", "supported"), ("b", P.PT, None, "negated"), ("b", "other", "x", "supported")], GOLD)
    texts = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", None)], "report_id string, text string")
    got = sorted((r["variable_name"], r["label"], r["text"], r["weight"]) for r in model.training(gold, texts).collect())
    assert got == [(P.PN, model.ABSENT, "A", 1.5), (P.PN, "pN0", "A", 0.75), (P.PN, "pN0", "B", 0.75), (P.PT, model.NEGATED, "B", 1.0), (P.PT, "pT1", "A", 1.0)]
    with pytest.raises(ValueError):
        model.fit_all(gold, texts)  # two variables without any row


def test_method_notes_save_and_load(spark, tmp_path):
    texts = spark.createDataFrame([("a", "FINAL DIAGNOSIS: Invasive adenocarcinoma. Pathological N category: pN0."), ("b", "Nothing to see."), ("c", " "), ("d", None)], "report_id string, text string")
    gold = spark.createDataFrame([(r, v, "pN0" if (r, v) == ("a", P.PN) else None, "supported" if (r, v) == ("a", P.PN) else "not_documented") for r in "ab" for v in P.VARIABLES] + [("a", v, "x", "supported") for v in P.VARIABLES], GOLD)
    models = model.default(spark, str(tmp_path / "m"), gold, texts)
    again = model.default(spark, str(tmp_path / "m"), gold.limit(0), texts)  # loads: there is nothing to fit from
    first, second = (sorted((r["report_id"], r["variable_name"], r["label"], round(r["confidence"], 9)) for r in model.predicted(texts, m).collect()) for m in (models, again))
    assert first == second and {r[0] for r in first} == {"a", "b"} and len(first) == 8
    known = texts.where("report_id in ('a', 'b')")
    want = {(r["report_id"], r["variable_name"]): r for r in pipeline.fields(known).collect()}
    for r in pipeline.fields(known, "ml", models=models).collect():
        plain = want[r["report_id"], r["variable_name"]]
        assert (r["extracted_value"], r["documentation_status"], r["method"]) == (plain["extracted_value"], plain["documentation_status"], "ml")
        lead = "Evidence-anchored hybrid candidate selected (classifier confidence=0." if r["extracted_value"] else "No evidence-anchored candidate was found; a classifier-only suggestion was withheld (confidence=0."
        assert r["notes"].startswith(lead) and r["notes"].endswith(plain["notes"])
    with pytest.raises(ValueError):
        pipeline.fields(known, "ml")
    with pytest.raises(ValueError):
        model.save({P.PN: models[P.PN]}, str(tmp_path / "n"))


def test_other_variables_terms_weigh_nothing(spark):
    """In a shared vocabulary a model still sees only the n-grams of its own rows."""
    spark.range(3).observe(Observation(), F.count(F.lit(1)).alias("n")).collect()  # a session that has observed a metric still predicts
    own = spark.createDataFrame([("aaa bbb", "x", 1.0), ("bbb ccc", "y", 1.0)], "text string, label string, weight double")
    wide = model.vocabulary(own.select("text").unionByName(spark.createDataFrame([("zzz yyy",)], "text string")))
    probe = spark.createDataFrame([("aaa zzz yyy",), ("ccc qqq",)], "text string")
    first, second = (model.annotated(probe, {P.PN: model.fit(own, terms=t)}).collect() for t in (None, wide))
    for a, b in zip(first, second):
        assert a["predictions"][0]["label"] == b["predictions"][0]["label"] and abs(a["predictions"][0]["confidence"] - b["predictions"][0]["confidence"]) < 0.01  # the solver ends within its tolerance


def test_train_job(spark, tmp_path, capsys):
    """Two runs load the same models; other annotations are fitted anew; label counts are printed."""
    import csv
    import json

    from spanforge.jobs import train
    from spanforge.operators import datacheck
    from spanforge.sources.reports import GOLD_COLUMNS

    texts = {f"SYN-{i}": f"{datacheck.WATERMARK}\nReport {i}: category pN{i % 2}." for i in range(4)}
    (tmp_path / "reports.json").write_text(json.dumps({"reports": [{"report_id": r, "cancer_type": "LUAD", "is_synthetic": True, "scenario": "complete", "description": "synthetic", "text": t} for r, t in texts.items()]}))

    def annotate(value):
        with open(tmp_path / "gold.csv", "w", newline="") as out:
            rows = csv.writer(out)
            rows.writerow(GOLD_COLUMNS)
            for i, (r, t) in enumerate(texts.items()):
                for v in P.VARIABLES:
                    said = v == P.PN
                    at = t.index("pN")
                    rows.writerow([r, "LUAD", v, f"pN{i % 2}" if said else "", f"pN{i % 2}" if said else "", at if said else "", at + 3 if said else "", "supported" if said else value if i % 2 else "conflicting", str(not said), ""])

    asked = ["--reports", str(tmp_path / "reports.json"), "--gold", str(tmp_path / "gold.csv"), "--output", str(tmp_path / "models")]
    annotate("not_documented")
    assert train.main(asked) == 0
    said = capsys.readouterr().out
    assert "Fitted and saved" in said and "Reports used: 4" in said and "{'pN0': 2, 'pN1': 2}" in said and model.ABSENT in said
    first = model.manifest(spark, str(tmp_path / "models"))
    assert train.main(asked) == 0 and "Already there" in capsys.readouterr().out
    assert model.manifest(spark, str(tmp_path / "models")) == first
    (tmp_path / "gold.csv").write_text((tmp_path / "gold.csv").read_text().replace("SYN-3,LUAD,pathological_n_category,pN1,pN1", "SYN-3,LUAD,pathological_n_category,pN1,pN1x"))
    assert train.main(asked) == 0 and "Fitted and saved" in capsys.readouterr().out  # a row with an error no longer counts
    assert model.manifest(spark, str(tmp_path / "models"))["digest"] != first["digest"]


def test_texts_are_not_taken_to_the_cohort(spark, tmp_path):
    """The cohort is bounded, the texts are not: only the cohort may be broadcast."""
    texts = spark.range(300).select(F.concat(F.lit("R"), "id").alias("report_id"), F.lit("Tumor size: 2.1 cm.").alias("text"))
    texts.write.parquet(f"{tmp_path}/texts")
    texts = spark.read.parquet(f"{tmp_path}/texts")
    gold = texts.select("report_id", F.lit(P.SIZE).alias("variable_name"), F.lit("2.1 cm").alias("gold_value"), F.lit("supported").alias("gold_status"))
    plan = model.training(model.cohort(gold, 9), texts)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    rows = model.training(model.cohort(gold, 9), texts)
    assert rows.count() == 10 and rows.select("label").distinct().count() == 2

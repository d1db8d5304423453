import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import langid, quality

SF = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out(spark):
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = langid.query(spark, SF).join(lang, "doc_id").where("held_out")
    assert got.count() > 300
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).head()[0] > 0.98


def test_mixture_finds_the_languages_of_a_mixed_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.trained(docs)
    text = {r["lang"]: r["text"] for r in docs.groupBy("lang").agg(F.max_by("text", F.length("text")).alias("text")).collect()}
    both = model.mixture(text["en"][:6000] + "\n" + text["de"][:3000])
    assert [k for k, _ in both][:2] == ["en", "de"] and 0.5 < both[0][1] < 0.8 and abs(sum(s for _, s in both) - 1) < 0.05
    assert [k for k, _ in model.mixture(text["es"])] == ["es"]


def test_undetermined_texts(spark):
    model = langid.Model(["a", "b"], np.ones((2, langid.BINS)))
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 ²!"), (4, "é")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identified(df, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0
    assert got[4]["lang_pred"] == "a" and 0 < got[4]["score"] <= 1
    assert all(r["lang_pred"] == "und" for r in langid.identified(df, langid.fit(df.withColumn("lang", F.lit(None).cast("string")))).collect())


def test_labels_of_held_out_rows_do_not_matter(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    from spanforge.llm import common

    flipped = labels.withColumn("quality", F.when(common.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold


def test_quality_on_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    got = quality.query(spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["quality"] == got["predicted"]).mean() > 0.95 and got["score"].between(0, 1).all()


def test_one_label_only(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert [r["score"] for r in quality.scored(docs, model).collect()] == [0.5, 0.5]


def test_bradley_terry_orders_separable_items():
    draw = np.random.default_rng(0)
    good, bad = draw.normal(1, 1, (200, 3)), draw.normal(-1, 1, (200, 3))
    w = quality.bradley_terry(good, bad)
    assert (w > 0).all() and np.mean((good @ w)[:, None] > (bad @ w)[None, :]) > 0.98


@pytest.mark.parametrize("tied", [False, True])
def test_threshold_is_the_quantile_of_all_rows(spark, monkeypatch, tied):
    monkeypatch.setattr(quality, "RANGE_ROWS", 5)
    monkeypatch.setattr(quality, "RANGE_BINS", 7)
    draw = np.random.default_rng(5)
    y = (np.arange(400) % 3 == 0).astype(int)
    raw = np.sort(draw.integers(0, 6, 400).astype(float) if tied else draw.normal(size=400) ** 5)
    n = {0: int((y == 0).sum()), 1: int((y == 1).sum())}
    rows = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, raw)], "quality int, raw double")
    assert quality.threshold(rows, n) == (raw[n[0] - 1] + raw[n[0]]) / 2


def test_sample_size_leaves_the_threshold_at_the_share_of_bad_labels(spark):
    docs = spark.createDataFrame([(i, "Some words of prose, and more. " * (1 + i % 37) + "$#@ " * (i * i % 23)) for i in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i * 7919 % 10 < 4)) for i in range(900)], "doc_id long, quality int")
    model = quality.fit(docs, labels, 40)
    usable = labels.where(~quality.common.held_out())
    rows = quality.scored(docs.join(usable, "doc_id"), model).toPandas()
    x = np.stack([quality.features(t) for t in rows["text"]]).astype("float64")
    raw = (np.clip((x - model.mean) / model.scale, -8, 8) * model.weights).sum(1)
    assert (raw < model.threshold).sum() <= (rows["quality"] == 0).sum() <= (raw <= model.threshold).sum()


LETTERS = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "mnopqrst"}


def _prose(draw, lang, n):
    words = draw.integers(0, len(LETTERS[lang]), (40, 4))  # few words, so that trigrams come again
    return " ".join("".join(LETTERS[lang][i] for i in words[k]) for k in draw.integers(0, 40, n))


def _trigrams(text):
    """Bins of the trigrams of the words of a text of plain letters, one by one."""
    data = (" " + " ".join(text.lower().split()) + " ").encode()
    return [(((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761) % 2**32) >> 17 for i in range(len(data) - 2)]


def _best_by_grid(p, c, steps=200):
    """(log-likelihood, shares) of the best mixture of one or two rows of p."""
    grid = [np.ones(1)] if len(p) == 1 else [np.array([k / steps, 1 - k / steps]) for k in range(1, steps)]
    return max(((np.log(s @ p) @ c, tuple(s)) for s in grid))


def test_language_model_counts_every_trigram(spark):
    draw = np.random.default_rng(1)
    rows = [(i, _prose(draw, lang, 60), lang) for i, lang in enumerate(list(LETTERS) * 4)] + [(99, None, "aa"), (100, "12 !", "bb"), (101, "abc abc", None)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    want = np.zeros((3, langid.BINS))
    for _, text, lang in rows:
        if lang and text and text != "12 !":
            np.add.at(want[sorted(LETTERS).index(lang)], _trigrams(text), 1)
    total = want.sum(1, keepdims=True)
    assert model.languages == sorted(LETTERS) and np.allclose(model.p, (want + langid.SMOOTH) / (total + langid.SMOOTH * langid.BINS), rtol=1e-12)


@pytest.mark.parametrize(("made", "want"), [({"aa": 60}, ["aa"]), ({"aa": 60, "bb": 40}, ["aa", "bb"]), ({"cc": 90, "bb": 30}, ["cc", "bb"]), ({"cc": 80, "aa": 1}, ["cc"])])
def test_mixture_is_the_best_by_penalised_likelihood(made, want):
    draw = np.random.default_rng(7)
    counts, text = np.zeros((3, langid.BINS)), []
    for i, lang in enumerate(sorted(LETTERS)):
        words = _prose(draw, lang, 4000).split()
        np.add.at(counts[i], _trigrams(" ".join(words)), 1)
        text += [words[k] for k in draw.integers(0, 4000, made.get(lang, 0))]
    model = langid.Model(sorted(LETTERS), counts)
    c = np.bincount(_trigrams(" ".join(text)), minlength=langid.BINS)
    sets = [(i,) for i in range(3)] + [(i, j) for i in range(3) for j in range(i)]
    fits = {s: _best_by_grid(model.p[list(s)], c) for s in sets}
    best = max(sets, key=lambda s: fits[s][0] - langid.PENALTY * np.log(c.sum() + 1) * (len(s) - 1))
    got = model.mixture(" ".join(text))
    assert {k for k, _ in got} == {model.languages[i] for i in best} and [k for k, _ in got] == want
    shares = dict(zip([model.languages[i] for i in best], fits[best][1]))
    assert all(abs(shares[k] - s) < 0.01 for k, s in got)
    p = model.p[[model.languages.index(k) for k, _ in got]]
    assert np.log(np.array([s for _, s in got]) @ p) @ c > fits[best][0] - 0.05


def test_bradley_terry_minimises_the_pair_loss():
    draw = np.random.default_rng(3)
    good, bad = draw.normal(0.5, 1, (60, 4)), draw.normal(0, 1, (80, 4))
    pick = np.random.default_rng(2)  # the operator's pairs
    n = min(quality.PAIRS, len(good) * len(bad))
    diff = good[pick.integers(len(good), size=n)] - bad[pick.integers(len(bad), size=n)]
    loss = lambda w: np.mean(np.log1p(np.exp(-(diff @ w)))) + quality.DECAY / 2 * w @ w
    best = np.zeros(4)
    for _ in range(30):  # Newton's method
        q = 1 / (1 + np.exp(diff @ best))
        slope = -(q @ diff) / n + quality.DECAY * best
        best = best - np.linalg.solve((diff.T * (q * (1 - q))) @ diff / n + quality.DECAY * np.eye(4), slope)
    w = quality.bradley_terry(good, bad)
    assert loss(w) < loss(best) + 1e-4 and np.abs(w - best).max() < 0.02


def test_judged_in_one_pass_like_fit_and_scored(spark):
    """judged reads texts once and drops them; scores are those of scored(docs, fit(docs, labels)), odd column names stay."""
    docs = spark.createDataFrame([(i, ("Good words here. " if i % 2 else "BAD ## 99 !! ") * (i % 13 + 1), i) for i in range(300)], "doc_id long, text string, `a.b` int")
    labels = spark.createDataFrame([(i, i % 2 if i % 17 else 1 - i % 2) for i in range(0, 300, 2)] + [(i, 1) for i in range(1, 300, 2)], "doc_id long, quality int")
    want = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality.scored(docs, quality.fit(docs, labels, 60)).collect()}
    got = quality.judged(docs, labels, 60)
    assert got.columns == ["doc_id", "a.b", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == 300 and all(r["a.b"] == r["doc_id"] for r in rows)
    assert all(abs(r["score"] - want[r["doc_id"]][0]) < 1e-12 and r["predicted"] == want[r["doc_id"]][1] for r in rows)

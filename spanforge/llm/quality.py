"""Document quality by Bradley-Terry pairwise ranking.

Every text becomes a vector of shape features (letter case, symbols, repetition, lengths, hashed shape trigrams; no
words, so no language is preferred). A document's worth is linear in its features; preference pairs (a good document
over a bad one) are fitted by logistic loss on the difference of their features. The threshold is the quantile of the
training scores that leaves as large a share below it as bad labels have; a logistic curve around it gives the score.

The weights are fitted on at most about ROWS labelled texts of either label, picked by a hash, and PAIRS pairs of them (the
documented bounds). The quantile is exact over the scores of all labelled training texts: histograms narrow it down to a
range of at most RANGE_ROWS scores (or one value). Every whole text is read once (`judged`): its worth is stored, threshold and
scores are taken from there.

Defined cases: null text: like the empty text, which has a score too. Rows without label, or with contradictory labels,
are not learned from. One label only, or none: every score is 0.5. Null doc_id: scored, never held out. Repeated rows:
each is scored. Empty table: empty result. Input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import common

ROWS = 4000
PAIRS = 20_000
RANGE_ROWS = 50_000
RANGE_BINS = 4096
BINS = 512
DECAY = 1e-3
STEPS = 300
COLUMNS = {"score": "double", "predicted": "int"}
RAW = "__raw"

_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS = np.zeros(256, "int64")
for _b in range(256):
    _CLASS[_b] = 1 if 65 <= _b <= 90 else 2 if 48 <= _b <= 57 else 4 if _b == 10 else 3 if _b <= 32 or _b == 127 else 5 + _PUNCTUATION.index(_b) if _b in _PUNCTUATION else 0
_SYMBOLS = b"*#$%&@^~=+<>{}[]\\/_"
_SYMBOL_TABLE = bytes(1 if b in _SYMBOLS else 0 for b in range(256))


def features(text: str | None) -> np.ndarray:
    """The feature vector of a text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    a = _CLASS[np.frombuffer(data, "uint8")]
    kinds = np.bincount(a, minlength=5 + len(_PUNCTUATION))
    words = data.split()
    nw = max(1, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    count = Counter(words)
    again = sum(map(bytes.__eq__, words, words[1:]))
    caps = sum(map(bytes.isupper, words))
    odd = sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:?" for w in words)
    bare = sum(len(w) == 1 and not w.isalnum() and w[0] < 128 for w in words)
    symbols = sum(data.count(bytes([s])) for s in _SYMBOLS)
    letters = max(1, int(kinds[0] + kinds[1]))
    dense = [
        np.log1p(len(data)), np.log1p(len(words)), np.log1p(len(lines)), np.log1p(len(words) / max(1, len(lines))),
        kinds[1] / letters, kinds[2] / n, symbols / n, data.count(b"!") / n, data.count(b"|") / n, len(data) / nw,
        again / nw, caps / nw, odd / nw, bare / nw, len(count) / nw, count.most_common(1)[0][1] / nw if count else 0.0,
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(again), np.log1p(caps), np.log1p(odd), np.log1p(bare), np.log1p(symbols),
        np.log1p(data.count(b"!")), np.log1p(data.count(b"|")), np.log1p(len(words)) - np.log1p(len(count)), float(kinds[2] > 0), float(not words),
    ]
    runs = a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a
    code = (runs[:-2] * 64 + runs[1:-1]) * 64 + runs[2:] if len(runs) > 2 else np.zeros(0, "int64")
    shapes = np.bincount((code * 2654435761 >> 12) % BINS, minlength=BINS) / max(1, len(code))
    return np.concatenate([np.array(dense, "float64"), np.log1p(1000 * shapes)]).astype("float32")


class Model:
    """Weights over standardised features, and the threshold."""

    def __init__(self, mean, scale, weights, threshold: float):
        self.mean, self.scale, self.weights, self.threshold = mean, scale, weights, threshold

    def raw(self, x: np.ndarray) -> np.ndarray:
        """The worth of each row of features, the same whatever rows stand beside it."""
        return (np.clip((x - self.mean) / self.scale, -8, 8) * self.weights).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1 for each row of features; 0.5 at the threshold."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -30, 30)))


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS) -> np.ndarray:
    """Weights that make the better of each pair win: logistic loss on feature differences, with weight decay."""
    draw = np.random.default_rng(2)
    n = min(pairs, max(len(good) * len(bad), 1))
    diff = good[draw.integers(len(good), size=n)] - bad[draw.integers(len(bad), size=n)]
    w, m, v = np.zeros(diff.shape[1]), 0.0, 0.0
    for step in range(1, STEPS + 1):
        lose = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        slope = -(lose @ diff) / n + DECAY * w
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def ranking(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> tuple[Model, DataFrame, dict[int, int]]:
    """Weights from labels (doc_id, quality) of the training split, without a threshold; the usable labels (doc_id, quality)
    and their number by quality, empty if there are not both labels."""
    size = len(features(""))
    usable = (
        labels.where(~common.held_out() & F.col("quality").isin(0, 1)).groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").select("doc_id", "quality")
    )
    n = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    even = Model(np.zeros(size), np.ones(size), np.zeros(size), 0.0)
    if len(n) < 2:
        return even, usable, {}
    at = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(2)), 11) / F.lit(float(2**53))
    share = F.when(F.col("quality") == 1, min(1.0, rows / n[1])).otherwise(min(1.0, rows / n[0]))
    picked = usable.where(at < share)  # at most about 2 * rows rows
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("quality", "text")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"quality": pdf["quality"], "x": [features(t).tobytes() for t in pdf["text"]]})

    got = sample.mapInPandas(run, "quality int, x binary").toPandas()
    if not len(got) or got["quality"].nunique() < 2:
        return even, usable, {}
    x = np.stack([np.frombuffer(b, "float32") for b in got["x"]])
    y = got["quality"].to_numpy()
    order = np.lexsort((*x.T[:8], y))  # the same pairs whatever order the rows came in
    x, y = x[order].astype("float64"), y[order]
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    return Model(mean, scale, bradley_terry(z[y == 1], z[y == 0]), 0.0), usable, n


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """A model from labels (doc_id, quality) of the training split; its threshold takes one pass over all texts."""
    model, usable, n = ranking(docs, labels, rows)
    if n:
        model.threshold = threshold(labelled(raws(docs.select("doc_id", "text"), model), usable), n)
    return model


def raws(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, ...) with the worth of each text (RAW) in place of the text, which is not shuffled."""
    import pyarrow as pa

    docs = common.without(docs, RAW)
    shared = common.share(docs.sparkSession, model)

    def run(batches):
        m = common.opened(shared)
        for batch in batches:
            for part in common.slices(batch):
                at = part.schema.get_field_index("text")
                x = np.stack([features(t) for t in part.column(at).to_pylist()]).astype("float64")
                rest = [(c, name) for i, (c, name) in enumerate(zip(part.columns, part.schema.names)) if i != at]
                yield pa.RecordBatch.from_arrays([*(c for c, _ in rest), pa.array(m.raw(x), pa.float64())], names=[*(name for _, name in rest), RAW])

    return common.mapped(docs, run, common.add_columns(docs.drop("text").schema, **{RAW: "double"}))


def labelled(worth: DataFrame, usable: DataFrame) -> DataFrame:
    """(quality, raw) of the rows of worth (doc_id, RAW) that usable (doc_id, quality) labels."""
    rows = worth.select("doc_id", F.col(RAW).alias("raw")).where("doc_id is not null")
    return common.stored(rows.join(usable, "doc_id").select("quality", "raw"), "quality-raw")


def threshold(rows: DataFrame, n: dict[int, int]) -> float:
    """Between the last of the sorted scores that make up the share of bad labels, and the next. rows (quality, raw) hold both
    labels; each label's rows weigh together as much as its n."""
    sums = [F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") == 1).alias("good"), F.min("raw").alias("low"), F.max("raw").alias("high")]
    whole = rows.agg(*sums).first()
    weight = (n[0] / whole["bad"], n[1] / whole["good"])
    weigh = lambda bad, good: bad * weight[0] + good * weight[1]
    here, (bad, good) = whole, (0, 0)  # the range that holds the quantile, and what is below it
    within = lambda r: rows.where((F.col("raw") >= r["low"]) & (F.col("raw") <= r["high"]))
    while here["bad"] + here["good"] > RANGE_ROWS and here["low"] < here["high"]:
        bin_ = F.least(F.floor((F.col("raw") - here["low"]) / F.lit((here["high"] - here["low"]) / RANGE_BINS)), F.lit(RANGE_BINS - 1))
        for part in sorted(within(here).groupBy(bin_.alias("bin")).agg(*sums).collect(), key=lambda r: r["low"]):
            here = part
            if weigh(bad + part["bad"], good + part["good"]) >= n[0]:
                break
            bad, good = bad + part["bad"], good + part["good"]
        else:
            bad, good = bad - here["bad"], good - here["good"]  # rounding only: the last one
    found = within(here).groupBy("raw", "quality").agg(F.count("*").alias("n")).collect()
    at = here["high"]
    for r in sorted(found, key=lambda r: (r["raw"], r["quality"])):
        one = ((1, 0), (0, 1))[r["quality"]]
        at, need = r["raw"], (n[0] - weigh(bad, good)) / weight[r["quality"]]
        last = max(1, int(np.ceil(need)))  # the row of these equal ones that makes up the share
        if last <= r["n"]:
            more = r["n"] > last or any(x["raw"] == at and x["quality"] > r["quality"] for x in found)
            break
        bad, good = bad + one[0] * r["n"], good + one[1] * r["n"]
    else:
        more = False
    if more:
        return float(at)
    above, below, same = rows.agg(F.min(F.when(F.col("raw") > at, F.col("raw"))), F.max(F.when(F.col("raw") < at, F.col("raw"))), F.count_if(F.col("raw") == at)).first()
    other = above if above is not None else at if same > 1 or below is None else below
    return float((at + other) / 2)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, ...) with score and predicted."""
    import pyarrow as pa

    docs = common.without(docs, *COLUMNS)
    shared = common.share(docs.sparkSession, model)

    def run(batches):
        m = common.opened(shared)
        for batch in batches:
            for part in common.slices(batch):
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                score = m.score(np.stack([features(t) for t in texts]).astype("float64"))
                made = [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype("int32"), pa.int32())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *COLUMNS])

    return common.mapped(docs, run, common.add_columns(docs.schema, **COLUMNS))


def judged(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """docs (doc_id, text, ...) without the texts, with score and predicted of a model fitted on labels (doc_id, quality).

    Like scored(docs, fit(docs, labels)), but every text is read once: its worth is stored, the threshold and the scores come
    from there."""
    model, usable, n = ranking(docs, labels, rows)
    worth = common.stored(raws(common.without(docs, *COLUMNS), model), "quality-worth")
    at = threshold(labelled(worth, usable), n) if n else 0.0
    z = F.least(F.greatest(F.col(RAW) - F.lit(at), F.lit(-30.0)), F.lit(30.0))
    out = worth.withColumn("score", 1 / (1 + F.exp(-z)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop(RAW)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judged(docs, common.table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", common.held_out().alias("held_out"), "score", "predicted")

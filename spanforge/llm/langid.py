"""Language identification as a multilingual mixture.

Per language a distribution over hashed byte trigrams of the lower-cased letters is learned from labelled texts. A
document's trigrams are taken as drawn from a mixture of languages: expectation-maximisation finds the proportions, and
languages are added to the set one by one as long as the penalised likelihood rises. The language with the largest
proportion is predicted; its proportion is the score.

The models are fitted on at most about ROWS whole texts of each language, picked by a hash (the documented bound);
which languages there are is taken from all training rows. Prediction reads every whole text.

Defined cases: null text, or one without a letter: `und`, score 0. No training row with a language: `und`. Null lang:
not learned from. Null doc_id: never held out. Repeated rows: each is predicted (and may be learned from twice). Empty
table: empty result. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import common

ROWS = 2000
BINS = 1 << 15
#: Added to each bin's count.
SMOOTH = 0.1
#: Log-likelihood that a further language must gain, in units of log(number of trigrams); trigrams overlap threefold.
PENALTY = 3.0
ROUNDS = 40
TOLERANCE = 1e-4
UNDETERMINED = "und"
COLUMNS = {"lang_pred": "string", "score": "double", "proportions": "map<string,double>"}

_TABLE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def bins(text: str) -> np.ndarray:
    """The bin of each trigram of the text's lower-cased words."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()) + b" "
    a = np.frombuffer(data, "uint8").astype("uint32")
    if len(a) < 3:
        return np.zeros(0, "int64")
    code = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype("int64")


class Model:
    """Trigram distributions of some languages."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.p = ((counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * BINS)).astype("float64")

    def mixture(self, text: str) -> list[tuple[str, float]]:
        """Languages of the text with their proportions, largest first."""
        count = np.bincount(bins(text), minlength=BINS)
        at = np.flatnonzero(count)
        if not len(at) or not self.languages:
            return []
        c, p = count[at].astype("float64"), self.p[:, at]
        n = c.sum()
        single = np.log(p) @ c
        chosen = [int(np.argmax(single))]
        share, mixed, likelihood = np.ones(1), p[chosen[0]], single[chosen[0]]
        while len(chosen) < len(self.languages):
            gain = (p / mixed) @ c - n  # slope of the likelihood towards each language
            gain[chosen] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= 0:
                break
            trial = [*chosen, new]
            s, m = self._fit(p[trial], c, n, np.append(share * 0.9, 0.1))
            more = np.log(m) @ c
            if more - likelihood <= PENALTY * np.log(n + 1):
                break
            chosen, share, mixed, likelihood = trial, s, m, more
        order = sorted(zip(share.tolist(), chosen), key=lambda x: (-x[0], x[1]))
        return [(self.languages[i], min(1.0, s)) for s, i in order]

    @staticmethod
    def _fit(p: np.ndarray, c: np.ndarray, n: float, share: np.ndarray):
        """Proportions by expectation-maximisation, and the mixed probability of each trigram."""
        for _ in range(ROUNDS):
            mixed = share @ p
            new = share * (p @ (c / mixed)) / n
            done = np.abs(new - share).max() < TOLERANCE
            share = new
            if done:
                break
        return share, share @ p


def fit(train: DataFrame, rows: int = ROWS) -> Model:
    """A model from the rows of train (doc_id, text, lang) whose lang is known."""
    import pandas as pd

    known = train.where("lang is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BINS)))
    share = known.sparkSession.createDataFrame([(k, min(1.0, rows / v)) for k, v in sizes.items()], "lang string, share double")
    at = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(9)), 11) / F.lit(float(2**53))
    sample = known.join(F.broadcast(share), "lang").where(at < F.col("share")).select("lang", "text")

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                if has_letter(text):
                    held[lang] = held.get(lang, 0) + np.bincount(bins(text), minlength=BINS)
        for lang, n in held.items():
            i = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bin": i, "n": n[i]})

    counts = np.zeros((len(languages), BINS))
    number = {k: i for i, k in enumerate(languages)}
    summed = sample.mapInPandas(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    for r in summed.toLocalIterator():  # at most languages * BINS rows
        counts[number[r["lang"]], r["bin"]] = r["n"]
    return Model(languages, counts)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, ...) with lang_pred, score and proportions."""
    import pyarrow as pa

    docs = common.without(docs, *COLUMNS)
    shared = common.share(docs.sparkSession, model)

    def run(batches):
        m = common.opened(shared)
        for batch in batches:
            for part in common.slices(batch):
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                found = [m.mixture(t) if has_letter(t) else [] for t in texts]
                made = [
                    pa.array([f[0][0] if f else UNDETERMINED for f in found], pa.string()),
                    pa.array([f[0][1] if f else 0.0 for f in found], pa.float64()),
                    pa.array(found, pa.map_(pa.string(), pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *COLUMNS])

    return common.mapped(docs, run, common.add_columns(docs.schema, **COLUMNS))


def trained(docs: DataFrame, train: Column | None = None) -> Model:
    """The model of the training split of docs."""
    return fit(docs.where(~common.held_out() if train is None else train).select("doc_id", "text", "lang"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identified(docs.select("doc_id", "text"), trained(docs))
    return out.select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score", F.size("proportions").alias("n_languages"))

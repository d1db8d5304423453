"""Field classifier: character n-grams inside word bounds with sublinear term weights, smoothed inverse document frequencies
and unit length; one logistic regression a variable over labels that carry the value. Its confidence goes into notes only;
values come from the evidence.

The models share one vocabulary, all n-grams of the texts that they are fitted on (no two share a place), and each ignores those
that its own rows lack. Everything stays in the JVM; the predictions of all variables are made on the report's own row, without a
join or a shuffle of texts. Blank texts get no prediction. Saved models come with a manifest that holds a digest of what they were
fitted on: other texts or annotations are fitted anew."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, ElementwiseProduct, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.functions import patterns as P
from spanforge.operators import extract

#: More n-grams than there can be: none is left out.
VOCABULARY = (1 << 31) - 1
ITERATIONS = 2000
TOLERANCE = 1e-4
PARTITION_ROWS = 5000
PARTITION_SCORES = 100_000

# Labels without a value, and the notes of the method.
ABSENT = "__ABSENT__"
CANNOT_ASSIGN = "__CANNOT_ASSIGN__"
CONFLICT = "__CONFLICT__"
NEGATED = "__NEGATED__"
UNCERTAIN = "__UNCERTAIN__::"
SELECTED_NOTE = "Evidence-anchored hybrid candidate selected (classifier confidence=%.2f)."
WITHHELD_NOTE = "No evidence-anchored candidate was found; a classifier-only suggestion was withheld (confidence=%.2f)."

_OPEN = "struct<v:struct<type:tinyint,size:int,indices:array<int>,values:array<double>>>"
_SEALED = T.StructType([T.StructField("v", VectorUDT())])
PREDICTION = "array<struct<variable_name:string,label:string,confidence:double,probabilities:map<string,double>>>"


def label_of(status: Column, value: Column) -> Column:
    """The class of a gold annotation: its value, marked where uncertain, or the reason why there is none."""
    v = F.trim(F.coalesce(value, F.lit("")))
    return (
        F.when(status == "conflicting", CONFLICT).when(status == "negated", NEGATED).when((v == "") & (status == "cannot_be_assigned"), CANNOT_ASSIGN)
        .when(v == "", ABSENT).when(status == "uncertain", F.concat(F.lit(UNCERTAIN), v)).otherwise(v)
    )


def decoded(label: Column) -> Column:
    """struct(value, status) that a label stands for; a plain value has no status of its own."""
    marked = label.startswith(UNCERTAIN)
    status = (
        F.when(label == ABSENT, "not_documented").when(label == CANNOT_ASSIGN, "cannot_be_assigned").when(label == CONFLICT, "conflicting")
        .when(label == NEGATED, "negated").when(marked, "uncertain")
    )
    value = F.when(marked, F.substring(label, len(UNCERTAIN) + 1, F.length(label))).when(status.isNull(), label)
    return F.struct(value.alias("value"), status.alias("status"))


def ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Lower-cased character n-grams of each word, padded with a blank on both sides; none longer than the padded word."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w: Column, n: int) -> Column:
        last = F.length(w) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(padded, lambda w: F.flatten(F.array(*[grams(w, n) for n in range(low, high + 1)]))))


def sublinear(counts: Column) -> Column:
    """A sparse vector of 1 + ln(count). Vectors have no functions of their own in SQL: opened and closed by way of JSON."""
    v = F.from_json(F.to_json(F.struct(counts.alias("v"))), _OPEN)["v"]
    values = F.transform(v["values"], lambda n: 1 + F.ln(n))
    again = F.struct(v["type"].alias("type"), v["size"].alias("size"), v["indices"].alias("indices"), values.alias("values"))
    return F.from_json(F.to_json(F.struct(again.alias("v"))), _SEALED)["v"]


def _grams(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__grams", ngrams(F.coalesce("text", F.lit(""))))


def vocabulary(rows: DataFrame, most: int = VOCABULARY) -> CountVectorizerModel:
    """The n-grams of rows (text, ...), each with a place of its own."""
    return CountVectorizer(inputCol="__grams", outputCol="__tf", vocabSize=most, minDF=1.0).fit(_grams(rows))


def weighted_terms(rows: DataFrame, terms: CountVectorizerModel) -> DataFrame:
    """rows (text, ...) with __terms, the n-grams of a vocabulary with sublinear weights."""
    out = terms.transform(_grams(rows))
    return out.withColumn("__terms", sublinear(F.col("__tf"))).drop("__grams", "__tf")


def cohort(gold: DataFrame, most: int) -> DataFrame:
    """Gold rows of at most `most` reports, picked by a hash of their ids, for the train job's --most; no query fits on a sample.
    It is so small that joins take it to the texts, not the texts to it."""
    picked = gold.select("report_id").distinct().orderBy(F.xxhash64("report_id"), "report_id").limit(most)
    return F.broadcast(gold.join(F.broadcast(picked), "report_id", "left_semi"))


def training(gold: DataFrame, texts: DataFrame) -> DataFrame:
    """(variable_name, text, label, weight): labels of gold annotations with balanced class weights. A variable with one label
    only gets one more row, an absent value for its first text, as contrast."""
    known = gold.where(F.col("variable_name").isin(*P.VARIABLES)).join(texts.where("text is not null").select("report_id", "text").hint("merge"), "report_id")
    rows = known.select("variable_name", "text", label_of(F.col("gold_status"), F.col("gold_value")).alias("label"))
    single = rows.groupBy("variable_name").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("text").alias("text")).where("low = high")
    rows = rows.unionByName(single.select("variable_name", "text", F.lit(ABSENT).alias("label")))
    n = rows.groupBy("variable_name", "label").agg(F.count("*").alias("n"))
    total = n.groupBy("variable_name").agg(F.sum("n").alias("all"), F.count("*").alias("classes"))
    weights = n.join(total, "variable_name").select("variable_name", "label", (F.col("all") / (F.col("classes") * F.col("n"))).alias("weight"))
    return rows.join(weights, ["variable_name", "label"])


def label_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("variable_name", "label").agg(F.count("*").alias("n"))


def fit(rows: DataFrame, iterations: int = ITERATIONS, terms: CountVectorizerModel | None = None) -> PipelineModel:
    """The model of one variable: label index, vocabulary, term weights, unit length, regression. rows (text, label, weight)."""
    counted = rows.agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels")).first()
    if counted["n"] < 2 or counted["labels"] < 2:
        raise ValueError("a model needs two labelled texts and two labels")
    # each step of the solver is a job, and every task of it holds a slope for each label and n-gram: as few partitions as the rows
    # need, and as many cores as the scores (rows times labels) do
    cores, scores = rows.sparkSession.sparkContext.defaultParallelism, counted["n"] * counted["labels"]
    few = rows.repartition(max(1 + counted["n"] // PARTITION_ROWS, min(cores, 1 + scores // PARTITION_SCORES)))
    terms = terms or vocabulary(few)
    known = weighted_terms(few, terms).cache()
    index = StringIndexer(inputCol="label", outputCol="__target", stringOrderType="alphabetAsc").fit(known)
    rare = IDF(inputCol="__terms", outputCol="__idf").fit(known)
    rarity = (rare.idf.toArray() + 1.0) * [n > 0 for n in rare.docFreq]  # other variables' n-grams weigh nothing
    weigh = ElementwiseProduct(scalingVec=DenseVector(rarity), inputCol="__terms", outputCol="__weighed")
    unit = Normalizer(inputCol="__weighed", outputCol="__features", p=2.0)
    # the penalty |w|^2 / 2 stands against the sum of the losses; Spark takes their mean
    regression = LogisticRegression(
        featuresCol="__features", labelCol="__target", weightCol="weight", maxIter=iterations, tol=TOLERANCE, regParam=1.0 / counted["n"],
        standardization=False, family="multinomial", probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__at",
    )
    fitted = regression.fit(unit.transform(weigh.transform(index.transform(known))))
    known.unpersist()
    # the summary of a fit with two labels holds the session, which cannot go to executors once it has observed a metric
    fitted._java_obj.setSummary(rows.sparkSession._jvm.scala.Option.empty())
    return PipelineModel([index, terms, weigh, unit, fitted])


def fit_all(gold: DataFrame, texts: DataFrame, iterations: int = ITERATIONS) -> dict[str, PipelineModel]:
    """A model for each variable; ValueError where a variable has fewer than two labelled texts or labels. The four fits are
    chains of small jobs, so they run side by side."""
    rows = training(gold, texts).cache()
    try:
        terms = vocabulary(rows.select("text").distinct())
        one = lambda v: fit(rows.where(F.col("variable_name") == v).drop("variable_name"), iterations, terms)
        with ThreadPoolExecutor(len(P.VARIABLES)) as pool:
            return dict(zip(P.VARIABLES, pool.map(one, P.VARIABLES)))
    finally:
        rows.unpersist()


def annotated(reports: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """reports (text, ...) with predictions: variable, best label, its confidence and the probabilities of all labels, for each
    model; null for blank texts."""
    terms = [m.stages[1] for m in models.values()]
    if any(t.vocabulary != terms[0].vocabulary for t in terms[1:]):
        raise ValueError("the models must share one vocabulary")
    out, made = weighted_terms(extract.spread(reports), terms[0]), []
    for v, m in models.items():
        index, _, weigh, unit, fitted = m.stages
        for stage in (weigh, unit, fitted):
            out = stage.transform(out)
        labels, p = F.array(*map(F.lit, index.labels)), vector_to_array("__p")
        best = F.array_max(F.transform(p, lambda x, i: F.struct(x.alias("p"), (-i).alias("i"))))  # the first of equal ones
        one = F.struct(F.lit(v).alias("variable_name"), F.get(labels, -best["i"]).alias("label"), best["p"].alias("confidence"), F.map_from_arrays(labels, p).alias("probabilities"))
        name = f"__m{len(made)}"
        out = out.withColumn(name, one).drop("__weighed", "__features", "__raw", "__p", "__at")
        made.append(name)
    there = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    return out.withColumn("predictions", F.when(there, F.array(*made)).cast(PREDICTION)).drop("__terms", *made)


def predicted(reports: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """A row for each report and variable: label, confidence, probabilities, and what the label stands for."""
    # the plain generator would infer a filter on the array and compute it twice more
    rows = annotated(reports, models).select("report_id", F.inline_outer("predictions")).where("variable_name is not null")
    says = decoded(F.col("label"))
    return rows.withColumn("suggested_value", says["value"]).withColumn("suggested_status", says["status"])


def noted(fields: DataFrame) -> DataFrame:
    """Fields with the report's predictions: the notes of method `ml` led by what the model adds. Without a prediction the notes
    stay."""
    at = F.get(F.filter("predictions", lambda p: p["variable_name"] == F.col("variable_name")), F.lit(0))["confidence"]
    lead = F.when(F.col("extracted_value").isNull(), F.format_string(WITHHELD_NOTE, at)).otherwise(F.format_string(SELECTED_NOTE, at))
    notes = F.when(at.isNull() | (F.col("method") != "ml"), F.col("notes")).otherwise(F.trim(F.concat_ws(" ", lead, "notes")))
    return fields.withColumn("notes", notes).drop("predictions")


def save(models: dict[str, PipelineModel], path: str, facts: dict | None = None) -> None:
    """Write the models of all variables below path, over those that are there, and last what they were fitted on."""
    if set(models) != set(P.VARIABLES):
        raise ValueError("a model of each variable is needed")
    for v, m in models.items():
        m.write().overwrite().save(f"{path}/{v}")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(facts or {}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load(path: str) -> dict[str, PipelineModel]:
    return {v: PipelineModel.load(f"{path}/{v}") for v in P.VARIABLES}


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What the saved models were fitted on; None if there are none, or they were never completed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    last = [spark._jvm.org.apache.hadoop.fs.Path(folder, f"{v}/_SUCCESS") for v in ("manifest", *(f"{v}/metadata" for v in P.VARIABLES))]
    return json.loads(spark.read.text(f"{path}/manifest").head()[0]) if all(map(there.exists, last)) else None


def facts(gold: DataFrame, texts: DataFrame) -> dict:
    """What a fit rests on: number of reports, labels of each variable, and a digest of the labelled texts in any order.

    gold is a cohort, whose size is bounded, so the digests of its rows fit one array."""
    rows = gold.where(F.col("variable_name").isin(*P.VARIABLES)).join(texts.where("text is not null").select("report_id", "text"), "report_id")
    rows = rows.select("report_id", "variable_name", label_of(F.col("gold_status"), F.col("gold_value")).alias("label"), F.sha2(F.col("text").cast("binary"), 256).alias("t"))
    own = F.sha2(F.concat_ws("\0", "report_id", "variable_name", "label", "t").cast("binary"), 256)
    n, digest = rows.agg(F.countDistinct("report_id"), F.sha2(F.array_join(F.array_sort(F.collect_list(own)), "").cast("binary"), 256)).head()
    counts: dict[str, dict] = {}
    for r in label_counts(rows).orderBy("variable_name", "label").collect():
        counts.setdefault(r["variable_name"], {})[r["label"]] = r["n"]
    return {"reports": n, "digest": digest, "label_counts": counts}


def default(spark: SparkSession, path: str, gold: DataFrame, texts: DataFrame) -> dict[str, PipelineModel]:
    """The saved models if they were fitted on these very texts and annotations, or if there is nothing to fit from; else they are
    fitted and saved."""
    known, now = manifest(spark, path), facts(gold, texts)
    if known is None or now["reports"] and known.get("digest") != now["digest"]:
        save(fit_all(gold, texts), path, now)
    return load(path)


def confusion(found: DataFrame, gold: DataFrame) -> DataFrame:
    """(variable_name, label, gold_label, n): predicted labels against those of gold annotations."""
    known = gold.select("report_id", "variable_name", label_of(F.col("gold_status"), F.col("gold_value")).alias("gold_label"))
    return found.join(known.hint("merge"), ["report_id", "variable_name"]).groupBy("variable_name", "label", "gold_label").agg(F.count("*").alias("n"))

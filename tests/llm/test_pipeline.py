from pyspark.sql import functions as F

import corpus_pipeline
from spanforge.llm import decontam, sharding
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(10_001, "!!! 123", "en", "src0", 7), (10_002, None, None, None, None), (10_003, docs.head()["text"], "en", "src1", 5)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    told = stage["language"](spark, docs, SF)
    assert told.columns == columns and {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in told.collect()} == {10_001, 10_002}
    rows = [(r["doc_id"], r["text"]) for r in told.collect()]
    once = stage["near_duplicates"](spark, told, SF)
    want = {d for d, (n, c) in brute(rows, 5, 80).items() if d == c}
    assert once.columns == columns and sorted(r["doc_id"] for r in once.collect()) == sorted(want)
    clean = stage["decontaminated"](spark, once, SF)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 10]) for w in (decontam.words(t) for _, t in items) for i in range(max(1, len(w) - 9)) if w}
    hit = lambda t: any(tuple(w[i : i + n]) in grams for w in [decontam.words(t)] for n in {len(g) for g in grams} for i in range(len(w) - n + 1))
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in once.collect() if not hit(r["text"])}
    mixed = stage["mixed"](spark, clean, SF)
    assert mixed.columns == columns and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in clean.collect()}
    last = stage["sharded"](spark, mixed, SF)
    assert last.count() == mixed.count() and set(columns) < set(last.columns)


def test_columns_of_any_name_keep_their_values(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = ["rank", "position", "positions", "size", "a.b", "shard", "cid", "n", "__gone", "__at", "__mid", "__key", "__range", "__row", "__file", "__first"]
    docs = docs.select("*", *[F.concat(F.lit(f"{c}:"), "doc_id").alias(c) for c in extra])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        back = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "sharded":
            assert back.columns == docs.columns
        for c in extra:
            if not (name == "sharded" and c in sharding.OUTPUTS):
                assert back.where(F.col(f"`{c}`") != F.concat(F.lit(f"{c}:"), "doc_id")).count() == 0
        docs = back
    assert docs.count() == spark.read.parquet(f"{tmp_path}/mixed").count() > 0


def test_shards_keep_the_training_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"{'w ' * 10}{i}", "en", s, 0) for i in range(900) for s in "abc"], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)
    stage["mixed"](spark, docs, SF).write.parquet(f"{tmp_path}/mixed")
    got = stage["sharded"](spark, spark.read.parquet(f"{tmp_path}/mixed"), SF).collect()
    share = lambda source, shards: sum(r["source"] == source for r in got if r["shard"] in shards)
    assert share("a", range(4)) > 1.5 * share("a", range(12, 16)) and share("c", range(12, 16)) > 1.5 * share("c", range(4))
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(16)]
    assert max(sizes) - min(sizes) <= 60
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_no_language_to_learn(spark):
    docs = spark.createDataFrame([(1, "some words", None, "a", 1), (2, "12 !", None, "a", 1), (3, None, None, "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).collect()] == [1]


def test_repeated_ids_with_other_texts(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text("a"), "en", "s", 1), (2, text("a"), "en", "s", 1), (2, text("b"), "en", "s", 1), (2, text("b"), "en", "s", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == [(1, text("a")), (2, text("b"))]


def test_run(spark):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0

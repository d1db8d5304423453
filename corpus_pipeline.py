"""The corpus pipeline: language, near duplicates, benchmark passages, mixing, shards.

Each stage takes (spark, docs, sf_dir), works on every row of docs (doc_id, text, lang, source, ...) and returns a DataFrame;
all but the last return the columns of docs, with the values that they had. Between stages the rows are written as Parquet
and read again. Other columns may have any name, also one that an operator gives to an output, or one with dots. The stages
set the session's Arrow batch to few rows where rows carry whole texts to Python workers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import common, decontam, jaccard, langid, mixing, sharding

READ = ("doc_id", "text", "lang", "source")


def _through(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that the operator makes of docs, with the columns of docs only; no column that it doesn't read can clash with
    its own."""
    names = [c if c in READ else f"__c{i}" for i, c in enumerate(docs.columns)]
    out = operator(docs.select(*[common.named(c).alias(n) for c, n in zip(docs.columns, names)]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    Null or empty text, or one without a letter: goes. Where nothing can be learned (no training row has a language), documents
    with a letter stay. Long texts are read whole. Repeated rows: each is judged. Empty table: empty result."""
    common.set_batch_rows(spark, common.BATCH_ROWS)
    model = langid.trained(docs)
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return _through(docs, lambda d: langid.identified(d, model).where(F.col("lang_pred") != langid.UNDETERMINED))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more, that of the smallest doc_id.

    Null or empty text: linked with nothing, stays. Null doc_id: after all others. Rows with equal doc_id and text: one stays;
    with equal doc_id and other texts: told apart. Ties: the smaller digest of the text. Empty table: empty result."""
    return jaccard.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window (ten words, or a whole shorter item) of a benchmark item.

    Null or empty text: stays. Long texts are read whole. Repeated rows: each is judged. Empty tables: nothing goes."""
    common.set_batch_rows(spark, common.BATCH_ROWS)
    return decontam.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, written in training order.

    Null or empty text: no words, so never taken. Null source: a source of its own. Null doc_id, repeated rows: each row counts.
    A long text is taken whole or not. Ties in position: by doc_id. Empty table: empty result."""
    return _through(docs, lambda d: mixing.training_order(mixing.curriculum(d)))


def _in_file_order(docs: DataFrame, file: str, row: str) -> DataFrame | None:
    """docs with the place of each row in files numbered by Spark's writer, under these names; None if docs is no such table."""
    try:
        part, piece = (f"coalesce(try_cast(regexp_extract(_metadata.file_name, '{p}', 1) as bigint), 0)" for p in ("^part-([0-9]+)-", "[.-]c([0-9]+)[.]"))
        return docs.select("*", F.expr(f"{part} * 1000000 + {piece}").alias(file), F.col("_metadata.row_index").alias(row))
    except AnalysisException:
        return None


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its shard and slot; shards are near equal in bytes.

    The rows of a written table keep their order: shards are stretches of it and slots follow it, so the curriculum of the
    stage before holds. Rows that come from elsewhere are placed by their text. Null text: size 1. Null doc_id, repeated rows:
    each row has its slot. Columns named like an output are replaced. Empty table: empty result."""
    common.set_batch_rows(spark, common.NARROW_ROWS)
    free = next(n for n in (f"__place{i}" for i in range(len(docs.columns) + 1)) if not {f"{n}_file", f"{n}_row"} & set(docs.columns))
    place = f"{free}_file", f"{free}_row"
    placed = _in_file_order(docs, *place)
    if placed is None:
        return sharding.shards(docs)
    return sharding.shards(placed, place=place).drop(*place)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("mixed", mixed),
    ("sharded", sharded),
]

#: The first stage's model cannot be expressed in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""What several operators share: tables, split rule, shared folders, crash-safe cuts."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder of its own (tests, single machines).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str = "doc_id") -> Column:
    """True where crc32 of the key as text leaves 1 when divided by 3; a null key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's own, or a local one if none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    root = root or LOCAL_CHECKPOINTS
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder once and go on from there: short lineage that outlives executors."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """A new folder below the shared one for an operator's intermediate tables; `drop` deletes it when they have been read."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.path, self.n = spark, shared_path(spark, what), 0

    def stored(self, df: DataFrame, what: str, texts: bool = False) -> DataFrame:
        """Like the function `stored`, in this folder. texts: workers get whole texts, so in small batches."""
        self.n += 1
        path = f"{self.path}/{self.n}-{what}"
        with batch_rows(self.spark, BATCH_ROWS if texts else NARROW_ROWS):
            df.write.mode("error").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that go to a Python worker at a time where they carry whole texts, and where they don't.
BATCH_ROWS = 1000
NARROW_ROWS = 10_000


def set_batch_rows(spark: SparkSession, rows: int) -> str:
    """Set the rows of the session's Arrow batches; what was set before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    return before


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of so many rows for what runs inside: the JVM and the worker each hold a batch."""
    before = set_batch_rows(spark, rows)
    try:
        yield
    finally:
        set_batch_rows(spark, int(before))


def give_back() -> None:
    """Return freed memory to the system: Python workers live on after their task."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # only glibc has it


def relieved(run):
    """run (batches -> batches), which gives its memory back when the task has ended."""

    def go(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return go


def named(column: str) -> Column:
    """The top-level column of this very name, also if it holds dots or backticks."""
    return F.col("`" + column.replace("`", "``") + "`")


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema), also where columns of df have names that Spark would take apart; run finds them renamed."""
    from pyspark.sql import types as T

    run = relieved(run)
    names = [f"__c{i}" if {".", "`"} & set(c) else c for i, c in enumerate(df.columns)]
    if names == df.columns:
        return df.mapInArrow(run, schema)
    safe = dict(zip(df.columns, names))
    renamed = T.StructType([T.StructField(safe.get(f.name, f.name), f.dataType, f.nullable) for f in schema.fields])
    out = df.select(*[named(c).alias(n) for c, n in safe.items()]).mapInArrow(run, renamed)
    return out.select(*[F.col(f.name).alias(g.name) for f, g in zip(renamed.fields, schema.fields)])


def through(docs: DataFrame, read: tuple[str, ...], outputs: tuple[str, ...], operator) -> DataFrame:
    """operator(docs) with all columns of docs under their own names, whatever these are, and the outputs; a column named like an
    output gives way. The operator finds the columns that it doesn't read under names that can't clash with its own."""
    taken = {o.lower() for o in outputs}
    kept = [c for c in docs.columns if c.lower() not in taken]
    safe = {c: c if c in read else f"__c{i}" for i, c in enumerate(kept)}
    out = operator(docs.select(*[named(c).alias(n) for c, n in safe.items()]))
    return out.select(*[F.col(n).alias(c) for c, n in safe.items()], *outputs)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names: an operator's own outputs win over clashing inputs."""
    taken = {n.lower() for n in names}
    return df.select(*[named(c) for c in df.columns if c.lower() not in taken])


#: Words of the size counts and of shingles: runs of anything but ASCII white space.
WHITE = r"[\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    """Number of runs of other characters than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")

#: Text that a Python worker holds as words at a time; a longer text stands alone.
SLICE_BYTES = 8 << 20


def slices(batch, column: str = "text", limit: int = SLICE_BYTES):
    """Consecutive parts of an Arrow batch of at most about `limit` bytes of text each."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    part = np.concatenate([[0], np.cumsum(size, dtype="int64")[:-1]]) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def add_columns(schema, **columns: str):
    """A StructType of schema plus columns of these DDL types."""
    from pyspark.sql import types as T

    return T.StructType([*schema.fields, *T._parse_datatype_string(", ".join(f"`{k}` {v}" for k, v in columns.items())).fields])


def share(spark: SparkSession, value):
    """A broadcast of a value of this package's classes, pickled with them; `opened` gives it back on a worker."""
    from pyspark import cloudpickle

    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(shared):
    import pickle

    return pickle.loads(shared.value)

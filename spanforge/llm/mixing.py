"""Mixing sources to target weights with a time-varying curriculum.

Each source gets a target (its weight's share of the mix, never more than `cap` times its own size;
what is cut off goes to the others by weight). A source's documents stand in a fixed random order that is
read in whole epochs and one partial epoch until the target is met, so what it gives is within half a
document of the target. A weight schedule over training time is integrated per source; the inverse of that
integral turns "so many words of this source demanded" into a training position in [0, 1], and documents
are range-sorted by position.

Defined cases: null source: a source of its own, ranked last. Null or empty text: size 0, taken 0. Sources
without words: target 0. Null doc_id: ordered like the text ''. Repeated rows: each counts and is placed.
Empty table: empty result. Input columns named like an output column are replaced; other names are free and may hold dots.

Scale: one narrow shuffle on (source, hash bucket), so a source with a third of all rows is spread over
thousands of buckets; running sums are per bucket, then per source over at most 16**bucket_digits rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.llm import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: Knots (time, multiple of the mean weight) of the weight schedules; sources take them in turn.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
OUTPUTS = ("size", "source_size", "target", "taken", "copies", "positions", "position")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(src_key, source, source_size) -> the same with rank, weight and target: min(cap * size, level * weight)."""
    everything = Window.partitionBy()
    ranked = (
        sizes.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("most", (F.lit(cap) * F.col("source_size")).cast("double"))
    )
    by_room = everything.orderBy(F.col("most") / F.col("weight"), "rank")
    total = F.sum("source_size").over(everything)
    level = (
        ranked.withColumn("budget", F.least(F.lit(float(share)) * total, (F.lit(cap) * total).cast("double")))
        .withColumn("place", F.row_number().over(by_room))
        .withColumn("before", F.coalesce(F.sum("most").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("before")) / F.col("weight_left"))
        .withColumn("free", F.col("most") > F.col("level") * F.col("weight"))
    )
    first = F.min(F.when(F.col("free"), F.struct("place", "level"))).over(everything)
    return level.withColumn("first", first).select(
        "src_key", "source", "source_size", "rank",
        F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), F.col("most"))
        .otherwise(F.col("first.level") * F.col("weight")).alias("target"),
    )


def _inverse(u: Column, knots) -> Column:
    """The time at which the integral of a piecewise linear schedule, scaled to end at 1, reaches u."""
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
    found, done = F.lit(1.0), 0.0
    for (t0, w0), (t1, w1) in reversed(list(zip(knots, knots[1:]))):
        done = sum((b - a) * (x + y) / 2 for (a, x), (b, y) in zip(knots, knots[1:]) if b <= t0)
        need = u * F.lit(area) - F.lit(done)
        slope = (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * need, F.lit(0.0)))
        step = F.lit(2.0) * need / (F.lit(float(w0)) + root)
        found = F.when(u * F.lit(area) >= F.lit(done), F.lit(t0) + step).otherwise(found)
    return F.least(F.greatest(found, F.lit(0.0)), F.lit(1.0))


def position(u: Column, rank: Column, schedules=SCHEDULES) -> Column:
    """Training position of the share u of a source's demand, by the schedule of the source's rank."""
    chosen = _inverse(u, schedules[-1])
    for i, knots in list(enumerate(schedules))[:-1]:
        chosen = F.when((rank - 1) % len(schedules) == i, _inverse(u, knots)).otherwise(chosen)
    return chosen


def curriculum(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, schedules=SCHEDULES,
               bucket_digits: int = 3) -> DataFrame:
    """docs (doc_id, source, text, ...) with size, source_size, target, taken, copies and positions array<double>."""
    made = tuple(c for c in OUTPUTS if c != "position")
    return common.through(common.without(docs, *OUTPUTS), ("doc_id", "source", "text"), made, lambda d: _curriculum(d, weights, share, cap, schedules, bucket_digits))


def _curriculum(docs: DataFrame, weights, share: float, cap: int, schedules, bucket_digits: int) -> DataFrame:
    keyed = (
        docs
        .withColumn("size", common.n_words("text"))
        .withColumn("__key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
        .withColumn("__tie", F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(-1)))
        .withColumn("__bucket", F.substring("__key", 1, bucket_digits))
        .withColumn("__src", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")))
    )
    narrow = keyed.select("__src", "source", "__bucket", "size")
    sums = common.stored(narrow.groupBy("__src", "__bucket").agg(F.first("source").alias("source"), F.sum("size").alias("__sum")), "mix")
    per_source = targets(
        sums.groupBy(F.col("__src").alias("src_key")).agg(F.first("source").alias("source"), F.sum("__sum").alias("source_size")),
        weights, share, cap,
    )
    in_order = Window.partitionBy("__src").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sums.withColumn("__before", F.coalesce(F.sum("__sum").over(in_order), F.lit(0)))
        .join(per_source.drop("source"), F.col("__src") == F.col("src_key"))
        .select("__src", "__bucket", "__before", "source_size", F.col("rank").alias("__rank"), "target")
    )
    inside = Window.partitionBy("__src", "__bucket").orderBy("__key", "doc_id", "size", "__tie")
    mid = F.col("__before") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("size") / 2
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - F.col("__whole") * F.col("source_size")
    u = lambda k: F.least((k * F.col("source_size") + F.col("__mid")) / F.col("target"), F.lit(1.0))
    return (
        keyed.join(offsets, ["__src", "__bucket"])
        .withColumn("__mid", mid)
        .withColumn("__whole", whole)
        .withColumn("copies", F.when(F.col("size") > 0, F.col("__whole") + F.when(F.col("__mid") <= rest, 1).otherwise(0)).otherwise(F.lit(0)))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .withColumn("positions", F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda k: position(u(k), F.col("__rank"), schedules))).otherwise(F.array().cast("array<double>")))
        .drop("__src", "__bucket", "__key", "__tie", "__before", "__mid", "__whole", "__rank")
    )


def range_sorted(mixed: DataFrame, by: str = "position") -> DataFrame:
    """Rows in training order: range-partitioned by position and sorted within the ranges."""
    return mixed.repartitionByRange(F.col(by).asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(F.col(by).asc_nulls_last(), "doc_id")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for each time a document is taken, in training order."""
    return range_sorted(mixed.withColumn("position", F.explode("positions")).drop("positions"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = curriculum(docs).select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("first_position"))
    return range_sorted(mixed, "first_position")


def _sql_inverse(knots) -> str:
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
    found = "1.0::double"
    for (t0, w0), (t1, w1) in reversed(list(zip(knots, knots[1:]))):
        done = sum((b - a) * (x + y) / 2 for (a, x), (b, y) in zip(knots, knots[1:]) if b <= t0)
        slope = (w1 - w0) / (t1 - t0)
        need = f"(u * {area}::double - {done}::double)"
        found = f"case when u * {area}::double >= {done}::double then {t0}::double + 2.0::double * {need} / ({float(w0)}::double + sqrt(greatest({w0 * w0}::double + {2 * slope}::double * {need}, 0.0::double))) else {found} end"
    return f"least(greatest({found}, 0.0::double), 1.0::double)"


ORACLE = f"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         md5(coalesce(doc_id::varchar, '')) as k from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source asc nulls last) as rank from s),
w as (select *, [3, 1, 2][(rank - 1) % 3 + 1] as weight, (2 * source_size)::double as most, (sum(source_size) over ())::double as total from r),
l as (select *, row_number() over o as place,
        (least(1.5::double * total, 2::double * total) - coalesce(sum(most) over (o rows between unbounded preceding and 1 preceding), 0::double))
          / (sum(weight) over (o rows between current row and unbounded following))::double as level
      from w window o as (order by most / weight, rank)),
f as (select min(place) as place from l where most > level * weight),
t as (select l.source, l.source_size, l.rank,
        case when f.place is null or l.place < f.place then l.most
             else (select level from l where place = (select place from f)) * l.weight end as target
      from l, f),
m as (select d.doc_id, d.size, t.source_size, t.rank, t.target,
        (coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0))::double + d.size / 2.0::double as mid,
        case when t.source_size > 0 then floor(t.target / t.source_size)::bigint else 0 end as whole
      from d join t on d.source is not distinct from t.source),
c as (select *, case when size = 0 then 0 else whole + (case when mid <= target - whole * source_size then 1 else 0 end) end as copies,
        least(mid / target, 1.0::double) as u from m)
select doc_id, size, source_size, target, (copies * size)::bigint as taken,
  case when copies = 0 then null when (rank - 1) % 3 = 0 then {_sql_inverse(SCHEDULES[0])}
       when (rank - 1) % 3 = 1 then {_sql_inverse(SCHEDULES[1])} else {_sql_inverse(SCHEDULES[2])} end as first_position
from c
"""

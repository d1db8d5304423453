"""Sharding by sampled splitters.

Records have the key (hash of the text, doc_id), so equal texts lie side by side. A sample of keys, drawn with
a probability in proportion to the record's size, gives quantile boundaries; they cut the records into many more
ranges than shards, and a range that comes out overfull is sampled again and subdivided (a text with very many
copies is cut by doc_id). Exact bytes and rows of each range, summed over the ranges before it, turn the place
within a range into a global place, and shard = place in bytes * shards / all bytes. So the sample decides only
how evenly the work is spread, never the result. Records of equal text form a group, which goes whole into one shard unless it is larger than a whole
share. Groups above 1 / GROUP_PART of a share (there are few) are dealt first, the largest into the emptiest shard; the others fill
the room that is left, in the order of their keys, each where its middle falls. Larger groups than a share are cut by doc_id. So
shards differ from the mean by less than a GROUP_PART of a share, or one record, on either side, as long as large groups fit evenly.

Records may be placed by two long columns instead of their text (`place`), as for a corpus in training order: then shards
are consecutive stretches of that order, slots follow it, and there are no groups.

Defined cases: null text: no bytes, size 1, crc 0, before all other texts. Null doc_id: before all others of its
text. Repeated rows: each has its own slot. Empty table: empty result. Input columns named like an output column are
replaced; column names may hold dots. A record larger than a shard's share fills it alone; a shard may then be empty.

Scale: the shuffle is on the range, of which none is a hot key; the number of ranges follows the bytes (RANGE_BYTES), so a task's
share stays the same at any size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.llm import common

SHARDS = 16
#: Ranges for each shard, and sampled keys for each range.
RANGES_PER_SHARD = 16
SAMPLE_PER_RANGE = 16
#: A range is overfull above so many times the mean; it is subdivided at most so often.
OVERFULL = 2.0
#: Bytes of a range at most about; there are RANGES_PER_SHARD ranges a shard at least.
RANGE_BYTES = 256 << 20
#: Groups of equal texts above 1 / GROUP_PART of a shard's share are dealt to shards first, whole; only those above a whole share are cut.
GROUP_PART = 20
ROUNDS = 3
LEAST = -(2**63)
OUTPUTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _packed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs of signed 64-bit numbers as 16 bytes that sort like the pairs."""
    out = np.empty((len(a), 2), dtype=">u8")
    for i, x in enumerate((a, b)):
        out[:, i] = x.astype("int64").view("uint64") ^ np.uint64(1 << 63)
    return out.view("S16").ravel()


def range_of(key: Column, tie: Column, splitters: np.ndarray) -> Column:
    """Number of the range between the sorted splitters (pairs); the first is 0."""
    bounds = _packed(splitters[:, 0], splitters[:, 1]) if len(splitters) else np.empty(0, "S16")

    @F.pandas_udf("int")
    def find(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, _packed(a.to_numpy(), b.to_numpy()), side="right").astype("int32"))

    return find(key, tie)


def _drawn(keyed: DataFrame, per_byte: float) -> np.ndarray:
    """Keys drawn with probability size * per_byte, by a hash of the record: reruns draw the same."""
    at = F.shiftrightunsigned(F.xxhash64("__key", "__tie", F.lit(17)), 11) / F.lit(float(2**53))
    rows = keyed.where(at < F.col("size") * F.lit(per_byte)).select("__key", "__tie").toPandas()
    return rows.to_numpy(dtype="int64").reshape(-1, 2)


def _sorted(pairs: np.ndarray) -> np.ndarray:
    return np.unique(pairs, axis=0) if len(pairs) else pairs.reshape(-1, 2)


def splitters(keyed: DataFrame, ranges: int) -> np.ndarray:
    """Sorted boundaries from a size-weighted sample; overfull ranges are sampled again.

    At most about ranges * SAMPLE_PER_RANGE keys come to the driver, however large the table is."""
    total = keyed.agg(F.sum("size")).head()[0] or 0
    if not total:
        return np.empty((0, 2), "int64")
    sample = _drawn(keyed, ranges * SAMPLE_PER_RANGE / total)
    sample = sample[np.lexsort((sample[:, 1], sample[:, 0]))]
    cuts = _sorted(sample[SAMPLE_PER_RANGE - 1 :: SAMPLE_PER_RANGE])
    for _ in range(ROUNDS):
        by_range = keyed.withColumn("__range", range_of(F.col("__key"), F.col("__tie"), cuts))
        full = by_range.groupBy("__range").agg(F.sum("size").alias("bytes"), F.countDistinct("__key", "__tie").alias("keys"))
        full = [r["__range"] for r in full.where((F.col("bytes") > OVERFULL * total / ranges) & (F.col("keys") > 1)).collect()]
        if not full:
            break
        more = _drawn(by_range.where(F.col("__range").isin(full)), ranges * SAMPLE_PER_RANGE * 4 / total)
        more = more[np.lexsort((more[:, 1], more[:, 0]))]
        cuts = _sorted(np.concatenate([cuts, more[SAMPLE_PER_RANGE - 1 :: SAMPLE_PER_RANGE]]))
    return cuts


def dealt(groups: list[tuple[int, int, int]], n_shards: int) -> dict[int, tuple[int, int]]:
    """key -> (shard, rows of the shard's groups before it): (key, bytes, rows), the largest first, each into the shard that has
    least so far, of equals the first."""
    load, rows, out = [0] * n_shards, [0] * n_shards, {}
    for key, size, n in sorted(groups, key=lambda g: (-g[1], g[0])):
        s = load.index(min(load))
        out[key] = s, rows[s]
        load[s], rows[s] = load[s] + size, rows[s] + n
    return out


def shards(docs: DataFrame, n_shards: int = SHARDS, place: tuple[str, str] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) with size, text_crc32, law, shard, slot and grown_shard; place: two columns that give the order."""
    return common.through(docs, ("doc_id", "text", *(place or ())), OUTPUTS, lambda d: _shards(d, n_shards, place))


def _shards(docs: DataFrame, n_shards: int, place: tuple[str, str] | None) -> DataFrame:
    blob = F.col("text").cast("binary")
    by_text = F.coalesce(F.conv(F.substring(F.md5(blob), 1, 15), 16, 10).cast("long"), F.lit(-1)), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))
    key, tie = (F.col(c).cast("long") for c in place) if place else by_text
    keyed = (
        docs.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
        .withColumn("text_crc32", F.coalesce(F.crc32(blob), F.lit(0)).cast("long"))
        .withColumn("__key", key)
        .withColumn("__tie", tie)
    )
    narrow = common.stored(keyed.select("__key", "__tie", "size"), "shard-keys")
    total = narrow.agg(F.sum("size")).head()[0] or 0
    large, cut, unit = [], [], F.col("__tie")
    if not place:
        groups = narrow.groupBy("__key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        found = groups.where(F.col("bytes") * (n_shards * GROUP_PART) > total).collect()  # fewer than n_shards * GROUP_PART
        large = [tuple(r) for r in found if r["bytes"] * n_shards <= total]
        cut = [r["__key"] for r in found if r["bytes"] * n_shards > total]
        unit = F.when(F.col("__key").isin([k for k, *_ in found]), F.col("__tie")).otherwise(F.lit(LEAST))
    home, load = dealt(large, n_shards), [0] * n_shards
    for k, size, _ in large:
        load[home[k][0]] += size
    # where the rest of each shard ends, times 2 * n_shards; large groups take their room first
    borders, at = [], 0
    for s in range(n_shards - 1):
        at += max(0, total - n_shards * load[s])
        borders.append(2 * at)
    ranges = max(n_shards * RANGES_PER_SHARD, -(-total // RANGE_BYTES))
    edges = np.array([(x, LEAST) for k in home for x in (k, k + 1)], "int64").reshape(-1, 2)  # a large group has ranges of its own
    cuts = _sorted(np.concatenate([splitters(narrow.withColumn("__tie", unit), ranges), edges]))
    ranged = lambda df: df.withColumn("__range", range_of(F.col("__key"), unit, cuts))
    before = Window.partitionBy("__own").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("__key").isin(list(home)), F.col("__key")) if home else F.lit(None).cast("long")
    offsets = (
        ranged(narrow).groupBy("__range").agg(F.sum("size").alias("__b"), F.count("*").alias("__n"), F.min(own).alias("__own"))
        .select("__range", "__own", F.coalesce(F.sum("__b").over(before), F.lit(0)).alias("__bytes"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__rows"))
    )
    offsets = common.stored(offsets, "shard-ranges")
    pairs = [x for k, (s, n) in home.items() for x in (F.lit(k), F.struct(F.lit(s).alias("shard"), F.lit(n).cast("long").alias("rows")))]
    homes = F.create_map(*pairs) if pairs else None

    def laid(df: DataFrame) -> DataFrame:
        inside = Window.partitionBy("__range").orderBy("__key", "__tie", "size")
        group = Window.partitionBy("__range", "__key")
        at = F.col("__bytes") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        middle = 2 * F.col("__at") + F.col("size")
        if not place:
            whole = 2 * F.min("__at").over(group) + F.sum("size").over(group)
            middle = F.when(F.col("__key").isin(cut), middle).otherwise(whole) if cut else whole
        passed = F.lit(0)
        for b in borders:
            passed = passed + (F.col("__mid") * n_shards >= b).cast("int")
        rows = (
            ranged(df).join(F.broadcast(offsets), "__range")  # a row for each range: bounded by bytes / RANGE_BYTES
            .withColumn("__at", at)
            .withColumn("__row", F.col("__rows") + F.row_number().over(inside) - 1)
            .withColumn("__mid", middle)
            .withColumn("shard", passed)
        )
        if homes is None:
            return rows
        mine = F.when(F.col("__own").isNotNull(), F.element_at(homes, F.col("__own")))
        rows = rows.withColumn("__home", mine)
        return rows.withColumn("shard", F.coalesce("__home.shard", "shard")).withColumn("__row", F.col("__row") + F.coalesce("__home.rows", F.lit(0))).drop("__home")

    rest = F.when(F.col("__own").isNull(), F.col("__row"))
    taken = [0] * n_shards  # rows of large groups in each shard
    for k, _, n in large:
        taken[home[k][0]] += n
    first = laid(narrow).groupBy("shard").agg(F.min(rest).alias("__first"))
    filled = F.element_at(F.array(*[F.lit(n).cast("long") for n in taken]), F.col("shard") + 1)
    slot = F.when(F.col("__own").isNull(), F.col("__row") - F.col("__first") + filled).otherwise(F.col("__row"))
    return (
        laid(keyed).join(F.broadcast(first), "shard")  # a row for each shard
        .withColumn("slot", slot)
        .withColumn("law", F.lit("bytes"))
        .withColumn("grown_shard", F.lit(None).cast("int"))
    )


def write(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; files within it hold its records in slot order."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return shards(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


ORACLE = """
with recursive crc_table as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
d as (
  select doc_id, strlen(coalesce(text, ''))::bigint + 1 as size,
    case when coalesce(text, '') = '' then 0 else xor(4294967295, list_reduce(
      list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::bigint)),
      lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) end::bigint as text_crc32,
    coalesce(('0x' || substr(md5(text), 1, 15))::bigint, -1) as k
  from documents, crc_table),
gr as (select k, sum(size)::bigint as bytes, count(*)::bigint as n, (select sum(size) from d) as total from d group by k),
big as (select *, row_number() over (order by bytes desc, k) as i from gr where bytes * 16 * 20 > total and bytes * 16 <= total),
deal as (
  select 0::bigint as i, null::bigint as k, -1 as shard, 0::bigint as ahead, list_transform(range(16), lambda x: 0::bigint) as load, list_transform(range(16), lambda x: 0::bigint) as filled
  union all
  select b.i, b.k, s - 1, filled[s], list_transform(load, lambda x, j: case when j = s then x + b.bytes else x end), list_transform(filled, lambda x, j: case when j = s then x + b.n else x end)
  from (select deal.*, list_position(load, list_min(load)) as s from deal) deal join big b on b.i = deal.i + 1),
ends as (select load, filled from deal order by i desc limit 1),
caps as (select j, filled[j] as filled, 2 * sum(greatest(0, (select coalesce(sum(size), 0) from d) - 16 * load[j])) over (order by j) as border from ends, unnest(range(1, 17)) as u(j)),
o as (select d.*, gr.bytes * 16 > gr.total as cut, deal.shard as home, ahead, row_number() over (partition by d.k order by doc_id nulls first, d.size) - 1 as nth from d join gr using (k) left join deal on deal.k = d.k),
p as (
  select *, sum(size) over w - size as before, row_number() over w - 1 as row, sum(size) over (partition by k) as group_size from o where home is null
  window w as (order by k, doc_id nulls first, size rows between unbounded preceding and current row)),
g as (select *, min(before) over (partition by k) as group_before from p),
s as (select *, (select count(*) from caps where j < 16 and border <= (case when cut then 2 * before + size else 2 * group_before + group_size end) * 16)::int as shard from g)
select doc_id, size, text_crc32, 'bytes' as law, shard, (row - min(row) over (partition by shard) + filled)::bigint as slot, null::int as grown_shard from s join caps on caps.j = s.shard + 1
union all select doc_id, size, text_crc32, 'bytes', home, (ahead + nth)::bigint, null from o where home is not null
"""

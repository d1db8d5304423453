"""Spelling variants by a symmetric-delete join.

Every word emits itself and its distinct single deletions; words that share a key are joined and kept if their distance is
exactly one. Two such words share exactly one key (the longer one without the extra letter, or both without the letter that
differs), so a pair comes out of the join once and needs no distinct. Forms are aggregated from the pairs; roots follow forms by pointer jumping, at most
log2(log2(n)) rounds, since a form occurs at least twice as often as its word.

Words of more than LONG letters emit 122-bit hashes of the same keys, made from prefix sums in one pass, and stand under a
digest until the pair is verified: a word of a million letters costs a million short rows, not a million copies of itself.

Defined cases: null text: no words. Null doc_id: its key begins with the colon. Repeated rows: each counts. Ties in n: the
smaller word in code-point order. Empty table or no frequent word: empty result. Input columns beyond doc_id and text are
ignored.

Scale: words are counted with map-side aggregation, so the hottest word is one row a task. A key joins the words that
differ from it by one letter at some place, which the alphabet bounds (90 letters a place), not the number of documents.
Every join sorts both sides (hint merge): by the size of their compressed files words and keys look small enough to be
broadcast, and would go through the driver whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2
LONG = 100
SLIP = 97
_P, _BASES = (1 << 61) - 1, (1_000_003, 998_244_353)


def slipped(docs: DataFrame) -> DataFrame:
    """word of every run of letters of docs (doc_id, text): lower-cased, and one letter short where its checksum says so."""
    run = F.translate("run", UPPER, LOWER)
    sum_ = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return (
        docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).withColumn("run", run)
        .withColumn("h", sum_).select(F.when(F.col("h") % SLIP == 0, short).otherwise(F.col("run")).alias("word"))
    )


def frequent(words: DataFrame, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    return words.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def _keys(words: DataFrame) -> DataFrame:
    """(key, word, n): every word itself and its distinct single deletions."""
    less = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.substring(F.col("word"), i + 1, F.length("word"))))
    return words.select(F.explode(F.array_distinct(F.concat(F.array("word"), less))).alias("key"), "word", "n")


def hashed(word: str) -> set[tuple[int, int]]:
    """Hashes of the word and of its single deletions, in one pass over its prefix sums."""
    codes, sides = [ord(c) for c in word], []
    for base in _BASES:
        head, tail, power = 0, 0, [1]
        for c in codes:
            power.append(power[-1] * base % _P)
            tail = (tail * base + c) % _P
        whole, out, n = tail, [], len(codes)
        for i, c in enumerate(codes):
            tail = (tail - c * power[n - i - 1]) % _P
            out.append((head * power[n - i - 1] + tail) % _P)
            head = (head * base + c) % _P
        sides.append([*out, whole])
    return set(zip(*sides))


def _long_keys(words: DataFrame) -> DataFrame:
    """(k1, k2, id, letters): hashed keys of long words, id is the word's digest."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for word, name in zip(batch.column(0), batch.column(1)):
                keys = sorted(hashed(word.as_py()))
                for i in range(0, len(keys), 50_000):
                    a, b = zip(*keys[i : i + 50_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([name.as_py()] * len(a)), pa.array([len(word.as_py())] * len(a), pa.int32())],
                        names=["k1", "k2", "id", "letters"],
                    )

    return words.select("word", F.sha2("word", 256).alias("id")).mapInArrow(run, "k1 long, k2 long, id string, letters int")


def _near(a: str, b: str):
    return F.levenshtein(F.col(a), F.col(b), 1) == 1


def near(words: DataFrame, long: int = LONG) -> DataFrame:
    """(word, n, other, m): all ordered pairs of words (word, n) at distance one."""
    keys = _keys(words.where(F.length("word") <= long))
    short = keys.join(keys.select("key", F.col("word").alias("other"), F.col("n").alias("m")).hint("merge"), "key").where("word <> other").where(_near("word", "other"))
    hard = _long_keys(words.where(F.length("word") >= long))
    twin = hard.select("k1", "k2", F.col("id").alias("id2"), F.col("letters").alias("letters2"))
    ids = hard.join(twin.hint("merge"), ["k1", "k2"]).where("id <> id2").where(F.greatest("letters", "letters2") > long).select("id", "id2").distinct()
    named = words.where(F.length("word") >= long).withColumn("id", F.sha2("word", 256)).hint("merge")
    far = ids.join(named, "id").join(named.select(F.col("id").alias("id2"), F.col("word").alias("other"), F.col("n").alias("m")), "id2").where(_near("word", "other"))
    columns = ("word", "n", "other", "m")
    return short.select(*columns).unionByName(far.select(*columns))


def variants(words: DataFrame, ratio: int = RATIO, long: int = LONG) -> DataFrame:
    """word, n, n_near, form, form_n and root of distinct words (word, n)."""
    work = common.Scratch(words.sparkSession, "spelling")
    words = work.stored(words, "words")
    best = near(words, long).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("form"))).alias("best"))
    strong = -F.col("best.m") >= ratio * F.col("n")
    found = work.stored(best.select("word", "n_near", F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n")), "forms")
    roots = work.stored(found.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not roots.where("moved").isEmpty():
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = work.stored(roots.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return (
        words.join(found.hint("merge"), "word", "left").join(roots.drop("moved").hint("merge"), "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(frequent(slipped(common.table(spark, sf_dir, "documents").select("doc_id", "text"))))


ORACLE = """
with recursive crc_table as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
r as (
  select doc_id, run, count(*) as c from (
    select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents)
  group by all),
s as (
  select run, c, xor(4294967295, list_reduce(
      list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::varchar, '') || ':' || run)), '..'), lambda h: ('0x' || h)::bigint)),
      lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) as h
  from r, crc_table),
w as (
  select word, sum(c)::bigint as n from (
    select case when h % 97 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, c from s)
  where length(word) >= 5 group by word having sum(c) >= 3),
k as (
  select word, n, word as key, 0 as i from w
  union all select word, n, left(word, (i - 1)::int) || substr(word, i + 1), i from w, unnest(range(1, length(word) + 1)) as u(i)),
p as (
  select distinct a.word, a.n, b.word as other, b.n as m from k a join k b on a.key = b.key and a.word <> b.word and (a.i = b.i or a.i = 0 or b.i = 0)),
f as (
  select word, n, count(*) as n_near, max(m) as m, min(other) filter (m = best) as form from (select *, max(m) over (partition by word) as best from p) group by word, n),
g as (
  select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when m >= 2 * w.n then form end as form, case when m >= 2 * w.n then m end as form_n
  from w left join f using (word)),
up as (
  select word, word as root, 0 as d from g
  union all select up.word, g.form, d + 1 from up join g on g.word = up.root where g.form is not null)
select g.word, form, (select max_by(root, d) from up where up.word = g.word) as root, n, n_near, form_n::bigint as form_n from g
"""

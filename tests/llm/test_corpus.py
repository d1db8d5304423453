import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import decontam, mixing, recount, sharding

SF = "/root/testdata/sf0.001"


def brute_hits(text, items, window=10):
    w, hit, names, longest = decontam.words(text), set(), set(), 0
    for name, t in items:
        v = decontam.words(t)
        n = min(window, len(v))
        for q in range(len(v) - n + 1 if v else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[q : q + n]:
                    hit.update(range(p, p + n))
                    names.add(str(name))
                    m = n
                    while p + m < len(w) and q + m < len(v) and w[p + m] == v[q + m]:
                        m += 1
                    longest = max(longest, m)
    return len(w), len(hit), len(names), longest


@pytest.mark.parametrize("seed", range(4))
def test_suffix_arrays_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 40)
    draw = np.random.default_rng(seed)
    text = lambda n: " ".join(draw.choice(["a", "b", "C", "dé", "e-f"], n, p=[0.5, 0.3, 0.1, 0.05, 0.05]))
    items = [(i, text(int(draw.integers(0, 30)))) for i in range(8)] + [(3, text(15)), (9, None)]
    docs = [(i, text(int(draw.integers(0, 60)))) for i in range(25)] + [(50, None), (51, items[0][1] + "! " + items[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contamination(df, bench).collect()}
    for d, t in docs:
        r = got[d]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["longest"]) == brute_hits(t, items)
        texts = defaultdict(list)
        for name, x in items:
            texts[str(name)].append(decontam.words(x))
        for m in r["matches"]:
            span = decontam.words(t)[m["start"] : m["start"] + m["length"]]
            assert any(v[m["item_start"] : m["item_start"] + m["length"]] == span for v in texts[m["item_id"]])
    kept = {r["doc_id"] for r in decontam.decontaminated(df, bench).collect()}
    assert kept == {d for d, _ in docs if not got[d]["contaminated"]}


def test_items_that_share_more_than_a_sorted_prefix():
    shared, a, b = ([f"{k}{i}" for i in range(n)] for k, n in (("s", 500), ("a", 90), ("b", 300)))
    items = [("A", shared), ("B", shared + b), ("C", shared[100:] + a), ("D", shared[:400])]
    items = [(name, [w.encode() for w in ws]) for name, ws in items]
    docs = [" ".join(shared + b), "x " + " ".join(shared), " ".join(shared[50:] + a), " ".join(b[-1:] + shared[:200] + ["y"])]
    got = decontam.judged(docs, [decontam.Block(items, 10)])
    assert [r[4] for r in got] == [brute_hits(t, [(n, b" ".join(w).decode()) for n, w in items])[3] for t in docs] == [800, 500, 490, 200]
    assert [r[5] for r in got] == [
        [(0, 800, "B", 0)], [(1, 500, "A", 0), (1, 500, "B", 0), (101, 400, "C", 0)],
        [(0, 450, "A", 50), (0, 450, "B", 50), (50, 490, "C", 0)], [(1, 200, "A", 0), (1, 200, "B", 0), (1, 200, "D", 0), (101, 100, "C", 0)],
    ]


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.curriculum(docs.select("doc_id", "source", "text")).collect()
    taken, target, most, source = Counter(), {}, Counter(), Counter()
    for r in rows:
        assert r["taken"] <= 2 * r["size"] and len(r["positions"]) == r["copies"] and all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        source[r["source"]] += r["size"]
    total = sum(source.values())
    assert abs(sum(target.values()) - 1.5 * total) < 1e-3
    assert all(abs(taken[s] - target[s]) <= most[s] and target[s] <= 2 * source[s] + 1e-6 for s in target)


def test_curriculum_follows_the_schedules(spark):
    docs = spark.createDataFrame([(i, s, "w " * 10) for i in range(3000) for s in "abc"], "doc_id long, source string, text string")
    order = [r["source"] for r in mixing.training_order(mixing.curriculum(docs)).select("source").collect()]
    early, late = Counter(order[: len(order) // 4]), Counter(order[-len(order) // 4 :])
    assert early["a"] > 1.5 * late["a"] and late["c"] > 1.5 * early["c"] and abs(early["b"] / late["b"] - 1) < 0.2
    places = [r["position"] for r in mixing.training_order(mixing.curriculum(docs)).select("position").collect()]
    assert places == sorted(places)


@pytest.mark.parametrize("knots", mixing.SCHEDULES)
def test_inverse_of_the_integral(spark, knots):
    t = np.linspace(0, 1, 41)
    x, y = zip(*knots)
    fine = np.linspace(0, 1, 40_001)
    area = np.concatenate([[0], np.cumsum((np.interp(fine, x, y)[1:] + np.interp(fine, x, y)[:-1]) / 2 * (fine[1] - fine[0]))])
    u = np.interp(t, fine, area / area[-1])
    got = spark.createDataFrame([(float(v),) for v in u], "u double").select(mixing._inverse(F.col("u"), knots).alias("t")).toPandas()["t"]
    assert np.abs(np.sort(got.to_numpy()) - t).max() < 1e-4


@pytest.mark.parametrize("hot", [0.0, 0.02, 0.1, 0.4])
def test_shards_are_even_and_gapless(spark, monkeypatch, hot):
    draw = np.random.default_rng(1)
    rows = [(i, "same text" if draw.random() < hot else "x" * int(draw.integers(0, 200))) for i in range(3000)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    by = defaultdict(list)
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((r["text"] or "").encode())
        by[r["shard"]].append(r)
    assert sorted(by) == list(range(16))
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        assert abs(sum(r["size"] for r in rows) - total / 16) <= max(2 * largest, total / 16 / 20)
    groups = defaultdict(list)
    for r in got:
        groups[r["text"]].append(r)
    for text, rows in groups.items():  # equal texts stay together unless they are more than a shard holds
        assert len({r["shard"] for r in rows}) == 1 or sum(r["size"] for r in rows) * 16 > total


def test_groups_up_to_a_share_stay_whole(spark, write, agree):
    """Thirteen groups of a twentieth to a whole share, one of two shares, and single texts; the SQL deals them alike."""
    rows, n = [(0, "z" * 999, 0)], 0
    for g, size in enumerate([60, 55, 50, 45, 40, 30, 20, 20, 10, 8, 6, 4, 4]):
        for _ in range(size):
            n += 1
            rows.append((n, f"group {g} " + "y" * 91, n))
    rows += [(n + i, "twice a share " + "x" * 85, n + i) for i in range(1, 131)] + [(n + 200 + i, f"single {i} " + "w" * 90, i) for i in range(480)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(5)
    got = sharding.shards(docs).collect()
    by = defaultdict(set)
    for r in got:
        by[r["text"]].add(r["shard"])
    assert sorted(len(v) for v in by.values())[-2:] in ([1, 2], [1, 3])
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(16)]
    assert max(sizes) - min(sizes) < sum(sizes) / 16 / 10
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert agree(sharding.query(spark, folder := write(documents=docs)), sharding.ORACLE, folder) == len(rows)


INTERNAL = ["__at", "__mid", "__key", "__tie", "__range", "__row", "__own", "__home", "__bucket", "__src", "__rank", "rank", "a.b", "ends", "__file"]


def test_columns_with_internal_names_survive(spark):
    docs = spark.createDataFrame([(i, f"{'word ' * (i % 7)}{i % 40}", "ab"[i % 2], *[f"{c}{i}" for c in INTERNAL]) for i in range(60)], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in INTERNAL))
    for out in (sharding.shards(docs), mixing.curriculum(docs), recount.recounted(recount.counted(recount.scripted(docs)))):
        rows = out.collect()
        assert len(rows) == 60 and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in INTERNAL)


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLE_PER_RANGE", 2)
    docs = spark.createDataFrame([(i, "hot") for i in range(2000)] + [(i, f"t{i}") for i in range(2000, 3000)], "doc_id long, text string")
    keyed = docs.selectExpr("abs(hash(text)) as __key", "doc_id as __tie", "1L as size")
    cuts = sharding.splitters(keyed, 64)
    n = keyed.select(sharding.range_of(F.col("__key"), F.col("__tie"), cuts).alias("r")).groupBy("r").count().toPandas()["count"]
    assert n.max() < 3 * 3000 / 64 and n.sum() == 3000
    assert len(sharding.splitters(keyed.where("false"), 64)) == 0


def test_written_shards(spark, tmp_path):
    sharded = sharding.shards(spark.read.parquet(f"{SF}/documents.parquet"))
    sharding.write(sharded, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == sharded.count() and sorted(back.columns) == sorted(sharded.columns)

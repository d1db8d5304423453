import numpy as np
import pytest

from spanforge.llm import jaccard
from spanforge.llm.components import components


def words(text):
    return (text or "").encode().lower().split()


def brute(rows, width, percent):
    sets = []
    for _, t in rows:
        w = words(t)
        k = min(width, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    part = list(range(len(rows)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                part[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)}


def corpus(seed, n=160):
    draw = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = " ".join(draw.choice(vocabulary, 30))
    rows, made = [], []
    for i in range(n):
        kind = draw.integers(6)
        if made and kind < 3:  # a copy with some words changed
            w = made[draw.integers(len(made)) if kind else 0].split()
            for _ in range(int(draw.integers(0, 3))):
                w[draw.integers(len(w))] = str(draw.choice(vocabulary))
            text = " ".join(w)
        elif kind == 3:
            text = " ".join(draw.choice(vocabulary, int(draw.integers(1, 9))))
        else:
            text = " ".join(draw.choice(vocabulary, int(draw.integers(20, 120))))
            text = f"{passage} {text}" if kind == 4 else text
        made.append(text)
        rows.append((int(i), text))
    draw.shuffle(rows)
    return [(int(a), str(b)) for a, b in rows] + [(9000, None), (9001, ""), (9002, " \t")]


@pytest.mark.parametrize("seed,width,percent,small", [(0, 3, 90, 24), (1, 5, 80, 2), (2, 3, 90, 2), (3, 1, 60, 3), (4, 2, 80, 2)])
def test_equals_brute_force(spark, monkeypatch, seed, width, percent, small):
    """Small limits, so that frequent classes, large buckets, clusters and several blocks are all met."""
    for name, value in (("FREQUENT", 3), ("COUNTED_LEAST", 1), ("SMALL", small), ("BLOCK_ROWS", 16), ("COUNTED", 2000)):
        monkeypatch.setattr(jaccard, name, value)
    if seed > 2:  # sets that are equal in the first 64 bits only
        real = jaccard.set_id
        monkeypatch.setattr(jaccard, "set_id", lambda s: (real(s)[0] % 61, real(s)[1]))
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.joined(df, width, percent).collect()}
    assert got == brute(rows, width, percent)


def test_a_large_group_of_near_copies(spark):
    base = [f"word{i}" for i in range(150)]
    rows = []
    for i in range(400):
        w = list(base)
        w[i % 150] = f"new{i}"
        rows.append((i, " ".join(w)))
    got = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 3, 90).collect()
    assert {r["component_id"] for r in got} == {0}
    kept = jaccard.deduplicated(spark.createDataFrame([*rows, (500, None), (500, None), (501, "other text")], "doc_id long, text string"), 3, 90)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 500, 501]


def test_shipped_parameters_on_many_frequent_tokens(spark):
    """Thousands of texts from shared passages, so that pairs of frequent tokens, large buckets and pivots are met unforced."""
    draw = np.random.default_rng(7)
    vocabulary = [f"v{i}" for i in range(400)]
    base = [" ".join(draw.choice(vocabulary, 60)) for _ in range(12)]
    rows = []
    for i in range(1700):
        w = base[0 if i < 1100 else int(draw.integers(1, 12))].split()
        for _ in range(int(draw.integers(0, 6))):
            w[int(draw.integers(60))] = str(draw.choice(vocabulary))
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 80).collect()}
    assert got == brute(rows, 3, 80)


def test_tokens_spread_over_all_workers_are_found(spark):
    rows = [(i, f"shared words here own{i} words{i} only{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as binary) as tag").repartition(50)
    real, jaccard.COUNTED, jaccard.SAMPLED = (jaccard.COUNTED, jaccard.SAMPLED), 4, 16
    try:
        order = jaccard.frequent_tokens(docs, 3)
    finally:
        jaccard.COUNTED, jaccard.SAMPLED = real
    assert jaccard.shingles("shared words here", 3)[0] in order.tokens and len(order.tokens) < 100


def test_rows_are_told_apart_by_id_and_text(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(1, text("a"), "x"), (2, text("a"), "x"), (2, text("b"), "x"), (None, text("a"), "x"), (None, text("c"), "x"), (None, text("c"), "y"), (7, "", "x"), (7, "", "x"), (8, "", "x"), (None, None, "x")]
    kept = jaccard.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").withColumnRenamed("a.b", "__id.x"))
    assert kept.columns == ["doc_id", "text", "__id.x"]
    assert sorted(map(str, ((r[0], r[1]) for r in kept.collect()))) == sorted(map(str, [(1, text("a")), (2, text("b")), (None, text("c")), (7, ""), (8, ""), (None, None)]))


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_linked_sets_share_a_signature(percent):
    draw = np.random.default_rng(percent)
    order = jaccard.Order(draw.permutation(np.arange(200, dtype="uint64")))
    for _ in range(3000):
        n = int(draw.integers(1, 120))
        a = np.sort(draw.choice(260, n, replace=False)).astype("uint64")
        drop = int(draw.integers(0, max(1, n * (100 - percent) // 100) + 1))
        b = np.unique(np.concatenate([a[drop:], draw.choice(260, int(draw.integers(0, 3))).astype("uint64")]))
        if len(b) and jaccard.linked(a, b, percent):
            assert np.intersect1d(jaccard.signatures(a, order, percent), jaccard.signatures(b, order, percent)).size


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 5), (7, 7), (9, 2), (None, 3), (-4, 300)] + [(400, i) for i in range(401, 450)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 5: 2, 9: 2, 2: 2, -4: -4, 300: -4, **{i: 400 for i in range(400, 450)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanforge.llm import topk


@pytest.mark.parametrize("seed,copies", [(0, 1), (1, 40), (2, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, copies):
    monkeypatch.setattr(topk, "LEAF", 8)
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(300 // copies, 6)) * (0.02 if seed == 2 else 1)
    x = np.repeat(base, copies, 0).astype("float32")
    ids = draw.permutation(len(x) * 3)[: len(x)]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    got = {}
    for r in topk.search(df, F.col("vec_id") % 5 == 0, k=7, shard_rows=60, block_rows=25).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    q = np.floor(64 * x.astype("float64")).astype("int64")
    want = {}
    for i, v in zip(ids.tolist(), q):
        if i % 5 == 0:
            best = sorted((-int(v @ w), j) for j, w in zip(ids.tolist(), q) if j != i)[:7]
            want[i] = [(n, j, -s) for n, (s, j) in enumerate(best, 1)]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_tree_is_a_partition_into_small_leaves():
    draw = np.random.default_rng(0)
    x, ids = draw.integers(-3, 3, size=(500, 4)), draw.permutation(500)
    order, nodes = topk.tree(ids, x, 16)
    leaves = nodes[nodes[:, 2] == 0]
    assert sorted(order.tolist()) == list(range(500)) and tuple(nodes[0, :2]) == (0, 500)
    assert sorted(i for a, b in leaves[:, :2] for i in range(a, b)) == list(range(500)) and ((leaves[:, 1] - leaves[:, 0]) <= 16).all()
    for a, b, left, right in nodes[nodes[:, 2] > 0]:
        assert nodes[left, 0] == a and nodes[left, 1] == nodes[right, 0] and nodes[right, 1] == b


def test_subtrees_are_not_opened():
    """Two far clusters: of the one on the wrong side only its topmost box is looked at."""
    draw = np.random.default_rng(0)
    x = np.concatenate([draw.integers(900, 1000, size=(512, 3)), draw.integers(-1000, -900, size=(512, 3))])
    made = topk._planted(pd.DataFrame({"shard": 0, "vec_id": range(1024), "row": range(1024), "q": x.tolist()}))
    shard, opened = topk.Shard(made.iloc[0]), []
    shard.nodes = type("Seen", (list,), {"__getitem__": lambda self, i: (opened.append(int(i)), list.__getitem__(self, i))[1]})(shard.nodes.tolist())
    one = np.array([[1, 1, 1]])
    _, ids, scores = shard.search(np.array([-1]), one, 5, np.array([topk.NONE]), np.array([2**62]))
    assert sorted(zip((-scores).tolist(), ids.tolist())) == sorted((-int(v), i) for i, v in enumerate(x.sum(1)))[:5]
    assert opened and not any((shard.high[i] < 0).all() for i in opened)


def test_large_components_and_unequal_lengths(spark):
    rows = [(1, [1e9]), (2, [2e9]), (3, [3.0, 4.0, 5.0]), (4, []), (5, [-1e30]), (20, [1.0, 1e30])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 20).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [
        (3, topk.MOST), (2, 64 * 64 * 2 * 10**9), (1, 64 * 64 * 10**9), (4, 0), (5, -topk.MOST),
    ]


def test_rows_that_repeat_an_id(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (7, [2.0, 1.0]), (7, [2.0, 1.0]), (7, [0.0, 3.0])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    want = [[8192, 8192, 0, 0], [12288, 4096, 4096, 0]]
    assert sorted((r["rank"], r["score"]) for r in got) == sorted((n, s) for w in want for n, s in enumerate(w, 1))
    assert {r["query_id"] for r in got} == {20} and len(got) == 8

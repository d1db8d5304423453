"""Exact top-k inner-product search with KD-trees per shard.

Each shard holds about SHARD_ROWS vectors in a KD-tree: median splits along the widest side down to leaves of LEAF
vectors; every node, inner ones too, has its tight bounding box and smallest id. The largest inner product that a box allows
is sum(max(q * low, q * high)). Each query keeps a queue of nodes and takes the one of the largest bound: of an inner node the
children join the queue, a leaf is scored. A node whose bound doesn't beat the query's kth result so far (score, then id) is
never opened, and with it its whole subtree. The kth result of a query's home shard is propagated to all other shards before
they are searched. The queries of a block go through a tree together, so that each step is a few array operations.

Queries come in blocks of at most BLOCK, which are broadcast; each block meets every shard. The result is exact.

Defined cases: vectors null or holding a null or non-finite component, and rows without id, take no part. Rows that repeat
an id are rows of their own: each is a query if its id is one, and a candidate for all rows but itself. Vectors of unequal
length: missing components count 0. Components beyond 64 bits are held at the limit; so are scores, which are exact up to
there. Ties go to the smaller id. Fewer candidates than k: all are given. Empty table: no rows. Columns beyond id and vector
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.llm import common

K = 20
SHARD_ROWS = 8192
LEAF = 128
BLOCK = 20_000
EVERY = 20
MOST = 2**63 - 1
NONE = -MOST - 1
#: rows: numbers of the rows; nodes: (start, stop, left child or 0, right child or 0) of each node; low, high: boxes; first: smallest ids.
TREES = "shard long, dims int, width int, ids binary, rows binary, vectors binary, nodes binary, low binary, high binary, first binary"


def quantised(vector: str = "embedding", by: int = 64) -> Column:
    """floor(by * x) of each component; null where the vector takes no part."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)))
    most = float(2**63 - 1024)  # the largest double below 2 ** 63
    cell = lambda c: F.floor(F.least(F.greatest(c * by, F.lit(-most)), F.lit(most))).cast("long")
    return F.when(x.isNotNull() & ~bad, F.transform(x, cell))


def tree(ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
    """(order, nodes): the rows in leaf order and (start, stop, left, right) of each node; node 0 is the root, children 0: a leaf."""
    order, nodes, todo = np.argsort(ids, kind="stable"), [[0, len(ids), 0, 0]], [0]
    while todo:
        at = todo.pop()
        a, b = nodes[at][:2]
        if b - a <= leaf:
            continue
        part = x[order[a:b]]
        if part.shape[1]:
            side = int(np.argmax(part.max(0).astype("float64") - part.min(0)))
            order[a:b] = order[a:b][np.argsort(part[:, side], kind="stable")]
        mid = (a + b) // 2
        nodes[at][2:] = len(nodes), len(nodes) + 1
        todo += [len(nodes) + 1, len(nodes)]
        nodes += [[a, mid, 0, 0], [mid, b, 0, 0]]
    return order, np.array(nodes, "int64")


def _matrix(vectors, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), "int64")
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _planted(pdf: pd.DataFrame) -> pd.DataFrame:
    """The tree of one shard as one row."""
    dims = max(map(len, pdf["q"]), default=0)
    ids, rows, x = pdf["vec_id"].to_numpy("int64"), pdf["row"].to_numpy("int64"), _matrix(pdf["q"].tolist(), dims)
    order, nodes = tree(ids, x)
    ids, rows, x = ids[order], rows[order], x[order]
    low, high, first = (np.stack([f(v[a:b], axis=0) for a, b in nodes[:, :2]]) for f, v in ((np.min, x), (np.max, x), (np.min, ids)))
    width = 4 if x.size == 0 or (x.min() >= -(2**31) and x.max() < 2**31) else 8
    as_bytes = lambda a, kind="<i8": np.ascontiguousarray(a).astype(kind).tobytes()
    cells = [as_bytes(a, f"<i{width}") for a in (x, low, high)]
    made = (int(pdf["shard"].iloc[0]), dims, width, as_bytes(ids), as_bytes(rows), cells[0], as_bytes(nodes), cells[1], cells[2], as_bytes(first))
    return pd.DataFrame([made], columns=[c.split()[0] for c in TREES.split(", ")])


def _long(a: np.ndarray) -> np.ndarray:
    """Numbers as 64-bit integers, held at the limits; NONE is left free."""
    return np.clip(a, -MOST, MOST).astype("int64") if a.dtype == object else a.astype("int64")


class Shard:
    """A shard's tree, ready to search."""

    def __init__(self, row):
        get = lambda name, kind="<i8": np.frombuffer(row[name], kind)
        self.number, self.dims, kind = int(row["shard"]), int(row["dims"]), f"<i{int(row['width'])}"
        self.ids, self.rows, self.first = get("ids"), get("rows"), get("first")
        self.nodes = get("nodes").reshape(-1, 4)
        self.x = get("vectors", kind).reshape(len(self.ids), self.dims)
        self.low, self.high = (get(n, kind).reshape(len(self.nodes), self.dims) for n in ("low", "high"))

    def search(self, own: np.ndarray, q: np.ndarray, k: int, kth: np.ndarray, kth_id: np.ndarray):
        """(query index, id, score) of this shard's results that beat the kth result so far; own: the queries' rows."""
        n = max(self.dims, q.shape[1])
        pad = lambda a: np.pad(a, ((0, 0), (0, n - a.shape[1])))
        largest = lambda a: float(max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0)))))
        most = largest(q) * largest(self.x) * max(n, 1)
        kind = "float32" if most < 2**24 else "float64" if most < 2**53 else "int64" if most < 2**62 else object
        q, x, low, high = (pad(a).astype(kind) for a in (q, self.x, self.low, self.high))
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        queue = np.full((len(q), len(self.nodes)), NONE, "int64")
        queue[:, 0] = _long(up @ high[0] + down @ low[0])
        score = np.full((len(q), k), NONE, "int64")
        found = np.full((len(q), k), np.iinfo("int64").max, "int64")
        kth, kth_id = kth.copy(), kth_id.copy()
        live = np.arange(len(q))
        while len(live):
            node = queue[live].argmax(1)
            best = queue[live, node]
            go = (best > NONE) & (best >= kth[live])  # what is left in the queue has no larger bound
            live, node, best = live[go], node[go], best[go]
            queue[live, node] = NONE
            go = (best > kth[live]) | (self.first[node] < kth_id[live])
            mine, at = live[go], node[go]
            by_node = np.argsort(at, kind="stable")
            for part in np.split(by_node, np.flatnonzero(np.diff(at[by_node])) + 1) if len(by_node) else []:
                who, (a, b, left, right) = mine[part], self.nodes[at[part[0]]]
                if left:
                    for child in (left, right):
                        queue[who, child] = _long(up[who] @ high[child] + down[who] @ low[child])
                    continue
                got = _long(q[who] @ x[a:b].T)
                got[own[who][:, None] == self.rows[a:b][None, :]] = NONE
                s = np.concatenate([score[who], got], 1)
                i = np.concatenate([found[who], np.broadcast_to(self.ids[a:b], got.shape)], 1)
                top = np.lexsort((i, np.where(s == NONE, np.inf, -s.astype("float64")) if kind != object and most < 2**53 else -np.maximum(s, -MOST)), axis=1)[:, :k]
                score[who], found[who] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
                better = (score[who, -1] > kth[who]) | ((score[who, -1] == kth[who]) & (found[who, -1] < kth_id[who]))
                kth[who] = np.where(better, score[who, -1], kth[who])
                kth_id[who] = np.where(better, found[who, -1], kth_id[who])
        keep = (score > NONE) & ((score > kth[:, None]) | ((score == kth[:, None]) & (found <= kth_id[:, None])))
        where = np.nonzero(keep)
        return where[0], found[where], score[where]


def _searched(trees: DataFrame, block, home: bool, k: int) -> DataFrame:
    """Results of one pass: each query in its home shard, or in all others with its kth result known."""

    def run(batches):
        own, qids, q, homes, kth, kth_id = block.value
        for pdf in batches:
            for row in pdf.to_dict("records"):
                shard = Shard(row)
                mine = np.flatnonzero((homes == shard.number) == home)
                if len(mine):
                    i, ids, scores = shard.search(own[mine], q[mine], k, kth[mine], kth_id[mine])
                    yield pd.DataFrame({"row": own[mine][i], "query_id": qids[mine][i], "vec_id": ids, "score": scores})

    return trees.mapInPandas(run, "row long, query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = K, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK) -> DataFrame:
    """The k best rows of vectors (vec_id, embedding) for each row that is_query picks: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised().alias("q")).where("vec_id is not null and q is not null")
    x = common.stored(x.withColumn("row", F.monotonically_increasing_id()), "vectors")  # a row keeps its number from here on
    n_shards = max(1, -(-x.count() // shard_rows))
    shard = F.pmod(F.xxhash64("row"), F.lit(n_shards))
    trees = common.stored(x.withColumn("shard", shard).groupBy("shard").applyInPandas(_planted, TREES), "trees")
    trees = trees.repartitionByRange(n_shards, "shard") if n_shards > 1 else trees
    out, block = [], []

    def run(rows: list) -> None:
        dims = max((len(r["q"]) for r in rows), default=0)
        own, qids = (np.array([r[c] for r in rows], "int64") for c in ("row", "vec_id"))
        q = _matrix([r["q"] for r in rows], dims)
        homes = np.array([r["home"] for r in rows], "int64")
        kth, kth_id = np.full(len(rows), NONE, "int64"), np.full(len(rows), np.iinfo("int64").max, "int64")
        first = common.stored(_searched(trees, spark.sparkContext.broadcast((own, qids, q, homes, kth, kth_id)), True, k), "home")
        place = {i: n for n, i in enumerate(own.tolist())}
        for r in _ranked(first, k).where(F.col("rank") == k).toLocalIterator():  # one row for each query of the block
            kth[place[r["row"]]], kth_id[place[r["row"]]] = r["score"], r["vec_id"]
        rest = _searched(trees, spark.sparkContext.broadcast((own, qids, q, homes, kth, kth_id)), False, k)
        out.append(first.unionByName(rest))

    wanted = x.where(is_query).withColumn("home", shard)
    for r in wanted.toLocalIterator():
        block.append(r)
        if len(block) == block_rows:
            run(block)
            block = []
    if block or not out:
        run(block)
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % EVERY == 0)


ORACLE = """
with v as (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as q from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.n, a.vec_id as query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::bigint as score
  from v a join v b on a.vec_id % 20 = 0 and a.n <> b.n),
r as (select *, row_number() over (partition by n order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""

"""Prefix trie of conversations by an LCP-aware external mergesort.

A turn stands as a 128-bit digest of role and text. Tasks sort the conversations that they hold into runs of bounded
size; each row of a run carries its longest common prefix (LCP) with the row before, and only what lies beyond it. Runs are
cut at sampled splitters and sent to ranges of the order (turns, then conv_id), so copies of one conversation, however many, spread over ranges.
A range merges its runs with a loser tree that compares stored LCPs first and digests only from there on, and keeps a
stack of the open path: a node that the next row leaves is finished and goes out.

Nodes on the first or last path of a range may go on in its neighbours. They go out as parts, are summed by node, and
their subtrees are added up over the parts' own small tree. A second pass, in the reverse order of emission, gives every
node its parent's conv_id. Ids that end at such nodes travel as packed text, hashed in order.

A row holds at most PIECE turns. A longer conversation continues in further pieces, each a trie of its own below the node that
it goes on from; pieces are merged from the deepest up. Where only one conversation goes on, its nodes are written out at once, so a
conversation of any length costs no further rounds unless another one shares it that far.

Defined cases: null role or text: empty. Null turn: first. Equal turns: by digest. Null conv_id: names no conversation, its
rows take no part. Repeated turns: each counts. No conversation: no node, not even the root. Other columns are ignored.

Bounds: a task holds one run (RUN_BYTES) or one range (about RANGE_BYTES); the driver sees the splitters, SAMPLES keys a range of at most
16 * (PIECE + 1) bytes each.
"""

from __future__ import annotations

import hashlib
import pickle
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import common

PIECE = 256
RUN_BYTES, RANGE_BYTES, SAMPLES = 8 << 20, 32 << 20, 16
CHUNK = 1 << 16
ROOT = bytes(16)
NOTHING = hashlib.sha256().hexdigest()
ADDED = ("a_children", "a_leaves", "a_saved")
ROWS = "conv long, piece binary, digests array<binary>, words array<long>, last boolean, a_children long, a_leaves long, a_saved long"
MERGED = (
    "kind string, range int, ord long, depth long, piece binary, key binary, up binary, conv long, n long, words long, "
    "children long, leaves long, saved long, a_children long, a_leaves long, a_saved long, ends string"
)
NODES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def packed(rows: list, splitters: list) -> Iterator[tuple[int, int, bytes]]:
    """Sort rows (symbols, conv, words, last, added) into a run and cut it: (range, rows, front-coded rows)."""
    rows.sort(key=lambda r: r[:2])
    a = 0
    while a < len(rows):
        place = bisect_right(splitters, rows[a][:2])
        b = a + 1
        if place < len(splitters):
            while b < len(rows) and rows[b][:2] < splitters[place]:
                b += 1
        else:
            b = len(rows)
        out, before = [], ()
        for symbols, conv, words, last, added in rows[a:b]:
            k = shared(before, symbols, 0)
            out.append((k, b"".join(symbols[k:]), words[k:], conv, last, added))
            before = symbols
        yield place, b - a, pickle.dumps(out, protocol=5)
        a = b


def shared(a, b, at: int) -> int:
    """How many symbols a and b begin with in common, if at is known to be."""
    n = min(len(a), len(b))
    while at < n and a[at] == b[at]:
        at += 1
    return at


class Run:
    """A cursor over a front-coded run."""

    __slots__ = ("rows", "at", "symbols", "words", "conv", "last", "added", "lcp")

    def __init__(self, blob: bytes):
        self.rows, self.at, self.symbols, self.words = pickle.loads(blob), 0, [], []
        self.next()

    def next(self) -> bool:
        if self.at == len(self.rows):
            return False
        k, tail, words, self.conv, self.last, self.added = self.rows[self.at]
        self.rows[self.at] = None
        self.symbols = self.symbols[:k] + [tail[i : i + 16] for i in range(0, len(tail), 16)]
        self.words = self.words[:k] + words
        self.lcp = k
        self.at += 1
        return True

    def final(self) -> list:
        """The symbols of the last row."""
        out = self.symbols
        for k, tail, *_ in self.rows[self.at :]:
            out = out[:k] + [tail[i : i + 16] for i in range(0, len(tail), 16)]
        return out


def merged(runs: list[Run]) -> Iterator[tuple[Run, int]]:
    """The rows of all runs in order, each with its LCP with the row before: a loser tree over LCPs.

    Each run's lcp is that with the last row out, or, for a loser in the tree, with the row that beat it; the longer one is the smaller row,
    and only rows with equal LCPs are compared, from there on."""

    def wins(a: Run, b: Run) -> bool:
        """Whether a's row comes first; the loser's lcp becomes that with the winner."""
        if a.lcp != b.lcp:
            return a.lcp > b.lcp
        k = shared(a.symbols, b.symbols, a.lcp)
        first = (a.symbols[k : k + 1], a.conv) < (b.symbols[k : k + 1], b.conv)
        (b if first else a).lcp = k
        return first

    n = len(runs)
    for r in runs:
        r.lcp = 0
    tree: list[Run | None] = [None] * n
    alive: dict[int, int] = {id(r): i for i, r in enumerate(runs)}
    done = object()

    def play(r, node: int):
        """Carry r from a leaf's parent up to the root; an exhausted run loses to all."""
        while node:
            other = tree[node]
            if other is None and r is not done and building[0]:
                tree[node] = r
                return None
            if other is not done and other is not None and (r is done or not wins(r, other)):
                tree[node], r = r, other
            node //= 2
        return r

    building, winner = [True], None
    if n == 1:
        winner = runs[0]
    else:
        for i, r in enumerate(runs):
            got = play(r, (i + n) // 2)
            winner = got if got is not None else winner
    building[0] = False
    while winner is not None and winner is not done:
        yield winner, winner.lcp
        leaf = alive[id(winner)]
        candidate = winner if winner.next() else done
        winner = candidate if n == 1 else play(candidate, (leaf + n) // 2)


class Node:
    __slots__ = ("symbol", "words", "n", "conv", "children", "leaves", "saved", "added", "first", "last", "sha", "ids", "size", "chunks")

    def __init__(self, symbol: bytes, words: int, first: bool, last: bool):
        self.symbol, self.words, self.first, self.last = symbol, words, first, last
        self.n = self.children = self.leaves = self.saved = self.size = self.chunks = 0
        self.conv = self.added = self.sha = None
        self.ids: list[str] = []


def keys(symbols: list) -> list[bytes]:
    """The key of each node on a path: the piece's own, then digests of the path."""
    h, out = hashlib.md5(symbols[0], usedforsecurity=False), [symbols[0]]
    for s in symbols[1:]:
        h.update(s)
        out.append(h.digest())
    return out


def nodes(place: int, level: int, size: int, runs: list[Run]) -> Iterator[tuple]:
    """Rows (MERGED) of a range: finished nodes, parts of nodes on its first and last path, and their packed ids."""
    final = max((r.final() for r in runs), default=[])
    stack: list[Node] = []
    count = 0

    def put(kind, depth, key, up, node, ends):
        nonlocal count
        count += 1
        added = node.added or (None, None, None)
        return (kind, place, count, level * size + depth, stack[0].symbol, key, up, node.conv, node.n, node.words, node.children, node.leaves, node.saved, *added, ends)

    def chunk(node: Node, depth: int):
        node.chunks += 1
        text, node.ids, node.size = ("," if node.chunks > 1 else "") + ",".join(node.ids), [], 0
        if node.first or node.last:
            return put("ends", depth, keys([n.symbol for n in stack[: depth + 1]])[-1], None, node, text)
        node.sha = node.sha or hashlib.sha256()
        node.sha.update(text.encode())
        return None

    def pop():
        node, depth = stack[-1], len(stack) - 1
        if node.ids and (out := chunk(node, depth)):
            yield out
        up = stack[-2] if depth else None
        if up:
            up.n += node.n
            up.conv = node.conv if up.conv is None else min(up.conv, node.conv)
        if node.first or node.last:
            path = keys([n.symbol for n in stack])
            yield put("part", depth, path[-1], path[-2] if depth else None, node, None)
        else:
            more = node.added or (0, 0, 0)
            children, leaves = node.children + more[0], node.leaves + more[1]
            leaves += not children
            saved = node.saved + more[2] + (node.n - 1) * node.words
            node.children, node.leaves, node.saved = children, leaves, saved
            up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
            key = keys([n.symbol for n in stack])[-1] if node.added else None
            yield put("node", depth, key, None, node, node.sha.hexdigest() if node.sha else NOTHING)
        stack.pop()

    began = False
    for row, lcp in merged(runs):
        while len(stack) > lcp:
            yield from pop()
        for i in range(len(stack), len(row.symbols)):
            on_last = i < len(final) and row.symbols[i] == final[i] and (not i or stack[-1].last)
            # the root of a piece is always a part: what lies above it is in another piece
            stack.append(Node(row.symbols[i], row.words[i], not began or not i, on_last))
        began = True
        node = stack[-1]
        node.n += 1
        node.conv = row.conv if node.conv is None else min(node.conv, row.conv)
        if row.last:
            text = str(row.conv)
            node.ids.append(text)
            node.size += len(text) + 1
            if node.size > CHUNK and (out := chunk(node, len(stack) - 1)):
                yield out
        else:
            node.added = row.added
    while stack:
        yield from pop()


def _flush(rows: list, schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _merge(rows: DataFrame, level: int, size: int, work: common.Scratch, run_bytes: int, range_bytes: int) -> DataFrame:
    """rows (ROWS) of one level -> MERGED, written."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = rows.sparkSession
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("digests") * 16 + 48), F.lit(0))).head()
    ranges = max(-(-total // range_bytes), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 1000)))
    found = rows.sample(min(1.0, SAMPLES * ranges / max(n, 1)), 7).select("piece", "digests", "conv").collect() if ranges > 1 else []
    sample = sorted(([bytes(s) for s in (r["piece"], *r["digests"])], r["conv"]) for r in found)
    splitters = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []
    shared_splitters = common.share(spark, splitters)
    runs_schema = "range int, n long, run binary"

    def make(batches):
        import pyarrow as pa

        cuts, held, weight = common.opened(shared_splitters), [], 0

        def flush():
            made = list(packed(held, cuts))
            held.clear()
            for place, n, blob in made:
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([n], pa.int64()), pa.array([blob], pa.binary())], names=["range", "n", "run"])

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("piece", "digests", "conv", "words", "last", *ADDED)]
            for piece, digests, conv, words, last, *added in zip(*columns):
                held.append(([piece, *digests], conv, [0, *words], last, None if last else tuple(added)))
                weight += 150 * len(words) + 300
                if weight > run_bytes:
                    yield from flush()
                    weight = 0
        if held:
            yield from flush()

    schema = to_arrow_schema(common.add_columns(spark.createDataFrame([], "x int").drop("x").schema, **dict(c.split(" ") for c in MERGED.split(", "))))

    def merge(batches):
        place, runs, out = None, [], []
        for batch in batches:
            for r, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if r != place and runs:
                    for row in nodes(place, level, size, runs):
                        out.append(row)
                        if len(out) == 5000:
                            yield _flush(out, schema)
                            out = []
                    runs = []
                place = r
                runs.append(Run(blob.as_py()))
        for row in nodes(place, level, size, runs) if runs else ():
            out.append(row)
            if len(out) == 5000:
                yield _flush(out, schema)
                out = []
        if out:
            yield _flush(out, schema)

    runs = rows.mapInArrow(common.relieved(make), runs_schema)
    sent = runs.select("range", "run").repartition("range").sortWithinPartitions("range").mapInArrow(common.relieved(merge), MERGED)
    with common.batch_rows(spark, 64):
        return work.stored(sent, f"merged-{level}")


def _sums(parts: DataFrame, level: int, size: int) -> DataFrame:
    """parts, one row a node, with leaves and saved of their whole subtrees: summed in the order in which nodes were finished."""
    import pyarrow as pa

    def run(batches):
        acc, now = [], None
        for batch in batches:
            names = batch.schema.names
            at = {c: batch.column(names.index(c)).to_pylist() for c in ("piece", "depth", "leaves", "saved")}
            leaves, saved = [], []
            for piece, depth, a, b in zip(at["piece"], at["depth"], at["leaves"], at["saved"]):
                if piece != now:
                    acc, now = [[0, 0] for _ in range(size + 2)], piece
                i = depth - level * size
                a, b = a + acc[i + 1][0], b + acc[i + 1][1]
                acc[i + 1] = [0, 0]
                acc[i][0] += a
                acc[i][1] += b
                leaves.append(a)
                saved.append(b)
            new = {"leaves": pa.array(leaves, pa.int64()), "saved": pa.array(saved, pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(names)], names=names)

    return parts.repartition("piece").sortWithinPartitions("piece", "closed.range", "closed.ord").drop("closed").mapInArrow(run, parts.drop("closed").schema)


def _parts(made: DataFrame, level: int, size: int, work: common.Scratch) -> DataFrame:
    """Nodes that several ranges have parts of, whole: piece, key, up, depth, conv, n, children, leaves, saved, ends, goes_on."""
    part = made.where("kind = 'part'")
    whole = part.groupBy("key").agg(
        F.first("piece").alias("piece"), F.first("up").alias("up"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.min("conv").alias("conv"),
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")], *[F.max(c).alias(c) for c in ADDED], F.max(F.struct("range", "ord")).alias("closed"),
    )
    kids = part.where("up is not null").select("up", "key").distinct().groupBy(F.col("up").alias("key")).agg(F.count("*").alias("kids"))
    more = {c: F.coalesce(c, F.lit(0)) for c in ("kids", *ADDED)}
    children = F.col("children") + more["kids"] + more["a_children"]
    leaves = F.col("leaves") + more["a_leaves"] + F.when(children == 0, 1).otherwise(0)
    saved = F.col("saved") + more["a_saved"] + (F.col("n") - 1) * F.col("words")
    whole = whole.join(kids, "key", "left").select(
        "piece", "key", "up", "depth", "conv", "n", children.alias("children"), leaves.alias("leaves"), saved.alias("saved"), F.col("a_leaves").isNotNull().alias("goes_on"), "closed"
    )

    def hashed(batches):
        import pyarrow as pa

        now, sha = None, None
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != now:
                    if now is not None:
                        out.append((now, sha.hexdigest()))
                    now, sha, text = key, hashlib.sha256(), text.removeprefix(",")
                elif not text.startswith(","):
                    text = "," + text
                sha.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([s for _, s in out], pa.string())], names=["key", "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["key", "ends"])

    ids = made.where("kind = 'ends'").select("key", "ends", "range", "ord").repartition("key").sortWithinPartitions("key", "range", "ord").select("key", "ends")
    ends = ids.mapInArrow(common.relieved(hashed), "key binary, ends string")
    summed = _sums(whole, level, size).join(ends, "key", "left").withColumn("ends", F.coalesce("ends", F.lit(NOTHING)))
    return work.stored(summed, f"parts-{level}")


def _parents(made: DataFrame, parts: DataFrame) -> DataFrame:
    """Finished nodes with parent: read in the reverse order of emission, a node's parent is the last node read one level up."""
    import pyarrow as pa

    rest = ("depth", "key", "conv", "n", "children", "leaves", "saved", "ends")
    holds = made.where("kind = 'part'").select("range", "ord", "key").join(parts.select("key", "depth", "conv"), "key")
    marks = holds.select("range", "ord", "depth", F.lit(None).cast("binary").alias("key"), "conv", *[F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("children", "long"), ("leaves", "long"), ("saved", "long"), ("ends", "string"))])
    both = made.where("kind = 'node'").select("range", "ord", *rest).unionByName(marks)

    def run(batches):
        path: dict[int, int] = {}
        for batch in batches:
            up = []
            for depth, conv in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                path[depth] = conv
                up.append(path.get(depth - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(up, pa.int64())], names=[*batch.schema.names, "parent"])

    ordered = both.repartition("range").sortWithinPartitions("range", F.col("ord").desc()).select(*rest)
    return ordered.mapInArrow(run, common.add_columns(ordered.schema, parent="long")).where("n is not null")


def _chained(rows: DataFrame) -> DataFrame:
    """(conv, child): the key of the node from which a row's conversation goes on."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            child = [keys([p, *d])[-1] for p, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(child, pa.binary())], names=["conv", "child"])

    return rows.where("not last").select("conv", "piece", "digests").mapInArrow(run, "conv long, child binary")


def trie(turns: DataFrame, convs: DataFrame, piece: int = PIECE, run_bytes: int = RUN_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """turns (conv, pos from 0, digest, words) and all convs (conv) -> NODES."""
    work = common.Scratch(turns.sparkSession, "trie")
    listed = F.array_sort(F.collect_list(F.struct("pos", "digest", "words")))
    level = F.floor(F.col("pos") / piece).cast("int")
    sizes = convs.join(turns.groupBy("conv").agg(F.count("*").alias("n")), "conv", "left").select("conv", F.coalesce("n", F.lit(0)).alias("n"))
    blocks = turns.groupBy("conv", level.alias("level")).agg(listed.alias("l")).select("conv", "level", F.col("l.digest").alias("digests"), F.col("l.words").alias("words"))
    none = sizes.where("n = 0").select("conv", F.lit(0).alias("level"), F.array().cast("array<binary>").alias("digests"), F.array().cast("array<long>").alias("words"), F.lit(True).alias("last"))
    blocks = blocks.join(sizes, "conv").withColumn("last", (F.col("level") + 1) * piece >= F.col("n")).drop("n").unionByName(none)
    blocks = work.stored(blocks, "blocks")
    deep = blocks.where("level > 0")

    # from the top: which pieces are shared, and where conversations go on alone
    rows = blocks.where("level = 0").withColumn("piece", F.lit(ROOT)).drop("level")
    levels, onward, alone = [rows], [], []
    while not (goes := work.stored(_chained(levels[-1]), "onward")).isEmpty():
        known = goes.groupBy("child").agg((F.count("*") > 1).alias("shared"))
        onward.append(work.stored(goes.join(known, "child"), "pieces"))
        alone.append(onward[-1].where("not shared").select("conv", "child"))
        here = onward[-1].where("shared").select("conv", F.col("child").alias("piece"))
        below = work.stored(deep.where(F.col("level") == len(levels)).drop("level").join(here, "conv"), "rows")
        if below.isEmpty():
            break
        levels.append(below)

    # from the bottom: merge each level; what hangs below a piece's last nodes is added to them
    whole, totals = {}, None
    for j in reversed(range(len(levels))):
        rows = levels[j]
        if j < len(onward):
            more = onward[j].where("not shared").select("conv", F.lit(1).alias("a_children"), F.lit(1).alias("a_leaves"), F.lit(0).alias("a_saved"))
            if totals is not None:
                more = more.unionByName(onward[j].where("shared").join(totals, "child").select("conv", *ADDED))
            rows = rows.join(more, "conv", "left")
        else:
            rows = rows.select("*", *[F.lit(None).alias(c) for c in ADDED])
        rows = rows.select("conv", "piece", "digests", "words", "last", *[F.col(c).cast("long").alias(c) for c in ADDED])
        made = _merge(rows, j, piece, work, run_bytes, range_bytes)
        whole[j] = made, _parts(made, j, piece, work)
        totals = whole[j][1].where("up is null").select(F.col("key").alias("child"), F.col("children").alias("a_children"), F.col("leaves").alias("a_leaves"), F.col("saved").alias("a_saved"))

    # from the top again: parents
    out, above = [], None
    for j in range(len(levels)):
        made, parts = whole[j]
        if above is not None:
            upper = above.select("key", F.col("conv").alias("upper"))
            parts = parts.join(upper, "key", "left").withColumn("conv", F.when(F.col("up").isNull(), F.col("upper")).otherwise(F.col("conv"))).drop("upper")
        held = parts.join(parts.select(F.col("key").alias("up"), F.col("conv").alias("parent")), "up", "left")
        found = _parents(made, parts)
        columns = ("depth", "conv", "parent", "n", "children", "leaves", "saved", "ends", "key")
        both = held.where("up is not null" if j else "true").select(*columns, "goes_on").unionByName(found.select(*columns, F.col("key").isNotNull().alias("goes_on")))
        if j < len(onward):
            both = work.stored(both, "nodes")
            above = both.where("goes_on").select("key", "conv")
            lone = alone[j].join(above.select(F.col("key").alias("child"), F.col("conv").alias("parent")), "child").drop("child")
            tail = deep.where(F.col("level") > j).join(lone, "conv").select("*", F.explode(F.sequence(F.lit(1), F.size("digests"))).alias("i"))
            ends, first = F.col("last") & (F.col("i") == F.size("digests")), (F.col("level") == j + 1) & (F.col("i") == 1)
            out.append(tail.select(
                (F.col("level") * F.lit(piece).cast("long") + F.col("i")).alias("depth"), "conv", F.when(first, F.col("parent")).otherwise(F.col("conv")).alias("parent"),
                F.lit(1).cast("long").alias("n"), F.when(ends, 0).otherwise(1).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"),
                F.lit(0).cast("long").alias("saved"), F.when(ends, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(F.lit(NOTHING)).alias("ends"),
            ))
        out.append(both.drop("key", "goes_on"))
    all_ = out[0]
    for o in out[1:]:
        all_ = all_.unionByName(o)
    return all_.select(*[F.col(a).alias(b) for a, b in zip(("conv", "depth", "parent", "n", "children", "leaves", "saved", "ends"), NODES)])


def placed(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> (conv, pos, digest, words); pos counts from 0.

    Turns are put in order by range, so one conversation may lie in several ranges; places are counted in each range and then
    moved by what the ranges before it hold of the same conversation."""
    import pyarrow as pa

    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    flat = rows.where("conv_id is not null").select(F.col("conv_id").alias("conv"), "turn", digest.alias("digest"), common.n_words("text").alias("words"))

    def count(batches):
        from pyspark import TaskContext

        part, now, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            at = []
            for c in batch.column(0).to_pylist():
                now, n = (c, 0) if c != now else (now, n + 1)
                at.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64()), pa.array([part] * len(at), pa.int32())], names=["conv", "digest", "words", "at", "part"])

    ordered = flat.repartitionByRange("conv", F.col("turn").asc_nulls_first(), "digest").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "digest")
    counted = common.stored(ordered.select("conv", "digest", "words").mapInArrow(count, "conv long, digest binary, words long, at long, part int"), "turns")
    sizes = counted.groupBy("conv", "part").agg(F.count("*").alias("size"))
    split = sizes.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "size"))).alias("parts")).where("size(parts) > 1")
    before = F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + F.when(p["part"] < F.col("part"), p["size"]).otherwise(0))
    return counted.join(split, "conv", "left").select(
        "conv", (F.col("at") + F.when(F.col("parts").isNull(), 0).otherwise(before)).alias("pos"), "digest", "words"
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: the first h turns of conversation c - c % 20, then c's own after its first h."""
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    convs = turns.select("conv").distinct()
    asked = convs.select("conv", (F.col("conv") - F.col("conv") % 20).alias("giver"), head.alias("h"))
    given = turns.where("pos < 3").select(F.col("conv").alias("giver"), "pos", "digest", "words")
    heads = asked.join(given, "giver").where("pos < h").select("conv", "pos", "digest", "words")
    had = heads.groupBy("conv").agg(F.count("*").alias("had"))
    own = turns.where(F.col("pos") >= head).join(had, "conv", "left").select("conv", (F.col("pos") - head + F.coalesce("had", F.lit(0))).alias("pos"), "digest", "words")
    return heads.unionByName(own), convs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = placed(common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return trie(*rebuilt(turns))


ORACLE = """
with crc_table as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
r as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as pos,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as m, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as w
  from conversations where conv_id is not null),
c as (
  select c, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(c::varchar)), '..'), lambda h: ('0x' || h)::bigint)),
      lambda s, b: xor(s >> 8, t[xor(s, b) % 256 + 1]))) % 4 as h
  from (select distinct c from r), crc_table),
t as (
  select c.c, 0 as own, r.pos, m, w from c join r on r.c = c.c - c.c % 20 and r.pos < c.h
  union all select c.c, 1, r.pos, m, w from c join r on r.c = c.c and r.pos >= c.h),
s as (select c.c, coalesce(list(m order by own, pos) filter (m is not null), []) as ms, coalesce(list(w order by own, pos) filter (m is not null), []) as ws from c left join t using (c) group by c.c),
p as (select c, d, array_to_string(ms[1 : d], '') as k, array_to_string(ms[1 : d - 1], '') as up, case when d > 0 then ws[d] else 0 end as w, d = len(ms) as ends from s, unnest(range(0, len(ms) + 1)) as u(d)),
n as (
  select k, d, any_value(case when d > 0 then up end) as up, min(c) as conv, count(*) as n, any_value(w) as w,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '')) as e from p group by k, d),
kids as (select up as k, count(*) as kids from n where up is not null group by up),
v as (select n.*, coalesce(kids, 0) as kids from n left join kids using (k)),
below as (select a.k, count(*) filter (b.kids = 0) as leaves, sum((b.n - 1) * b.w) as saved from v b, unnest(range(0, b.d + 1)) as u(i) join v a on a.k = left(b.k, (32 * i)::int) group by a.k)
select v.conv as conv_id, v.d::bigint as depth, parent.conv as parent_conv_id, v.n::bigint as n_convs, v.kids::bigint as n_children, leaves::bigint as n_leaves,
  saved::bigint as saved_tokens, v.e as ends_sha256
from v join below using (k) left join v parent on parent.k = v.up
"""

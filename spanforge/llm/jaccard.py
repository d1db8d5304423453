"""N-gram Jaccard join with token-combination prefixes.

A text's set holds its distinct word shingles as 64-bit hashes (the tokens). Tokens are ordered rare first: those that a
count over all texts finds frequent come last, by frequency. Two sets with a Jaccard similarity of t share a token in
their prefixes of n - ceil(t * n) + 1 tokens. The prefix is extended until rare tokens count 1 each and frequent ones,
dealt into classes, count one less than their number in each class: then linked sets share a rare token or, in some class,
a pair of frequent tokens. So single rare tokens and pairs of frequent tokens of one class are indexed. The number of
classes grows with the set size (bands of powers of two; a set is indexed in its own band and in that of the smallest
set that it can link with), so pairs stay in proportion to the size.

Texts with equal sets are one vertex, by 128 bits of a digest. Buckets of the index up to SMALL give candidate pairs, less
those whose sketches differ too much; larger buckets (near copies in great number) keep their members. Candidates that hang
together form clusters, whose whole sets are verified inside the workers, which give back a spanning forest only; a cluster
that is much sparser than its candidates is verified pair by pair and bucket by bucket instead. A group too large for one
block is first verified against a few pivots, block by block; what is connected then is not compared again, only the rest
with all others. So no link is lost, and no group's pairs are written out. Candidates travel as compressed text, from which
the sets are made where they are compared. Connected components of the links are the result.

Frequent tokens: each worker counts COUNTED tokens at a time and passes on those that come twice, and of the others every
SAMPLED-th, so a token spread thinly over all workers is found too. The FREQUENT_MOST most frequent are broadcast. What
is taken for rare although it is not costs time only, never a link.

Defined cases: null or empty text, or one of white space: size 0, linked with nothing, its own component. Fewer words than
the width: the whole sequence is the one shingle. Null doc_id: takes part; a component of such rows only has a null id.
Repeated rows: same component. Empty table: empty result. Input columns named like an output column are replaced.

Scale: sets are made from the text three times rather than stored; frequent tokens are at most FREQUENT_MOST by the choice
of the threshold, the filter of documents that are needed again has a fixed size, and all else is joined.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import common
from spanforge.llm.components import components, forest

WIDTH = 5
PERCENT = 80
#: A token is frequent from so many texts; at most so many tokens are, the most frequent ones.
FREQUENT = 4
FREQUENT_MOST = 2_000_000
#: Tokens that a worker counts at a time, how often one must occur among them to be passed on, and the share of the others
#: (one in so many) that is passed on as well; two of these make a token frequent.
COUNTED = 2_000_000
COUNTED_LEAST = 2
SAMPLED = 256
#: Buckets up to this size give pairs; larger ones are verified in blocks of so many sets and tokens.
SMALL = 24
BLOCK_ROWS = 1024
BLOCK_TOKENS = 1_000_000
#: A cluster is verified as a whole if its pairs are at most so many times the candidates (and the pairs of its large buckets).
PAIR_COST = 128
#: Cells of the sketch that bounds two sets' difference from below.
CELLS = 64
#: Bits of the filter of documents whose sets are needed: 8 MB.
FILTER_BITS = 26
LEAST = -(2**63)
OUTPUTS = ("n_shingles", "component_id")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, "uint64")
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "uint64", len(words))
    width = min(width, len(words))
    h = np.full(len(words) - width + 1, width, "uint64")
    for j in range(width):
        h = _mixed((h * np.uint64(0x9E3779B97F4A7C15)) ^ w[j : len(w) - width + 1 + j])
    return np.unique(h)


def set_id(s: np.ndarray) -> tuple[int, int]:
    """Two numbers of 64 bits (signed) that stand for a set."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def sketch(s: np.ndarray) -> bytes:
    """How many tokens fall in each cell, 255 at most: sets differ in at least as many tokens as these numbers do in sum."""
    return np.minimum(np.bincount((s >> np.uint64(58)).astype("int64"), minlength=CELLS), 255).astype("uint8").tobytes()


class Order:
    """Frequent tokens with their rank; all others are rare."""

    def __init__(self, tokens: np.ndarray):
        """tokens: from the least to the most frequent."""
        self.rank = np.argsort(tokens, kind="stable").astype("int32")
        self.tokens = tokens[self.rank]

    def split(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rare tokens, frequent tokens), both in order."""
        if not len(self.tokens):
            return s, s[:0]
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        known = self.tokens[at] == s
        return s[~known], s[known][np.argsort(self.rank[at[known]], kind="stable")]


def bands(n: int, percent: int) -> set[int]:
    return {n.bit_length() - 1, (-(-n * percent // 100)).bit_length() - 1}


def classes(band: int) -> int:
    """Classes of frequent tokens in a band; 0: they are indexed singly. A set of the band always has tokens enough."""
    return 0 if band < 2 else max(1, (1 << band) // 16)


def signatures(s: np.ndarray, order: Order, percent: int) -> np.ndarray:
    """What a set is indexed by: linked sets have one of these in common."""
    n = len(s)
    if not n:
        return s
    need = n + (-n * percent // 100) + 1  # n - ceil(t * n) + 1
    rare, frequent = order.split(s)
    out, rest = [_mixed(rare[:need])], need - len(rare)
    for band in bands(n, percent) if rest > 0 else ():
        salt = np.uint64(band + 1)
        if not (c := classes(band)):
            out.append(_mixed(frequent[:rest] ^ _mixed(np.full(1, salt))[0]))
        else:
            kind = (frequent >> np.uint64(20)) % np.uint64(c)
            again = np.ones(len(frequent), bool)
            again[np.unique(kind, return_index=True)[1]] = False
            stop = int(np.searchsorted(np.cumsum(again), rest)) + 1
            for k in np.unique(kind[:stop]):
                mine = np.sort(frequent[:stop][kind[:stop] == k])
                i, j = np.triu_indices(len(mine), 1)
                out.append(_mixed(_mixed(mine[i] + salt) ^ mine[j]))
    return np.unique(np.concatenate(out))


def _sets(batches, width: int):
    """((doc_id, tag), set) of each row of some Arrow batches (doc_id, text, tag)."""
    for batch in batches:
        for part in common.slices(batch):
            doc_ids, texts, tags = (part.column(i).to_pylist() for i in range(3))
            for doc_id, text, tag in zip(doc_ids, texts, tags):
                yield (doc_id, tag), shingles(text, width)


def frequent_tokens(docs: DataFrame, width: int) -> Order:
    """The tokens of all texts that many texts share; equal sets of a worker count once."""
    import pyarrow as pa

    def count(batches):
        held, size, seen, turn = [], 0, set(), 0

        def counted():
            token, n = np.unique(np.concatenate(held), return_counts=True)
            once = n < COUNTED_LEAST
            drawn = once & (_mixed(token + np.uint64(turn)) % np.uint64(SAMPLED) == 0)
            keep = ~once | drawn
            token, n, drawn = token[keep], np.where(once, 0, n)[keep], drawn[keep]
            for i in range(0, len(token), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(token[part].view("int64")), pa.array(n[part].astype("int64")), pa.array(drawn[part].astype("int64"))], names=["token", "n", "drawn"])

        for _, s in _sets(batches, width):
            if len(s) and (key := set_id(s)[0]) not in seen:
                if not turn:
                    turn = key & ((1 << 63) - 1)
                seen.add(key)
                held.append(s)
                size += len(s)
                if size >= COUNTED:
                    yield from counted()
                    held, size, seen, turn = [], 0, set(), turn + 1
        if held:
            yield from counted()

    work = common.Scratch(docs.sparkSession, "frequent")
    sums = docs.mapInArrow(common.relieved(count), "token long, n long, drawn long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("drawn").alias("drawn"))
    often = work.stored(sums.where((F.col("n") >= FREQUENT) | (F.col("drawn") > 1)).select("token", (F.col("n") + F.col("drawn") * SAMPLED).alias("n")), "often", texts=True)
    least, held = FREQUENT, 0
    for r in often.groupBy(F.least("n", F.lit(100_000)).alias("n")).count().orderBy(F.desc("n")).collect():  # at most 100,000 rows
        held += r["count"]
        if held > FREQUENT_MOST:
            least = r["n"] + 1
            break
    got = often.where(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(FREQUENT_MOST).toPandas() if least > 100_000 else often.where(F.col("n") >= least).toPandas()
    work.drop()
    tokens, n = got["token"].to_numpy("int64").view("uint64"), got["n"].to_numpy("int64")
    return Order(tokens[np.lexsort((tokens, n))])


def _indexed(docs: DataFrame, order: Order, width: int, percent: int) -> DataFrame:
    """(doc_id, tag, n, cid, more, cells, sigs): size and vertex of each text; sketch and signatures where a worker meets the set first."""
    import pyarrow as pa

    shared = common.share(docs.sparkSession, order)
    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary())

    def run(batches):
        known, seen, rows, size = common.opened(shared), set(), [], 0

        def made():
            *plain, sigs = zip(*rows)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sigs])]).astype("int32")
            flat = pa.array(np.concatenate(sigs).view("int64"))
            arrays = [*(pa.array(x, kind) for x, kind in zip(plain, kinds)), pa.ListArray.from_arrays(pa.array(offsets), flat)]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "tag", "n", "cid", "more", "cells", "sigs"])

        for (doc_id, tag), s in _sets(batches, width):
            cid, more, cells, sigs = None, None, None, s[:0]
            if len(s):
                cid, more = set_id(s)
                if (cid, more) not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add((cid, more))
                    cells, sigs = sketch(s), signatures(s, known, percent)
            rows.append((doc_id, tag, len(s), cid, more, cells, sigs))
            size += len(sigs)
            if size > 500_000 or len(rows) >= 5000:
                yield made()
                rows, size = [], 0
        if rows:
            yield made()

    return docs.mapInArrow(common.relieved(run), "doc_id long, tag binary, n int, cid long, more long, cells binary, sigs array<long>")


def _buckets(percent: int):
    """Sorted (sig, cid, n) rows -> pairs of small buckets (hot false: a, b) and members of large ones (hot true: sig, cid)."""
    import pyarrow as pa

    def run(batches):
        sig = cid = n = np.zeros(0, "int64")
        hot = None  # the signature whose members are passed on as they come

        def split(sig, cid, n, last: bool):
            nonlocal hot
            edges = np.concatenate([[0], np.flatnonzero(np.diff(sig)) + 1, [len(sig)]]) if len(sig) else np.zeros(1, "int64")
            size = np.diff(edges)
            rest, pairs, members = len(sig), [], []
            for g in np.flatnonzero(size > 1).tolist() if hot is None else range(len(size)):
                a, b = int(edges[g]), int(edges[g + 1])
                open_ = b == len(sig) and not last
                if hot is not None and sig[a] != hot:
                    hot = None
                if hot is None and b - a <= SMALL:
                    if open_:
                        break
                    i, j = np.triu_indices(b - a, 1)
                    x, y = cid[a:b], n[a:b]
                    ok = (np.minimum(y[i], y[j]) * 100 >= percent * np.maximum(y[i], y[j])) & (x[i] != x[j])
                    pairs.append(np.stack([x[i][ok], x[j][ok]], 1))
                else:
                    members.append(np.stack([sig[a:b], cid[a:b]], 1))
                    if open_:
                        hot, rest = int(sig[a]), len(sig)
                        break
            if not last and hot is None and len(edges) > 1:
                rest = int(edges[-2])
            out = []
            for kind, found in ((False, pairs), (True, members)):
                if found and len(found := np.concatenate(found)):
                    out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(found), kind)), pa.array(np.ascontiguousarray(found[:, 0])), pa.array(np.ascontiguousarray(found[:, 1]))], names=["hot", "a", "b"]))
            return out, rest

        for batch in batches:
            col = [batch.column(i).to_numpy(zero_copy_only=False).astype("int64") for i in range(3)]
            sig, cid, n = (np.concatenate(x) for x in zip((sig, cid, n), col))
            again = np.concatenate([[False], (np.diff(sig) == 0) & (np.diff(cid) == 0)]) if len(sig) else np.zeros(0, bool)
            sig, cid, n = sig[~again], cid[~again], n[~again]  # the same set, met by several workers
            out, rest = split(sig, cid, n, False)
            yield from out
            sig, cid, n = sig[rest:], cid[rest:], n[rest:]
        out, _ = split(sig, cid, n, True)
        yield from out

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def block_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i in left, j in right, i < j in number) of linked sets; tokens are taken in parts of bounded size."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n > 1
    number = np.cumsum(shared) - 1
    keep = shared[at]
    owner, at = owner[keep], number[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both, step = np.zeros((len(left), len(right)), "float32"), 4096  # counts below 2 ** 24 are exact
    place_l, place_r = np.full(len(sets), -1), np.full(len(sets), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    for first in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(at, [first, first + step])
        grids = []
        for place, rows in ((place_l, len(left)), (place_r, len(right))):
            grid = np.zeros((rows, step), "float32")
            mine = place[owner[a:b]] >= 0
            grid[place[owner[a:b][mine]], at[a:b][mine] - first] = 1
            grids.append(grid)
        both += grids[0] @ grids[1].T
    size = np.array([len(s) for s in sets], "float64")
    found = [np.zeros((0, 2), "int64")]
    for k, row in enumerate(both):
        row = row.astype("float64")
        j = np.flatnonzero(100 * row >= percent * (size[left[k]] + size[right] - row))
        found.append(np.stack([np.full(len(j), left[k]), right[j]], 1))
    i, j = np.concatenate(found).T
    return i[i != j], j[i != j]


def _packed(text: str) -> bytes:
    return zlib.compress(text.encode("utf-8", "surrogatepass"), 1)


def _opened(packed: bytes, width: int) -> np.ndarray:
    return shingles(zlib.decompress(packed).decode("utf-8", "surrogatepass"), width)


def _block(width: int, percent: int):
    """A group of rows (cid, text, blk, low, high): a forest of the links between the blocks low and high."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("cid")
        sets = [_opened(x, width) for x in pdf["text"]]
        blk = pdf["blk"].to_numpy()
        low, high = int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
        i, j = block_links(sets, np.flatnonzero(blk == low), np.flatnonzero(blk == high), percent)
        ids = pdf["cid"].to_numpy("int64")
        a, b = forest(ids[i], ids[j])
        if sum(map(len, sets)) > BLOCK_TOKENS // 8:
            del sets
            common.give_back()
        return pd.DataFrame({"a": a, "b": b})

    return run


def _pivoted(width: int, percent: int):
    """A group of rows (cid, text, pivot): a forest of the links between the pivots and all."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pivot", ascending=False, kind="stable").drop_duplicates("cid")
        sets, ids, first = [_opened(x, width) for x in pdf["text"]], pdf["cid"].to_numpy("int64"), int(pdf["pivot"].sum())
        found = [(i, j) for i in range(first) for j in range(i + 1, len(sets)) if linked(sets[i], sets[j], percent)]
        i, j = np.array(found, "int64").reshape(-1, 2).T
        a, b = forest(ids[i], ids[j])
        return pd.DataFrame({"a": a, "b": b})

    return run


def _filter_words(at: DataFrame) -> DataFrame:
    """(word, bits) of a filter with the bits `at` set: at most 2 ** (FILTER_BITS - 6) rows, however many bits."""
    return at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits"))


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bit for each hash of the ids (rep)."""
    rows = _filter_words(ids.select(F.shiftrightunsigned(F.xxhash64("rep"), 64 - FILTER_BITS).alias("at"))).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), "int64")
    out[rows["word"].to_numpy("int64")] = rows["bits"].to_numpy("int64")
    return out


def _close(pairs: DataFrame, indexed: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) without those whose sketches already differ too much."""
    cells = indexed.where("cells is not null").groupBy("cid").agg(F.max(F.struct("cells", "n")).alias("c"))
    side = lambda c, x: cells.select(F.col("cid").alias(c), F.col("c.cells").alias(x), F.col("c.n").alias(f"n{x}"))

    def run(batches):
        for pdf in batches:
            x, y = (np.frombuffer(b"".join(pdf[c]), "uint8").reshape(-1, CELLS).astype("int32") for c in ("x", "y"))
            apart, n = np.abs(x - y).sum(1), pdf["nx"].to_numpy("int64") + pdf["ny"].to_numpy("int64")
            yield pdf.loc[100 * (n - apart) >= percent * (n + apart), ["a", "b"]]

    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").mapInPandas(run, "a long, b long")


def _texts(docs: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """(cid, more, text) of the texts that stand for the vertices `needed` (rep), compressed; a few others may come along."""
    import pyarrow as pa

    bits = common.share(docs.sparkSession, _filter_of(needed))

    def run(batches):
        known, rows, size = common.opened(bits), [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["cid", "more", "text"])

        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False).astype("int64")
            for text in batch.column(1).filter(pa.array((known[at >> 6] >> (at & 63)) & 1 == 1)):
                text = text.as_py()
                if len(s := shingles(text, width)):
                    rows.append((*set_id(s), _packed(text)))
                    size += len(rows[-1][2])
                    if size > common.SLICE_BYTES:
                        yield made()
                        rows, size = [], 0
        if rows:
            yield made()

    at = F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(LEAST))), 64 - FILTER_BITS)
    return docs.select("doc_id", "text", at.alias("at")).mapInArrow(common.relieved(run), "cid long, more long, text binary")


def _compared(work: common.Scratch, grouped: DataFrame, texts: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """Links within groups (gid, cid): large groups against pivots first, then all that these left apart."""
    sized = grouped.join(reps.select("cid", "n"), "cid")
    pieces = lambda rows, tokens: F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(tokens / BLOCK_TOKENS)).cast("int")
    by_hash = F.xxhash64("cid")
    blocks = work.stored(sized.groupBy("gid").agg(
        pieces(F.count("*"), F.sum("n")).alias("nb"),
        F.array_distinct(F.array(F.min("cid"), F.max("cid"), F.min_by("cid", by_hash), F.max_by("cid", by_hash))).alias("pivots"),
    ), "blocks")
    large, links = blocks.where("nb > 1"), None
    alone = F.lit(0).alias("nc"), F.col("nb").alias("nr"), F.lit(False).alias("core")
    dealt = grouped.join(blocks.where("nb = 1"), "gid").select("gid", "cid", *alone)
    if not large.isEmpty():
        members = grouped.join(large, "gid").select("gid", "cid", F.pmod(by_hash, "nb").cast("int").alias("blk"), F.lit(False).alias("pivot"))
        pivots = large.select("gid", F.explode("pivots").alias("cid"), "nb").select("gid", "cid", F.explode(F.expr("sequence(0, nb - 1)")).alias("blk"), F.lit(True).alias("pivot"))
        to_pivots = members.unionByName(pivots).join(texts, "cid").groupBy("gid", "blk").applyInPandas(_pivoted(width, percent), "a long, b long")
        links = work.stored(to_pivots, "pivots")
        parts = components(links, work).select(F.col("node").alias("cid"), "component")
        state = grouped.join(large.select("gid"), "gid").join(parts, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        core = state.groupBy("gid", "component").agg(F.count("*").alias("m")).groupBy("gid").agg(F.max_by("component", F.struct("m", "component")).alias("most"))
        state = work.stored(state.join(core, "gid").join(reps.select("cid", "n"), "cid").select("gid", "cid", "n", (F.col("component") == F.col("most")).alias("core")), "state")
        of = lambda core: pieces(F.count_if(core), F.coalesce(F.sum(F.when(core, F.col("n"))), F.lit(0)))
        counts = state.groupBy("gid").agg(of(F.col("core")).alias("nc"), of(~F.col("core")).alias("nr")).where("nr > 0")
        dealt = dealt.unionByName(state.join(counts, "gid").select("gid", "cid", "nc", "nr", "core"))
    dealt = (
        dealt.withColumn("blk", F.when(F.col("core"), F.pmod(by_hash, F.greatest("nc", F.lit(1)))).otherwise(F.col("nc") + F.pmod(by_hash, "nr")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(if(core, nc, 0), nc + nr - 1)")))
        .select("gid", "cid", "blk", F.least("blk", "other").alias("low"), F.greatest("blk", "other").alias("high"))
    )
    rest = dealt.join(texts, "cid").groupBy("gid", "low", "high").applyInPandas(_block(width, percent), "a long, b long")
    return rest if links is None else links.unionByName(rest)


def _links(work: common.Scratch, docs: DataFrame, found: DataFrame, indexed: DataFrame, reps: DataFrame, vertex, width: int, percent: int) -> DataFrame:
    """Verified links (a, b) between vertices, enough to connect all that are linked."""
    pairs = work.stored(_close(found.where("not hot").select("a", "b").distinct(), indexed, percent), "pairs")
    members = found.where("hot").select(F.col("a").alias("sig"), F.col("b").alias("cid"))
    needed = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).unionByName(members.select("cid")).distinct()
    texts = work.stored(vertex(_texts(docs, needed.join(reps, "cid"), width)).select("cid", "text"), "texts", texts=True)
    same = F.bit_xor(F.xxhash64("cid")), F.bit_xor(F.xxhash64("cid", F.lit(1)))
    size = members.groupBy("sig").agg(F.min("cid").alias("first"), F.count("*").alias("m"), same[0].alias("x"), same[1].alias("y"))
    size = work.stored(size.groupBy("first", "m", "x", "y").agg(F.min("sig").alias("sig")).select("sig", "first", "m"), "buckets")  # equal buckets once
    cluster = components(pairs.unionByName(members.join(size, "sig").select(F.col("cid").alias("a"), F.col("first").alias("b"))), work)
    of = lambda c: cluster.select(F.col("node").alias(c), F.col("component").alias("cluster"))
    cost = pairs.join(of("a"), "a").select("cluster", F.lit(float(PAIR_COST)).alias("cost")).unionByName(
        size.where("m > 1").join(of("first"), "first").select("cluster", (F.col("m").cast("double") * F.col("m")).alias("cost"))
    ).groupBy("cluster").agg(F.sum("cost").alias("cost"))
    whole = cluster.groupBy(F.col("component").alias("cluster")).agg(F.count("*").cast("double").alias("n")).join(cost, "cluster")
    whole = work.stored(whole.select("cluster", (F.col("n") * F.col("n") <= F.col("cost")).alias("whole")), "clusters")
    apart = whole.where("not whole").select("cluster")
    loose = pairs.join(of("a").join(apart, "cluster"), "a").select("a", "b")

    def verify(batches):
        for pdf in batches:
            sets = {}
            for c, t in (("a", "x"), ("b", "y")):
                sets |= {i: _opened(x, width) for i, x in dict(zip(pdf[c], pdf[t])).items() if i not in sets}
            yield pdf.loc[[linked(sets[a], sets[b], percent) for a, b in zip(pdf["a"], pdf["b"])], ["a", "b"]]

    side = lambda c, t: texts.select(F.col("cid").alias(c), F.col("text").alias(t))
    links = None if loose.isEmpty() else loose.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInPandas(verify, "a long, b long")
    together = of("cid").join(whole.where("whole"), "cluster").select(F.xxhash64(F.lit("cluster"), "cluster").alias("gid"), "cid")
    buckets = members.join(size, "sig").join(of("first").join(apart, "cluster"), "first").select(F.xxhash64(F.lit("bucket"), "sig").alias("gid"), "cid")
    grouped = work.stored(together.unionByName(buckets).distinct(), "groups")
    compared = _compared(work, grouped, texts, reps, width, percent)
    return compared if links is None else links.unionByName(compared)


def _vertices(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (doc_id, text, tag) -> rows (doc_id, tag, n, cid), reps (cid, rep, n), parts (cid, component), all stored."""
    work, kept = common.Scratch(docs.sparkSession, "jaccard"), common.Scratch(docs.sparkSession, "jaccard-kept")
    indexed = work.stored(_indexed(docs, frequent_tokens(docs, width), width, percent), "indexed", texts=True)
    first = indexed.where("cid is not null").groupBy("cid").agg(F.min("more").alias("least"), F.max("more").alias("most"))
    clash = [r["cid"] for r in first.where("least <> most").select("cid").collect()]  # equal in 64 bits but not in 128: n * n / 2 ** 65 of n

    def vertex(df: DataFrame) -> DataFrame:
        return df.withColumn("cid", F.when(F.col("cid").isin(clash), F.xxhash64("cid", "more")).otherwise(F.col("cid"))) if clash else df

    indexed = vertex(indexed)
    rows = kept.stored(indexed.select("doc_id", "tag", "n", "cid"), "rows")
    reps = rows.where("cid is not null").groupBy("cid").agg(F.min(F.coalesce("doc_id", F.lit(LEAST))).alias("any_rep"), F.min("doc_id").alias("known_rep"), F.max("n").alias("n"))
    reps = kept.stored(reps.select("cid", F.coalesce("known_rep", "any_rep").alias("rep"), "n"), "reps")
    sigs = indexed.where("size(sigs) > 0").select(F.explode("sigs").alias("sig"), "cid", "n")
    found = work.stored(sigs.repartition("sig").sortWithinPartitions("sig", "cid").mapInArrow(common.relieved(_buckets(percent)), "hot boolean, a long, b long"), "found")
    parts = components(_links(work, docs, found, indexed, reps, vertex, width, percent), work)
    parts = kept.stored(parts.select(F.col("node").alias("cid"), "component"), "parts")
    work.drop()
    return rows, reps, parts


def joined(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text); links from a similarity of percent / 100."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(None).cast("binary").alias("tag"))
    rows, reps, parts = _vertices(docs, width, percent)
    known = parts.join(reps, "cid").groupBy("component").agg(F.min("rep").alias("any"), F.min(F.when(F.col("rep") != LEAST, F.col("rep"))).alias("known"))
    first = parts.join(known, "component").select("cid", F.coalesce("known", "any").alias("first"))
    part = reps.select("cid", "rep").join(first, "cid", "left").select("cid", F.coalesce("first", "rep").alias("__part"))
    out = rows.join(part, "cid", "left").withColumn("component_id", F.coalesce("__part", "doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("component_id") != LEAST, F.col("component_id")).alias("component_id"))


def deduplicated(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each group of linked rows of docs (doc_id, text, ...), that of the smallest doc_id (null after all others;
    then the smallest digest of the text); the same columns.

    Rows are told apart by doc_id and text, so a row that shares only its doc_id with a copy stays. Of rows with equal doc_id and
    text one stays, also where they have no words. Empty table: empty result. Column names may hold dots and may clash."""
    # Texts stay where they are but for rows that a filter of the dropped and repeated ones points at.
    id_, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    tag = F.unhex(F.md5(F.coalesce(F.concat(F.lit("t"), text), F.lit("")).cast("binary")))
    rows, _, parts = _vertices(docs.select(id_.alias("doc_id"), text.alias("text"), tag.alias("tag")), width, percent)
    kept = common.Scratch(docs.sparkSession, "deduplicated")
    keys = rows.groupBy("doc_id", "tag").agg(F.first("cid").alias("cid"), F.count("*").alias("m")).join(parts, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "tag")
    first = keys.where("component is not null").groupBy("component").agg(F.min(order).alias("first"))
    told = keys.join(first, "component", "left").select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"), "m", (F.col("first").isNotNull() & (F.col("first") != order)).alias("gone"))
    told = kept.stored(told.where("gone or m > 1"), "told")
    at = lambda *key: F.shiftrightunsigned(F.xxhash64(*key), 64 - FILTER_BITS)
    words = _filter_words(told.select(at("__id", "__tag").alias("at")))
    columns = [common.named(c) for c in docs.columns]
    names = [f"c{i}" for i in range(len(columns))]
    plain = docs.select(*[c.alias(n) for c, n in zip(columns, names)], id_.alias("__doc"), tag.alias("__text"))
    on = lambda df: [plain["__doc"].eqNullSafe(df["__id"]), plain["__text"] == df["__tag"]]
    marked = plain.withColumn("__at", at("__doc", "__text")).join(F.broadcast(words), F.shiftright("__at", 6) == F.col("word"), "left")  # at most 2 ** (FILTER_BITS - 6) rows
    maybe = F.coalesce(F.expr("shiftright(bits, cast(__at & 63 as int)) & 1"), F.lit(0)) == 1
    clear, suspects = (marked.where(c).select(*plain.columns) for c in (~maybe, maybe))  # only suspects are shuffled
    out, twice = clear.unionByName(suspects.join(told, on(told), "left_anti")), told.where("not gone")
    if not twice.isEmpty():  # repeated rows: any one of them
        out = out.unionByName(suspects.join(twice, on(twice), "left_semi").dropDuplicates(["__doc", "__text"]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(common.table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 90)


ORACLE = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i : i + least(len(w), 3) - 1], ' ') as g
  from w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as u(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as hits from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * hits >= 90 * (x.n + y.n - hits)),
e as (select a, b from l union all select b, a from l),
r(doc_id, c) as (select doc_id, doc_id from documents union select e.b, r.c from r join e on e.a = r.doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.c) as component_id
from documents d join r using (doc_id) left join n using (doc_id) group by d.doc_id, n.n
"""

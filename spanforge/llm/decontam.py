"""Benchmark decontamination with suffix arrays over the training documents.

Each shard (a slice of a partition's documents, bounded in bytes) turns its words into numbers of the
benchmark's vocabulary, 0 for any other word, and sorts the suffixes that can match at all, those whose first
words are all known, into a suffix array. Every benchmark suffix is binary-searched in it for its window (10
words, or the whole item if it has fewer); the interval found holds all occurrences. Each is then carried to its
longest verbatim match in the benchmark's own suffix array, which orders whole suffixes: the interval of suffixes that
share the words so far is narrowed by ..., 4, 2, 1 further words. `matches` lists every item that holds the longest match
at a place, unless the match there is only the rest of one that begins before (once an item, at its first place in it).

Words: A-Z lower-cased, then runs of digits, a-z and anything beyond ASCII. Documents are never shuffled; the
benchmark is broadcast in blocks of at most BLOCK_WORDS words (a longer item alone), and a worker opens one after the
other, so it never holds more than one.

Defined cases: null text (document or item): no words, so no hit and no window. Null item_id: listed as "null".
Items with equal id count once. Repeated documents: each is judged. Empty tables: nothing hit. Input columns named
like an output column are replaced.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from spanforge.llm import common

WINDOW = 10
BLOCK_WORDS = 200_000
BITS = 21
#: Bytes of text that meet a block at a time; more if there are several blocks, which are opened anew each time.
SLICE = common.SLICE_BYTES
PER_KEY = 3
OUTPUTS = ("n_words", "n_hit", "n_items", "items_sha256", "longest", "matches", "contaminated")
COLUMNS = {
    "n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "longest": "long",
    "matches": "array<struct<start:long,length:long,item_id:string,item_start:long>>", "contaminated": "boolean",
}

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def _keys(ids: np.ndarray, at: np.ndarray, window: int, length: int, fill: int = 0) -> list[np.ndarray]:
    """The `length` words from each place, packed; words beyond length count as `fill`. ids must be padded."""
    out = []
    for j in range(0, window, PER_KEY):
        key = np.zeros(len(at), "int64")
        for i in range(j, j + PER_KEY):
            key = (key << BITS) | (ids[at + i] if i < length else fill)
        out.append(key)
    return out


class Block:
    """Some benchmark items: vocabulary, windows by length, sorted suffixes."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        self.vocabulary: dict[bytes, int] = {}
        ids, owner, left, place, self.windows = [], [], [], [], []
        for name, ws in items:
            known = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws]
            ids += [*known, 0]
            owner += [number[name]] * (len(known) + 1)
            left += [*range(len(known), -1, -1)]
            place += [*range(len(known) + 1)]
        if len(self.vocabulary) >= (1 << BITS) - 1:
            raise ValueError(f"a benchmark item has {len(self.vocabulary):,} different words; at most {(1 << BITS) - 2:,} can be told apart")
        self.ids = np.concatenate([np.array(ids, "int64"), np.zeros(window + PER_KEY, "int64")])
        owner, left = np.array(owner, "int64"), np.array(left, "int64")
        first = np.concatenate([[True], left[:-1] == 0]) if len(left) else np.zeros(0, bool)
        for length in sorted({*np.minimum(left[first & (left > 0)], window).tolist()}):
            at = np.flatnonzero((left >= window) if length == window else first & (left == length))
            rows = np.stack(_keys(self.ids, at, window, length), 1)
            low, back = np.unique(rows, axis=0, return_inverse=True)
            owners = np.unique(np.stack([back.ravel(), owner[at]], 1), axis=0)
            pad = (1 << BITS) - 1
            here = np.zeros(len(low), "int64")
            here[back.ravel()] = at
            high = np.stack(_keys(self.ids, here, window, length, pad), 1)
            self.windows.append((length, low, high, np.searchsorted(owners[:, 0], np.arange(len(low) + 1)), owners[:, 1], here))
        self.owner, self.place = owner, np.array(place, "int64")
        self._sort(int(left.max(initial=0)))

    def _sort(self, most: int) -> None:
        """`ranks`: of the 1, 2, 4, ... words from each place, up to `most`; `pairs`: the pairs of ranks behind each next rank;
        `order`: the places, sorted by more than `most` words."""
        rank, n, k = self.ids, len(self.ids), 1
        self.ranks, self.pairs = [], []
        while True:
            self.ranks.append(rank.astype("int32"))
            pairs, rank = np.unique(self._paired(rank, k, 0), return_inverse=True)
            k *= 2
            if k > most:
                break
            self.pairs.append(pairs)
        self.order = np.argsort(rank.ravel(), kind="stable").astype("int32")

    def _paired(self, rank: np.ndarray, k: int, beyond: int) -> np.ndarray:
        """One key of each rank and the rank k places on."""
        rank = rank.astype("int64").ravel()
        return rank * (len(self.ids) + 1) + np.concatenate([rank[k:], np.full(min(k, len(rank)), beyond)])

    def search(self, sorted_keys: list[np.ndarray], wanted: np.ndarray, after: bool) -> np.ndarray:
        """For each wanted row of keys, how many of the sorted suffixes are less (after: or equal)."""
        lo, hi = np.zeros(len(wanted), "int64"), np.full(len(wanted), len(sorted_keys[0]), "int64")
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less, equal = np.zeros(len(wanted), bool), np.ones(len(wanted), bool)
            for j, key in enumerate(sorted_keys):
                x = key[np.minimum(mid, len(key) - 1)]
                less |= equal & (x < wanted[:, j])
                equal &= x == wanted[:, j]
            go = open_ & ((less | equal) if after else less)
            lo = np.where(go, mid + 1, lo)
            hi = np.where(open_ & ~go, mid, hi)
        return lo

    def _bound(self, rank: np.ndarray, size: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
        """Where wanted goes in each interval [lo, hi) of `order`, by the rank `size` words on (after: behind equal ones)."""
        lo, hi, last = lo.copy(), hi.copy(), len(self.order) - 1
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            x = rank[np.minimum(self.order[np.minimum(mid, last)] + size, last)]
            go = open_ & ((x <= wanted) if after else (x < wanted))
            lo = np.where(go, mid + 1, lo)
            hi = np.where(open_ & ~go, mid, hi)
        return lo

    def longest(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place of `at` in a document's words (the last is 0): the words of its longest match, and the interval of
        `order` that holds all occurrences of it."""
        known = [np.where(ids > 0, ids, -1)]
        for j, pairs in enumerate(self.pairs):
            first, key = known[-1], self._paired(known[-1], 1 << j, -1)
            second = np.concatenate([first[1 << j :], np.full(min(1 << j, len(first)), -1)])
            i = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
            known.append(np.where((first >= 0) & (second >= 0) & (pairs[i] == key), i, -1))
        lo, hi, size = np.zeros(len(at), "int64"), np.full(len(at), len(self.order), "int64"), np.zeros(len(at), "int64")
        for j in reversed(range(len(self.ranks))):
            wanted = known[j][at + size]
            a = self._bound(self.ranks[j], size, lo, hi, wanted, False)
            b = self._bound(self.ranks[j], size, a, hi, wanted, True)
            found = (wanted >= 0) & (a < b)
            lo, hi, size = np.where(found, a, lo), np.where(found, b, hi), size + (found << j)
        return size, lo, hi

    def occurrences(self, docs: list[list[bytes]], locate: bool):
        """hits (bool for each word of all documents), {(document, item name)}, matches by document."""
        sizes = np.array([len(d) for d in docs], "int64")
        start = np.concatenate([[0], np.cumsum(sizes + 1)])  # one 0 between documents
        ids = np.zeros(start[-1] + self.window + PER_KEY, "int64")
        get = self.vocabulary.get
        for s, d in zip(start.tolist(), docs):
            ids[s : s + len(d)] = np.fromiter(map(get, d, repeat(0)), "int64", len(d))
        mark, pairs, begins, short = np.zeros(len(ids) + 1, "int64"), set(), [], {}
        known = np.cumsum(ids > 0)
        for length, low, high, owned, owners, here in self.windows:
            run = known[length - 1 :] - np.concatenate([[0], known[: len(known) - length]])
            at = np.flatnonzero(run == length)
            if not len(at):
                continue
            keys = _keys(ids, at, self.window, self.window)  # beyond a short window what follows is sorted too
            order = np.lexsort(keys[::-1])
            array, keys = at[order], [k[order] for k in keys]
            lo, hi = self.search(keys, low, False), self.search(keys, high, True)
            for w in np.flatnonzero(hi > lo).tolist():
                found = array[lo[w] : hi[w]]
                np.add.at(mark, found, 1)
                np.add.at(mark, found + length, -1)
                if length == self.window:
                    begins.append(found)
                elif locate:
                    short.update((p, (length, owners[owned[w] : owned[w + 1]])) for p in found.tolist() if p not in short or short[p][0] < length)
                for d in np.unique(np.searchsorted(start, found, side="right") - 1).tolist():
                    pairs.update((d, self.names[o]) for o in owners[owned[w] : owned[w + 1]].tolist())
        hit, spans = np.cumsum(mark[:-1]) > 0, []
        if locate and begins:
            at = np.unique(np.concatenate(begins))
            keep = hit | np.concatenate([[False], hit[:-1]])  # matches lie in the words that are hit; one 0 after each run
            size, lo, hi = self.longest(np.where(hit, ids, 0)[keep], (np.cumsum(keep) - 1)[at])
            rest = np.zeros(len(at), bool)
            rest[1:] = (at[1:] == at[:-1] + 1) & (size[1:] == size[:-1] - 1) & ((hi - lo)[1:] == (hi - lo)[:-1])
            for i in np.flatnonzero(~rest).tolist():
                p, q = int(at[i]), np.sort(self.order[lo[i] : hi[i]])
                if p and ids[p - 1]:  # an occurrence that goes on to the left is listed there
                    q = q[(q == 0) | (self.ids[q - 1] != ids[p - 1])]
                owner, first = np.unique(self.owner[q], return_index=True)
                spans += [(p, int(size[i]), self.names[o], int(x)) for o, x in zip(owner.tolist(), self.place[q[first]])]
            for p in at.tolist():
                short.pop(p, None)
        spans += [(p, n, self.names[o], 0) for p, (n, owners) in short.items() for o in owners.tolist()]
        matches: dict[int, list] = {}
        for p, *x in sorted(spans):
            d = int(np.searchsorted(start, p, side="right") - 1)
            matches.setdefault(d, []).append((p - int(start[d]), *x))
        return hit, start, pairs, matches


def blocks(benchmark: DataFrame, window: int = WINDOW) -> list:
    """Broadcast blocks of at most BLOCK_WORDS benchmark words (a longer item stands alone)."""
    spark, out, items, held = benchmark.sparkSession, [], [], 0

    def flush():
        if items:
            out.append(common.share(spark, Block(items, window)))

    for r in benchmark.select("item_id", "text").toLocalIterator():
        if ws := words(r["text"]):
            if held + len(ws) > BLOCK_WORDS:
                flush()
                items, held = [], 0
            items.append(("null" if r["item_id"] is None else str(r["item_id"]), ws))
            held += len(ws)
    flush()
    return out


def held(found: list):
    """A function that opens the blocks of `found` one after the other; a lone one stays open."""
    if len(found) == 1:
        only = [common.opened(found[0])]
        return lambda: only
    return lambda: map(common.opened, found)


def judged(texts: list[str | None], found, locate: bool = True) -> list[tuple]:
    """The output columns for some texts; found: the blocks."""
    docs = [words(t) for t in texts]
    sizes = [len(d) for d in docs]
    hit, start, pairs, matches = None, None, set(), {}
    for block in found:
        h, start, p, m = block.occurrences(docs, locate)
        hit = h if hit is None else hit | h
        pairs |= p
        for d, x in m.items():
            matches.setdefault(d, []).extend(x)
    items: dict[int, list[str]] = {}
    for d, name in pairs:
        items.setdefault(d, []).append(name)
    total = np.concatenate([[0], np.cumsum(hit)]) if hit is not None else None
    out = []
    for d, n in enumerate(sizes):
        n_hit = int(total[start[d] + n] - total[start[d]]) if total is not None else 0
        names, at = sorted(items.get(d, [])), matches.get(d, [])
        out.append((n, n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), max((m[1] for m in at), default=0), at, n_hit > 0))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, locate: bool = True) -> DataFrame:
    """docs (text, ...) with n_words, n_hit, n_items, items_sha256, longest, matches and contaminated."""
    import pyarrow as pa

    docs = common.without(docs, *OUTPUTS)
    found, names = blocks(benchmark, window), list(COLUMNS)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("item_id", pa.string()), ("item_start", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), kind, pa.bool_()]

    def run(batches):
        opened = held(found)
        for batch in batches:
            for part in common.slices(batch, limit=SLICE * min(4, max(1, len(found)))):
                rows = judged(part.column(part.schema.get_field_index("text")).to_pylist(), opened(), locate)
                fields = ("start", "length", "item_id", "item_start")
                spans = [[dict(zip(fields, m)) for m in r[5]] for r in rows]
                made = [pa.array(spans if i == 5 else [r[i] for r in rows], kinds[i]) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *names])

    return common.mapped(docs, run, common.add_columns(docs.schema, **COLUMNS))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those that hold a benchmark window; the same columns."""
    import pyarrow as pa

    found = blocks(benchmark, window)

    def run(batches):
        opened = held(found)
        for batch in batches:
            for part in common.slices(batch, limit=SLICE * min(4, max(1, len(found)))):
                rows = judged(part.column(part.schema.get_field_index("text")).to_pylist(), opened(), False)
                yield part.filter(pa.array([not r[-1] for r in rows], pa.bool_()))

    return common.mapped(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest")


ORACLE = """
with d as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '[^ ]+') as w
  from documents),
b as (
  select coalesce(item_id::varchar, 'null') as item, row_number() over () as br,
    regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '[^ ]+') as w
  from benchmark),
bw as (
  select item, br, i, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as g
  from b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as u(i) where len(w) > 0),
lens as (select distinct n from bw),
dw as (
  select r, n, i, array_to_string(w[i : i + n - 1], ' ') as g
  from d, lens, unnest(range(1, len(w) - n + 2)) as u(i) where len(w) >= n),
o as (select distinct r, item, br, bw.i as bi, dw.i as di, dw.n from dw join bw on dw.g = bw.g and dw.n = bw.n),
h as (select r, count(distinct p) as n_hit from o, unnest(range(di, di + n)) as u(p) group by r),
t as (select r, count(distinct item) as n_items, sha256(string_agg(distinct item, ',' order by item)) as s from o group by r),
runs as (select r, count(*) + any_value(n) - 1 as len from (
    select *, di - row_number() over (partition by r, br, di - bi order by di) as island from o) group by r, br, di - bi, island),
m as (select r, max(len) as longest from runs group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(s, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(longest, 0)::bigint as longest
from d left join h using (r) left join t using (r) left join m using (r)
"""

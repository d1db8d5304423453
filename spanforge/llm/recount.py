"""Edit-aware token counts.

A document is kept as a tree over its pre-tokens: leaves hold runs of pre-tokens with their characters and tokens, inner
nodes the sums of what lies below. An edit re-splits the text from the last boundary that it cannot have moved (the
pattern looks at most two characters beyond a pre-token) to the first later boundary that the old text had too; only
the pre-tokens between are encoded again, and the sums on the paths to the changed leaves are updated. All other leaves
stay as they are, however long the document.

`counted` gives the state of each document (characters and tokens of its pre-tokens), `recounted` takes it up and applies
edits (start, stop, text), one after the other, each in places of the text as it then is; places beyond the end mean
the end.

Defined cases: null text: counts 0, edits apply to the empty text. Null edits, or a null edit text: none, or a deletion.
Repeated rows: each is counted. Empty table: empty result. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import bpe, common

LEAF = 64
#: Characters beyond the end of a pre-token that its end can depend on.
AHEAD = 2
#: Pieces whose counts a worker remembers.
REMEMBERED = 500_000
STATE = {"n_tokens": "long", "n_pretokens": "long", "piece_chars": "binary", "piece_tokens": "binary"}
COUNTS = {"n_tokens_edited": "long", "n_pretokens_edited": "long", "n_reencoded": "long", "n_chars_edited": "long"}


class Counts(dict):
    """Tokens of each pre-token met so far."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = len(self.encode(piece))
        if len(piece) < 64:
            self[piece] = n
        return n


class Leaf:
    __slots__ = ("text", "chars", "tokens")

    def __init__(self, text: str, chars: list[int], tokens: list[int]):
        self.text, self.chars, self.tokens = text, chars, tokens


class Tree:
    """The pre-tokens of one document with sums over subtrees."""

    def __init__(self, text: str, pattern, counts, chars=None, tokens=None):
        self.pattern, self.counts, self.encoded = pattern, counts, 0
        if chars is None:
            pieces = pattern.findall(text)
            chars, tokens = list(map(len, pieces)), list(map(counts.__getitem__, pieces))
        self.leaves, at = [], 0
        for i in range(0, len(chars), LEAF):
            n = sum(chars[i : i + LEAF])
            self.leaves.append(Leaf(text[at : at + n], chars[i : i + LEAF], tokens[i : i + LEAF]))
            at += n
        self._plant()

    def _plant(self) -> None:
        """Sums over the leaves; no text is looked at."""
        self.leaves = self.leaves or [Leaf("", [], [])]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = [(0, 0, 0)] * (2 * self.width)
        for i, leaf in enumerate(self.leaves):
            self.sums[self.width + i] = (len(leaf.text), sum(leaf.tokens), len(leaf.tokens))
        for i in range(self.width - 1, 0, -1):
            a, b = self.sums[2 * i], self.sums[2 * i + 1]
            self.sums[i] = (a[0] + b[0], a[1] + b[1], a[2] + b[2])

    def _update(self, i: int) -> None:
        leaf, at = self.leaves[i], self.width + i
        self.sums[at] = (len(leaf.text), sum(leaf.tokens), len(leaf.tokens))
        while at > 1:
            at >>= 1
            a, b = self.sums[2 * at], self.sums[2 * at + 1]
            self.sums[at] = (a[0] + b[0], a[1] + b[1], a[2] + b[2])

    @property
    def n_chars(self) -> int:
        return self.sums[1][0]

    @property
    def n_tokens(self) -> int:
        return self.sums[1][1]

    @property
    def n_pieces(self) -> int:
        return self.sums[1][2]

    def text(self) -> str:
        return "".join(leaf.text for leaf in self.leaves)

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a place, and where it begins."""
        at, begin = 1, 0
        while at < self.width:
            at *= 2
            if begin + self.sums[at][0] <= place and self.sums[at + 1][0]:
                begin += self.sums[at][0]
                at += 1
        return at - self.width, begin

    def _text(self, start: int, stop: int) -> str:
        i, begin = self._leaf_at(start)
        out = []
        while begin < stop and i < len(self.leaves):
            t = self.leaves[i].text
            out.append(t[max(0, start - begin) : stop - begin])
            begin += len(t)
            i += 1
        return "".join(out)

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace the characters from start to stop."""
        n = self.n_chars
        start = min(max(start, 0), n)
        stop = min(max(stop, start), n)
        i, begin = self._leaf_at(max(0, start - AHEAD))
        piece, restart = 0, begin
        while True:  # the first pre-token that ends within AHEAD of the edit, or later
            leaf = self.leaves[i]
            while piece < len(leaf.chars) and restart + leaf.chars[piece] + AHEAD <= start:
                restart += leaf.chars[piece]
                piece += 1
            if piece < len(leaf.chars) or i + 1 == len(self.leaves):
                break
            i, piece = i + 1, 0
        head = self._text(restart, start) + new
        j, p, old = i, piece, restart  # the next old boundary is the end of pre-token p of leaf j
        known, at, made, span = len(head), 0, [], 256
        joined = head + self._text(stop, stop + span)
        whole = stop + span >= n
        while at < len(joined) or not whole:
            m = self.pattern.match(joined, at) if at < len(joined) else None
            if not whole and (m is None or m.end() + AHEAD > len(joined)):  # the end of what was fetched might have cut it
                span *= 4
                joined = head + self._text(stop, stop + span)
                whole = stop + span >= n
                continue
            made.append(m[0])
            at = m.end()
            if at < known:
                continue
            there = stop + at - known
            while old < there and j < len(self.leaves):
                if p == len(self.leaves[j].chars):
                    j, p = j + 1, 0
                    continue
                old += self.leaves[j].chars[p]
                p += 1
            if old == there:
                break
        else:
            j, p = len(self.leaves) - 1, len(self.leaves[-1].chars)
        j = min(j, len(self.leaves) - 1)
        self.encoded += len(made)
        first, last = self.leaves[i], self.leaves[j]
        chars = first.chars[:piece] + list(map(len, made)) + last.chars[p:]
        tokens = first.tokens[:piece] + list(map(self.counts.__getitem__, made)) + last.tokens[p:]
        text = first.text[: sum(first.chars[:piece])] + "".join(made) + last.text[sum(last.chars[:p]) :]
        if len(chars) <= 4 * LEAF:
            for k in range(i + 1, j + 1):
                self.leaves[k] = Leaf("", [], [])
            self.leaves[i] = Leaf(text, chars, tokens)
            for k in range(i, j + 1):
                self._update(k)
        else:
            split, at = [], 0
            for k in range(0, len(chars), LEAF):
                size = sum(chars[k : k + LEAF])
                split.append(Leaf(text[at : at + size], chars[k : k + LEAF], tokens[k : k + LEAF]))
                at += size
            self.leaves[i : j + 1] = split
            self._plant()


def _tools(data: bytes):
    import regex

    return regex.compile(bpe.PATTERN), Counts(bpe.encoding(data).encode_ordinary)


def counted(docs: DataFrame, folder: str = bpe.FOLDER) -> DataFrame:
    """docs (text, ...) with n_tokens, n_pretokens and the state from which edits are counted."""
    import pyarrow as pa

    docs = common.without(docs, *STATE)
    ranks = bpe.broadcast(docs.sparkSession, folder)

    def run(batches):
        pattern, counts = _tools(ranks.value)
        for batch in batches:
            for part in common.slices(batch):
                rows = []
                for text in part.column(part.schema.get_field_index("text")).to_pylist():
                    pieces = pattern.findall(text or "")
                    tokens = np.fromiter(map(counts.__getitem__, pieces), "int32", len(pieces))
                    chars = np.fromiter(map(len, pieces), "int32", len(pieces))
                    rows.append((int(tokens.sum()), len(pieces), chars.tobytes(), tokens.tobytes()))
                made = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *STATE])

    return common.mapped(docs, run, common.add_columns(docs.schema, **STATE))


def recounted(state: DataFrame, edits: str = "edits", folder: str = bpe.FOLDER) -> DataFrame:
    """state (text, piece_chars, piece_tokens, edits array<struct<start,stop,text>>) with the counts after the edits."""
    import pyarrow as pa

    state = common.without(state, *COUNTS)
    ranks = bpe.broadcast(state.sparkSession, folder)

    def run(batches):
        pattern, counts = _tools(ranks.value)
        for batch in batches:
            for part in common.slices(batch):
                get = lambda name, p=part: p.column(p.schema.get_field_index(name)).to_pylist()
                rows = []
                for text, chars, tokens, todo in zip(get("text"), get("piece_chars"), get("piece_tokens"), get(edits)):
                    tree = Tree(text or "", pattern, counts, np.frombuffer(chars, "int32").tolist(), np.frombuffer(tokens, "int32").tolist())
                    for e in todo or []:
                        tree.edit(e["start"], e["stop"], e["text"] or "")
                    rows.append((tree.n_tokens, tree.n_pieces, tree.encoded, tree.n_chars))
                made = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *COUNTS])

    return common.mapped(state, run, common.add_columns(state.schema, **COUNTS))


def scripted(docs: DataFrame) -> DataFrame:
    """docs with three edits at places that follow from the doc_id: a replacement, an insertion and a deletion."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    at = lambda by: F.floor(h / by) % (F.coalesce(F.length("text"), F.lit(0)) + 1)
    one = lambda start, size, text: F.struct(start.cast("long").alias("start"), (start + size).cast("long").alias("stop"), F.lit(text).alias("text"))
    return docs.withColumn("edits", F.array(one(at(1), 12, "reworded here"), one(at(7), 0, " newly added,"), one(at(61), 20, "")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scripted(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = recounted(counted(docs))
    return out.select("doc_id", "n_tokens", "n_pretokens", F.size("edits").alias("n_edits"), *COUNTS)

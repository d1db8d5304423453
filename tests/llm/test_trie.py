import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spanforge.llm import registry, trie

ROWS = "conv_id long, turn long, role string, text string, depth long, conv string"


def forest(seqs):
    """NODES of sequences {conv: ((symbol, words), ...)} by definition."""
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)

    def below(p):
        yield p
        for k in kids[p]:
            yield from below(k)

    out = []
    for p, m in members.items():
        under = list(below(p))
        ends = ",".join(str(c) for c in sorted(c for c in m if len(seqs[c]) == len(p)))
        saved = sum((len(members[q]) - 1) * (q[-1][1] if q else 0) for q in under)
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), len(kids[p]), sum(not kids[q] for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def made(spark, seqs, **kw):
    rows = [(c, i, repr(w).encode(), w[1]) for c, s in seqs.items() for i, w in enumerate(s)]
    turns = spark.createDataFrame(rows, "conv long, pos long, t binary, words long").select("conv", "pos", F.unhex(F.md5("t")).alias("digest"), "words")
    convs = spark.createDataFrame([(c,) for c in seqs], "conv long")
    return sorted(repr(tuple(r[c] for c in trie.NODES)) for r in trie.trie(turns, convs, **kw).collect())


def sample(n, seed, longest=9):
    draw, out = random.Random(seed), {}
    words = {w: draw.randint(0, 5) for w in "abc"}
    for c in draw.sample(range(-50, 4 * n), n):
        if out and draw.random() < 0.5:
            base = out[draw.choice(list(out))]
            s = base[: draw.randint(0, len(base))]
        else:
            s = ()
        while draw.random() < 0.7 and len(s) < longest:
            w = draw.choice("aab" if draw.random() < 0.9 else "c")
            s += ((w, words[w]),)
        out[c] = s
    return out


@pytest.mark.parametrize("piece,run_bytes", [(256, 1), (256, 8 << 20), (2, 2000), (3, 8 << 20)])
def test_against_definition(spark, piece, run_bytes):
    """Runs of one row, of some and of all; pieces of two or three turns, so that paths go through several."""
    seqs = sample(150, 3)
    assert made(spark, seqs, piece=piece, run_bytes=run_bytes, range_bytes=1500) == forest(seqs)


def test_hot_copies(spark):
    """A third of all rows is one conversation; its ids, children and parents go over many ranges."""
    seqs = sample(60, 4) | {1000 + i: (("a", 3), ("b", 1), ("q", 2)) for i in range(400)} | {3000 + i: (("a", 3), (str(i), 1)) for i in range(200)}
    assert made(spark, seqs, range_bytes=2000) == forest(seqs)


def test_long_conversation(spark):
    """Longer than a piece: alone, with a copy, and as the start of another."""
    long = tuple((str(i), 1) for i in range(700))
    seqs = {1: long, 2: long[:300], 3: long[:256], 5: (), 4: tuple(("x" + str(i), 2) for i in range(600))}
    assert made(spark, seqs) == forest(seqs)
    twice = {1: long[:40], 2: long[:40], 9: long[:12], 0: long[:10]}
    assert made(spark, twice, piece=5) == forest(twice)


def test_merge_takes_every_order():
    draw = random.Random(1)
    for n in range(1, 12):
        rows = [([bytes([draw.randint(0, 2)]) * 16 for _ in range(draw.randint(1, 5))], c, [], True, None) for c in range(40)]
        draw.shuffle(rows)
        parts = [rows[i::n] for i in range(n)]
        runs = [trie.Run(blob) for p in parts for _, _, blob in trie.packed([(s, c, [0] * len(s), e, a) for s, c, _, e, a in p], [])]
        out, before = [], []
        for r, lcp in trie.merged(runs):
            assert lcp == trie.shared(before, r.symbols, 0)
            before = r.symbols
            out.append((r.symbols, r.conv))
        assert out == sorted((s, c) for s, c, *_ in rows)


def contract(rows):
    """The rebuilt conversations by definition."""
    by = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [t for *_, t in sorted(v)] for c, v in by.items()}
    out = {}
    for c, turns in own.items():
        h, giver = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = tuple(((r, t), len(t.encode().translate(bytes(range(256)).replace(b"\x1c", b"\x1c")).split())) for r, t in own.get(giver, [])[:h] + turns[h:])
    return out


def test_odd_conversations(spark, write, agree):
    """Null turn, role, text and conv_id, equal turns, empty and long texts, absent givers, turnless results, other columns."""
    rows = [(c, t, r, x, 1, "k") for c in (0, 1, 2, 3, 4, 5, 20, 21, 25, 47, 48, -3) for t, r, x in ((1, "user", f"hello {c % 3} there"), (2, "assistant", "yes indeed"), (3, "user", "bye"))]
    rows += [(0, None, None, None, 1, "k"), (1, None, "user", "", None, None), (2, 2, "assistant", "yes indeed", 1, "k"), (2, 2, "b", "a tie", 1, "k"), (None, 1, "user", "nobody", 1, "k")]
    rows += [(60 + i, 5, "user", "one turn only", 1, "k") for i in range(1, 8)] + [(6, 9, "user", "word " * 200_000, 1, "k")]
    folder = write(conversations=spark.createDataFrame(rows, ROWS))
    df = registry.queries()["op11_trie"](spark, folder)
    assert sorted(repr(tuple(r[c] for c in trie.NODES)) for r in df.collect()) == forest(contract(rows))
    assert agree(df, trie.ORACLE, folder) > 20
    empty = write(conversations=spark.createDataFrame([], ROWS))
    assert registry.queries()["op11_trie"](spark, empty).collect() == []


def test_places_over_ranges(spark):
    """One conversation with most of the turns lies in several ranges and is counted through."""
    rows = [(7, t, "user", f"t{t % 10}", 0, "") for t in range(5000)] + [(c, t, "user", "x", 0, "") for c in (6, 8) for t in range(3)]
    got = trie.placed(spark.createDataFrame(rows, ROWS).repartition(8)).collect()
    assert sorted((r["conv"], r["pos"]) for r in got) == sorted((c, t) for c, t, *_ in rows)
    digest = {r["pos"]: bytes(r["digest"]) for r in got if r["conv"] == 7}
    assert all(digest[t] == hashlib.md5(f"4:usert{t % 10}".encode()).digest() for t in range(5000))

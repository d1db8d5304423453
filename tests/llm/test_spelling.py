import random
import zlib
from collections import Counter

import pytest

from spanforge.llm import registry, spelling

DOCS = "doc_id long, text string, word string, n long"


def brute(rows):
    """All columns by definition, every word against every other."""
    import re

    n = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def one(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [o for o in n if one(w, o)] for w in n}
    form = {w: min(near[w], key=lambda o: (-n[o], o), default=None) for w in n}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), c, len(near[w]), n[form[w]] if form[w] else 0) for w, c in n.items())


def got(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def variants(spark, rows, long=spelling.LONG):
    return got(spelling.variants(spelling.frequent(spelling.slipped(spark.createDataFrame(rows, DOCS))), long=long))


@pytest.mark.parametrize("long", [100, 7])
def test_against_every_pair(spark, long):
    draw = random.Random(5)
    stems = ["colour", "color", "colours", "greyés", "GreyÉs", "aaaaa", "aaaaaa", "aaaaaaa", "abcde", "bacde", "ababab", "bababa", "centre", "center"]
    rows = []
    for i in range(400):
        words = [draw.choice(stems) for _ in range(draw.randint(0, 12))]
        words = [w[:k] + draw.choice("abcx") + w[k + draw.randint(0, 1) :] if draw.random() < 0.3 else w for w in words for k in [draw.randrange(len(w))]]
        rows.append((i, draw.choice([" ", "-", "1", "\n"]).join(words), "x", 1))
    rows += [(1000 + i, w, "x", 1) for w, n in (("whale", 40), ("whxle", 12), ("wyxle", 5)) for i in range(n)]
    want = brute(rows)
    assert any(f and r != f for _, f, r, *_ in want)  # a chain of two forms at least
    assert variants(spark, rows, long) == want


def test_odd_rows(spark):
    """Null and empty texts, null and equal ids, repeated rows, clashing columns, a run longer than any word."""
    long = "q" * 3000 + "é" + "z" * 3000
    rows = [(None, "abcde abcdf ABCDE", "x", 1)] * 2 + [(1, None, None, None), (2, "", "x", 1), (3, " \n", "x", 1), (7, "abcde " * 5000, "x", 1), (7, "abcdf", "x", 1)]
    rows += [(i, f"{long} {long}x {'y' * 100} {'y' * 101} {'y' * 102}", "x", 1) for i in range(6)]
    assert variants(spark, rows) == brute(rows)
    assert variants(spark, []) == []
    assert variants(spark, [(1, None, "x", 1)]) == []


def test_columns(spark, write):
    folder = write(documents=spark.createDataFrame([(1, "abcde " * 3, "x", 1)], DOCS))
    df = registry.queries()["op12_spelling"](spark, folder)
    assert dict(df.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert [tuple(r) for r in df.collect()] == [("abcde", None, "abcde", 3, 0, None)]


def test_hashed_keys_are_those_of_the_word():
    for word in ("a", "aab", "ÿxyzzy"):
        assert len(spelling.hashed(word)) == len({word, *(word[:i] + word[i + 1 :] for i in range(len(word)))})
    assert spelling.hashed("abcd") & spelling.hashed("abxd")
    assert not spelling.hashed("abcd") & spelling.hashed("axyd")


def test_words_and_keys_are_never_broadcast(spark, monkeypatch):
    """Tables in compressed files look small: broadcast, they would go through the driver whole."""
    plans, stored = [], spelling.common.Scratch.stored
    keep = lambda self, df, *rest, **more: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(self, df, *rest, **more)
    monkeypatch.setattr(spelling.common.Scratch, "stored", keep)
    out = spelling.variants(spark.createDataFrame([("whale", 40), ("whxle", 12), ("wyxle", 5), ("w" * 120, 3), ("w" * 121, 9)], "word string, n long"))
    assert out.count() == 5
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)

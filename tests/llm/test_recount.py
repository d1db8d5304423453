import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.llm import bpe, recount

with open(f"{bpe.FOLDER}/{bpe.RANKS}", "rb") as f:
    ENCODE = bpe.encoding(f.read()).encode_ordinary
PATTERN = regex.compile(bpe.PATTERN)
TEXT = st.text(alphabet="ab'sltre \n\tÉ9!日.", max_size=60)
EDITS = st.lists(st.tuples(st.integers(0, 80), st.integers(0, 30), TEXT), max_size=6)


def apply(text, edits):
    for start, size, new in edits:
        start = min(start, len(text))
        text = text[:start] + new + text[min(start + size, len(text)) :]
    return text


@settings(max_examples=400, deadline=None)
@given(TEXT, EDITS)
def test_equals_counting_anew(text, edits):
    counts = recount.Counts(ENCODE)
    tree = recount.Tree(text, PATTERN, counts)
    for start, size, new in edits:
        tree.edit(start, start + size, new)
    want = apply(text, edits)
    assert tree.text() == want
    assert tree.n_tokens == len(ENCODE(want)) and tree.n_pieces == len(PATTERN.findall(want)) and tree.n_chars == len(want)


@pytest.mark.parametrize("leaf", [1, 2, 5])
def test_small_leaves_and_long_texts(monkeypatch, leaf):
    monkeypatch.setattr(recount, "LEAF", leaf)
    text = "one two, three's   four\n\n five " * 40
    tree = recount.Tree(text, PATTERN, recount.Counts(ENCODE))
    for start, stop, new in ((0, 0, "x"), (300, 310, "abc " * 50), (5, 900, ""), (10**9, 10**9, " end"), (40, 40, "'"), (0, 10**9, ""), (0, 0, "new text's")):
        tree.edit(start, stop, new)
        start, stop = min(start, len(text)), min(stop, len(text))
        text = text[:start] + new + text[stop:]
        assert tree.text() == text and tree.n_tokens == len(ENCODE(text)) and tree.n_pieces == len(PATTERN.findall(text))


def test_only_the_surroundings_are_encoded_again():
    text = "some words that go on and on " * 20_000
    tree = recount.Tree(text, PATTERN, recount.Counts(ENCODE))
    tree.edit(300_000, 300_004, "other")
    assert tree.encoded < 10
    tree.edit(0, 0, " " * 5000)
    assert tree.n_tokens == len(ENCODE(tree.text()))


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    edits = {r["doc_id"]: (r["text"], r["edits"]) for r in recount.scripted(docs).collect()}
    for r in recount.query(spark, "/root/testdata/sf0.001").collect():
        text, todo = edits[r["doc_id"]]
        assert r["n_tokens"] == len(ENCODE(text))
        after = apply(text, [(e["start"], e["stop"] - e["start"], e["text"]) for e in todo])
        assert (r["n_tokens_edited"], r["n_chars_edited"]) == (len(ENCODE(after)), len(after))
        assert r["n_reencoded"] < 60 or r["n_reencoded"] < r["n_pretokens"]

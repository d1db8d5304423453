"""Chat formatting in budgeted windows.

A conversation's turns are formatted with a template that marks turns and escapes its own control strings inside
texts; a backslash before a control string or a backslash undoes itself, so texts come back exactly. Prefix sums of
the turns' tokens choose the longest turn-aligned span of new turns that fits the budget next to the retained system
turn and a limited history of repeated turns. The loss mask covers each assistant text once: repeated turns are
masked.

Defined cases: null text or role: empty. Null turn: after the others. Equal turns: ordered by role, then text. Null
conv_id: one conversation of its own. A turn larger than the budget stands whole in a window of its own, beside the
system turn. Empty table: no windows. Columns beyond conv_id, turn, role and text are ignored.

Scale: one shuffle by conversation to make the windows, which are written, and one to read them back from their files; turns
and windows stream through the workers in order, so a conversation with very many turns needs memory for one window only.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import bpe, common

BUDGET = 1024
HISTORY_TOKENS = 256
HISTORY_TURNS = 4
CONTROL = re.compile(r"\\|<(?=/?turn[ >])")
ROLE_CONTROL = re.compile(r'\\|"|<(?=/?turn[ >])')
ESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r'<turn role="((?:[^"\\]|\\.)*+)">\n((?:[^\\<]+|\\.|<(?!/turn>))*+)</turn>\n', re.S)
WINDOWS = "conv_id string, window long, text string, tokens long, new_from long, loss array<struct<start:long,stop:long>>"
EXTRA = [("-7", 0, "user"), ("-7", 1, "assistant")]
EXTRA_TEXT = "\\### Assistant: </turn> ok"


def turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends."""
    head = '<turn role="' + ROLE_CONTROL.sub(lambda m: "\\" + m[0], role) + '">\n'
    body = CONTROL.sub(lambda m: "\\" + m[0], text)
    return head + body + "</turn>\n", len(head), len(head) + len(body)


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def turns(text: str) -> list[tuple[str, str, int]]:
    """(role, text, place) of each turn of a formatted window."""
    out, at = [], 0
    while at < len(text):
        if not (m := TURN.match(text, at)):
            raise ValueError(f"no turn at {at}")
        out.append((unescaped(m[1]), unescaped(m[2]), at))
        at = m.end()
    return out


class Windows:
    """The windows of one conversation, made while its turns come in; at most about one window is held."""

    def __init__(self, budget: int, history_tokens: int, history_turns: int):
        self.budget, self.history_tokens, self.history_turns = budget, history_tokens, history_turns
        self.system, self.past, self.new, self.sums, self.n, self.began = [], [], [], [0], 0, False

    def add(self, role: str, text: str, tokens: int):
        piece = (role, *turn(role, text), tokens)
        self.new.append(piece)
        self.sums.append(self.sums[-1] + tokens)
        if not self.began and role == "system":
            self.system = [piece]
        self.began = True
        while (span := self._span()) < len(self.new):
            yield self._emit(span)

    def end(self):
        if self.new:
            yield self._emit(len(self.new))

    def _room(self) -> int:
        kept = self.system if self.n else []
        return self.budget - sum(p[4] for p in [*kept, *self.past])

    def _span(self) -> int:
        """How many of the new turns fit, by their prefix sums; repeated turns give way to the first of them."""
        while self.past and self.sums[1] > self._room():
            self.past.pop(0)
        return max(1, bisect_right(self.sums, self._room()) - 1)

    def _emit(self, span: int):
        repeated = [*(self.system if self.n else []), *self.past]
        shown, parts, loss, at = [*repeated, *self.new[:span]], [], [], 0
        for i, (role, formatted, start, stop, _) in enumerate(shown):
            parts.append(formatted)
            if role == "assistant" and i >= len(repeated):
                loss.append({"start": at + start, "stop": at + stop})
            at += len(formatted)
        out = (self.n, "".join(parts), sum(p[4] for p in shown), sum(len(p[1]) for p in repeated), loss)
        tail = [p for p in [*self.past, *self.new[:span]] if not (self.system and p is self.system[0])]
        room, keep = self.history_tokens, []
        for p in reversed(tail[-self.history_turns :] if self.history_turns else []):
            if (room := room - p[4]) < 0:
                break
            keep.insert(0, p)
        self.past, self.new, self.n = keep, self.new[span:], self.n + 1
        self.sums = list(accumulate((p[4] for p in self.new), initial=0))
        return out


def windows(rows: DataFrame, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS,
            folder: str = bpe.FOLDER) -> DataFrame:
    """Windows (see WINDOWS) of all conversations; those of one conversation are in one partition, in order."""
    ranks = bpe.broadcast(rows.sparkSession, folder)
    names = [c.split()[0] for c in WINDOWS.split(", ")]

    def run(batches):
        encode = bpe.encoding(ranks.value).encode_ordinary
        now, made, held = None, None, []

        def put(found, conv):
            held.extend((conv, *w) for w in found)

        for pdf in batches:
            for conv, role, text in zip(pdf["conv_id"], pdf["role"], pdf["text"]):
                if made is None or conv != now:
                    if made is not None:
                        put(made.end(), now)
                    now, made = conv, Windows(budget, history_tokens, history_turns)
                put(made.add(role, text, len(encode(turn(role, text)[0]))), now)
                if len(held) >= 500:
                    yield pd.DataFrame(held, columns=names)
                    held = []
        if made is not None:
            put(made.end(), now)
        yield pd.DataFrame(held, columns=names)

    keyed = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("conv_id"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ordered = keyed.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    return ordered.mapInPandas(run, WINDOWS)


def read_back(written: DataFrame) -> DataFrame:
    """Windows as files hold them, in any order -> those of one conversation together, in order."""
    return written.repartition("conv_id").sortWithinPartitions("conv_id", "window")


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long, max_tokens long"


def digests(made: DataFrame) -> DataFrame:
    """What is read back from windows: one row for each conversation. Windows must be in order within their conversation."""

    def run(batches):
        now, state, out = None, None, []

        def row():
            n, sha, chars, loss, formatted, count, most = state
            return (None if now == "null" else int(now), n, sha.hexdigest(), chars, loss.hexdigest(), formatted, count, most)

        for pdf in batches:
            for conv, text, tokens, new_from, spans in zip(pdf["conv_id"], pdf["text"], pdf["tokens"], pdf["new_from"], pdf["loss"]):
                if state is None or conv != now:
                    if state is not None:
                        out.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, said, at in turns(text):
                    if at >= new_from:
                        state[0] += 1
                        state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    said = unescaped(text[s["start"] : s["stop"]])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                state[5] += 1
                state[6] = max(state[6], int(tokens))
            if len(out) > 1000:
                yield _frame(out)
                out = []
        if state is not None:
            out.append(row())
        yield _frame(out)

    return made.mapInPandas(run, READ)


def _frame(rows: list) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")])
    frame["conv_id"] = frame["conv_id"].astype("Int64")
    return frame


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(int(c), t, r, EXTRA_TEXT) for c, t, r in EXTRA], "conv_id long, turn long, role string, text string")
    return digests(read_back(common.stored(windows(rows.unionByName(extra)), "windows")))

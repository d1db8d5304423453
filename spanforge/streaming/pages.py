"""Page review as a stream: the state of each page from its events, as they come in.

The batch counterpart is operators.pages.folded; both give the same rows once the same events are in. Events of a page may
arrive in any order within the watermark: those that a late one could still precede are kept beside the page's settled state and folded
again; a timer settles them when the watermark has passed, so the state of a page holds the events of one watermark delay only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "document_id string, page_number int, seq long, event string, text string, at timestamp"
STATE = "accepted boolean, blank boolean, text string, seq long, waiting string"
PAGE = "document_id string, page_number int, corrected_text string, accepted boolean, excluded_as_blank boolean, seq long"


def stepped(page: tuple, event: str, text: str | None) -> tuple:
    """(accepted, blank, corrected text) of a page after one more event; unknown events change nothing."""
    accepted, blank, corrected = page
    if event == "accept":
        return True, False, text
    if event == "blank":
        return True, True, None
    if event == "reset":
        return False, False, None
    if event == "rotate" and not blank:
        return False, blank, corrected
    return accepted, blank, corrected


def _updated(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    accepted, blank, corrected, seq, waiting = state.get if state.exists else (False, False, None, -1, "[]")
    settled, events = (accepted, blank, corrected), json.loads(waiting)
    if not state.hasTimedOut:
        for f in frames:
            times = (f["at"].astype("datetime64[us]").astype("int64") // 1000).tolist()
            events += [list(e) for e in zip(f["seq"].tolist(), f["event"].tolist(), [None if pd.isna(t) else t for t in f["text"]], times)]
    events = [list(e) for e in {e[0]: e for e in sorted(events, key=lambda e: e[0])}.values()]  # a repeated seq counts once
    passed = state.getCurrentWatermarkMs()
    now, last = settled, seq
    keep: list[list] = []
    for e in events:
        now, last = stepped(now, e[1], e[2]), max(last, e[0])
        if e[3] < passed and not keep:
            settled, seq = now, last
        else:
            keep.append(e)
    state.update((*settled, seq, json.dumps(keep)))
    if keep:
        state.setTimeoutTimestamp(max(min(e[3] for e in keep), passed) + 1)
    if not state.hasTimedOut:
        yield pd.DataFrame([(*key, now[2], now[0], now[1], last)], columns=["document_id", "page_number", "corrected_text", "accepted", "excluded_as_blank", "seq"])


def page_states(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of EVENT rows -> the state of each page that had events in a batch (update mode). seq orders a page's events and grows
    with their time; events older than the watermark are left out. Null text: none. A repeated seq counts once."""
    keyed = events.withWatermark("at", late).groupBy("document_id", "page_number")
    return keyed.applyInPandasWithState(_updated, PAGE, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def kept(states: DataFrame, path: str, checkpoint: str):
    """Write the updates of each batch into a folder of their own; a batch that runs again after a failure replaces its folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return states.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(updates: DataFrame) -> DataFrame:
    """The last state of each page from the updates that `kept` wrote."""
    newest = F.max_by(F.struct("corrected_text", "accepted", "excluded_as_blank", "seq"), "batch").alias("s")
    return updates.groupBy("document_id", "page_number").agg(newest).select("document_id", "page_number", "s.*")

"""The stream of page events against the batch fold."""

import random
from datetime import datetime, timedelta

from spanforge.operators import pages
from spanforge.streaming import pages as stream

BEGIN = datetime(2024, 5, 1)


def test_stream_equals_batch_after_a_restart(spark, tmp_path):
    """Events of a page come out of order and in several files; the stream stops in between and goes on."""
    draw, events = random.Random(4), []
    for page in range(12):
        for seq in range(draw.randint(1, 9)):
            kind = draw.choice(["accept", "blank", "rotate", "reset", "rotate"])
            events.append((f"d{page % 3}", page, seq, kind, f"text {seq}" if kind == "accept" else None, BEGIN + timedelta(minutes=4 * seq)))
    files = [[e for i, e in enumerate(events) if i % 4 == k] for k in (2, 0, 3, 1)]  # later events of a page before earlier ones
    want = sorted(map(tuple, pages.folded(spark.createDataFrame(events, stream.EVENT)).collect()))
    for k, rows in enumerate(files):
        draw.shuffle(rows)
        spark.createDataFrame(rows, stream.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k % 2:
            read = spark.readStream.schema(stream.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            stream.kept(stream.page_states(read, "2 hours"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(180)
    got = stream.latest(spark.read.parquet(f"{tmp_path}/out")).drop("seq")
    assert sorted(map(tuple, got.collect())) == want


def test_settled_events_are_forgotten_and_late_ones_left_out(spark, tmp_path):
    def feed(*rows):
        spark.createDataFrame([("d", 1, s, e, t, BEGIN + timedelta(hours=h)) for s, e, t, h in rows], stream.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        read = spark.readStream.schema(stream.EVENT).parquet(f"{tmp_path}/in")
        stream.kept(stream.page_states(read), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(180)
        return tuple(stream.latest(spark.read.parquet(f"{tmp_path}/out")).head())

    assert feed((2, "accept", "b", 2)) == ("d", 1, "b", True, False, 2)
    assert feed((1, "blank", None, 1.5)) == ("d", 1, "b", True, False, 2)  # in time, but before the other
    assert feed((9, "rotate", None, 9)) == ("d", 1, "b", False, False, 9)
    assert feed((3, "accept", "too late", 3)) == ("d", 1, "b", False, False, 9)
    assert feed((10, "accept", "c", 10), (10, "accept", "c", 10)) == ("d", 1, "c", True, False, 10)

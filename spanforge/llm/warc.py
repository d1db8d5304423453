"""WARC archives: a writer with revisit records and a salvage reader.

The writer gives every row a WARC/1.1 record: `response` with the payload, or `revisit` (identical-payload-digest
profile: HTTP headers only) where an equal payload of at least `least` bytes stands in a record of smaller id. Each
record is a gzip member of its own; Spark's text writer puts the members into archive files (through its commit
protocol, so a lost executor leaves no half file) and separates them with an empty gzip member.

The salvage reader checks magic, deflate stream, CRC, version line, headers, Content-Length, the end of the block
and the payload digest. After a failed check it searches for the next gzip member (or, in plain archives, the next
version line) that passes, goes on there, and logs the bytes between as a quarantined gap with the reason. Nothing
in a gap is returned as a record; every byte of an archive lies in a record, a separator or a gap.

Members are inflated in pieces, so they may be of any size and hold any number of records. After a record in a member that
fails, the search goes on at the next version line of what was inflated; such a gap has the member's start and stop, and
inner_start and inner_stop say where it lies in the inflated bytes (as they do for every record of a member). If the stream
itself breaks, the complete records before the break count if it was cut off; if it is damaged (deflate, CRC), those count
whose own digest is right, and the rest is a gap. A member without any sound record is one gap, and so is a broken one that
is a single record: the member's checks are the record's own there.

Defined cases: null payload: empty payload. Null id: after all others; such rows get no revisits pointing at them
unless all ids of their payload are null, then all are responses. Rows with the smallest id of their payload are all
responses, also if repeated. Null url: no target URI. Control characters in urls are percent-encoded. Empty table: no
archives, no records. Columns beyond id, url and payload are ignored.

Scale: one shuffle of payloads by digest (a hot digest is split by the adaptive skew join, since its other side is one
row); archives hold at most RECORDS records of one task, and the reader holds one archive and one record at a time.
Spark's binary type holds less than 2 GB: larger payloads and archive files cannot be rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import common

#: A fixed date: the same rows give the same archives.
DATE = "2024-01-01T00:00:00Z"
RECORDS = 2000
#: Bytes of a member that go into or come out of the inflater at a time, and those that are kept while its end is looked for.
FEED = 1 << 16
PIECE = 1 << 20
KEEP = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-row:"
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000030300000000000000 0000".replace(" ", ""))
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
END = re.compile(rb"\r?\n\r?\n")
SCHEMA = (
    "archive string, start long, stop long, kind string, reason string, record_id string, record_type string, target_uri string, "
    "refers_to string, payload_digest string, payload_bytes long, payload binary, inner_start long, inner_stop long"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes) -> bytes:
    """data as one gzip member without time or name."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(row_id: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response record, or a revisit if refers_to names the row whose payload is equal."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID}{row_id}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bad(Exception):
    """A check that failed; need: with bytes up to there, if they exist, it could pass."""

    def __init__(self, reason: str, need: int = 0):
        super().__init__(reason)
        self.need = need


def parse(data: bytes | bytearray, at: int = 0) -> tuple[dict, int]:
    """The record at a place of uncompressed bytes and where it ends; Bad if a check fails. proved: a digest was checked."""
    if not (m := VERSION.match(data, at)):
        raise Bad("version", at + 10)
    if not (e := END.search(data, m.end() - 1)):
        raise Bad("headers", 2 * len(data))
    head = {}
    for line in data[m.end() : e.start()].splitlines():
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("headers")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = head.get("content-length", "")
    if not length.isdigit():
        raise Bad("length")
    stop = e.end() + int(length)
    if len(data) < stop:
        raise Bad("truncated", stop)
    block = bytes(data[e.end() : stop])
    if not (end := END.match(data, stop)):
        raise Bad("end", stop + 4)
    if (want := head.get("warc-block-digest", "")).startswith("sha1:") and want[5:] != digest(block):
        raise Bad("block digest")
    kind, want = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha1:")
    out = {"record_type": kind, "record_id": head.get("warc-record-id", "").strip("<>"), "target_uri": head.get("warc-target-uri"), "payload": None,
           "refers_to": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None, "payload_digest": want or None, "payload_bytes": None,
           "proved": head.get("warc-block-digest", "").startswith("sha1:")}
    if head.get("content-type", "").startswith("application/http") and (h := END.search(block)):
        n = re.search(rb"(?im)^content-length:[ \t]*(\d+)", block[: h.start()])
        if kind == "revisit":
            out["payload_bytes"] = int(n[1]) if n else None
        else:
            payload = block[h.end() :]
            if n and int(n[1]) != len(payload):
                raise Bad("payload length")
            if want and want != digest(payload):
                raise Bad("payload digest")
            out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest(payload), "proved": out["proved"] or bool(want)}
    return out, end.end()


class Member:
    """The gzip member at a place: its size inflated, where it ends, and why it breaks (None: it is whole and its CRC right)."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.stop, self.reason = data, at, None, None
        self._start()
        kept, self.size = bytearray(), 0
        while out := self._pull():
            self.size += len(out)
            if self.size <= KEEP:
                kept += out
        if self.size <= KEEP:
            self.held = kept
        else:
            self._start()

    def _start(self) -> None:
        self.z, self.fed, self.tail, self.over = zlib.decompressobj(31), self.at, b"", False
        self.held, self.base = bytearray(), 0  # inflated bytes that are held, and the place of the first

    def _pull(self) -> bytes:
        """The next inflated bytes; none after the last."""
        while not self.over:
            piece = self.tail or self.data[self.fed : self.fed + FEED]
            self.fed += 0 if self.tail else len(piece)
            before = self.z.copy()
            try:
                out = self.z.decompress(piece, PIECE)
            except zlib.error:
                self.over, self.reason = True, "deflate"
                return self._rest(before, piece)
            self.tail = self.z.unconsumed_tail
            if self.z.eof:
                self.over, self.stop = True, self.fed - len(self.z.unused_data)
            elif not piece and not out:
                self.over, self.reason = True, "truncated"
            if out:
                return out
        return b""

    @staticmethod
    def _rest(z, piece: bytes) -> bytes:
        """What can be inflated up to an error: a call that fails returns nothing, so each byte is a call of its own."""
        out = bytearray()
        try:
            for i in range(len(piece)):
                out += z.decompress(piece[i : i + 1])
        except zlib.error:
            pass
        return bytes(out)

    def _upto(self, place: int) -> None:
        while self.base + len(self.held) < place and (out := self._pull()):
            self.held += out

    def record(self, at: int) -> tuple[dict, int]:
        """The record at a place of the inflated bytes and where it ends; what is before it is let go."""
        del self.held[: at - self.base]
        self.base, want = at, at + PIECE
        while True:
            self._upto(want)
            try:
                r, stop = parse(self.held)
                return r, at + stop
            except Bad as e:
                want, have = at + e.need, at + len(self.held)
                if want <= have or have >= self.size or (str(e) == "truncated" and want > self.size):
                    raise

    def version(self, start: int) -> int:
        """The next version line at or after a place of the inflated bytes, or the size."""
        while start < self.size:
            self._upto(start + PIECE)
            if m := VERSION.search(self.held, start - self.base):
                return self.base + m.start()
            end = self.base + len(self.held)
            if end >= self.size:
                break
            start = max(start, end - 9)  # a version line may go on in the next piece
            del self.held[: start - self.base]
            self.base = start
        return self.size

    def walk(self) -> Iterator[dict]:
        """Records and gaps of the inflated bytes in order."""
        at, bad, reason, broken = 0, None, None, self.reason
        while at < self.size:
            try:
                r, stop = self.record(at)
                if broken == "deflate" and not r["proved"]:
                    raise Bad(broken)
            except Bad as e:
                bad, reason = (at, str(e)) if bad is None else (bad, reason)
                at = self.version(at + 1)
                continue
            if bad is not None:
                yield {"kind": "gap", "reason": reason, "inner_start": bad, "inner_stop": at}
                bad = None
            yield r | {"kind": "record", "reason": None, "inner_start": at, "inner_stop": stop}
            at = stop
        if bad is not None or broken:
            yield {"kind": "gap", "reason": broken or reason, "inner_start": at if bad is None else bad, "inner_stop": at}


def _zipped(data: bytes, at: int, after) -> Iterator[dict]:
    """Records and gaps of the member at a place; where it ends, or after() if it breaks, is their stop."""
    member = Member(data, at)
    stop = after() if member.reason else member.stop
    place, early, reason = {"start": at, "stop": stop}, [], member.reason
    events = member.walk()
    for event in events:
        if event["kind"] == "record" and not (member.reason and event["inner_stop"] - event["inner_start"] == member.size):
            yield from [x | place for x in (*early, event)]
            yield from (x | place for x in events)
            return
        early.append(event)
    if early or reason:
        yield {"kind": "gap", "reason": reason or early[0]["reason"]} | place
    elif not member.size:
        yield {"kind": "separator"} | place


def _plain(data: bytes, at: int, after) -> Iterator[dict]:
    try:
        r, stop = parse(data, at)
        yield r | {"kind": "record", "start": at, "stop": stop, "reason": None}
    except Bad as e:
        yield {"kind": "gap", "start": at, "stop": after(), "reason": str(e)}


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of an archive in order; gaps have kind 'gap' and the check that failed first."""
    at, n = 0, len(data)
    zipped = data.startswith(MAGIC) or (MAGIC in data and not VERSION.search(data))
    read = _zipped if zipped else _plain

    def candidates(start: int) -> Iterator[int]:
        while True:
            if zipped:
                p = data.find(MAGIC, start)
            else:
                m = VERSION.search(data, start)
                p = m.start() if m else -1
            if p < 0:
                return
            yield p
            start = p + 1

    def after() -> int:
        """The next place behind `at` with a sound record or a separator."""
        return next((p for p in candidates(at + 1) if any(x["kind"] != "gap" for x in read(data, p, lambda: n))), n)

    while at < n:
        stop = n
        for r in read(data, at, after):
            stop = r["stop"]
            if r["kind"] != "separator":
                yield r
        at = stop


def write(rows: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> None:
    """Archives of one record for each row."""
    spark = rows.sparkSession
    all_rows = rows.select(
        F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload")
    ).withColumn("sha", F.sha1("payload"))
    first = all_rows.groupBy(F.col("sha").alias("first_sha")).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = all_rows.join(first, F.col("sha") == F.col("first_sha"), "left")
    refers = F.when((F.octet_length("payload") >= least) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))

    def members(batches):
        for pdf in batches:
            out = [member(record(i, u, bytes(p), r)) for i, u, p, r in zip(pdf["id"], pdf["url"], pdf["payload"], pdf["refers"])]
            yield pd.DataFrame({"member": out})

    made = joined.select(F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("id"), "url", "payload", refers.cast("string").alias("refers")).mapInPandas(members, "member binary")
    (
        made.select(F.col("member").cast("string"))  # bytes as they are: the text writer copies them unchanged
        .write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", RECORDS).text(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records and quarantined gaps of all archives of a folder; see SCHEMA."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches):
        for pdf in batches:
            for archive, data in zip(pdf["path"], pdf["content"]):
                held, size = [], 0
                for r in salvage(bytes(data)):
                    held.append(r | {"archive": archive})
                    size += len(r.get("payload") or b"")
                    if size > common.SLICE_BYTES:
                        yield pd.DataFrame(held, columns=names)
                        held, size = [], 0
                yield pd.DataFrame(held, columns=names)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInPandas(run, SCHEMA)


def quarantine(read_back: DataFrame) -> DataFrame:
    """The log of byte gaps."""
    return read_back.where("kind = 'gap'").select("archive", "start", "stop", (F.col("stop") - F.col("start")).alias("n_bytes"), "reason")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "warc")
    write(common.table(spark, sf_dir, "pages"), path)
    row = lambda c: F.expr(f"try_cast(substring({c}, {len(ID) + 1}) as bigint)")
    return read(spark, path).where("kind = 'record'").select(
        row("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", row("refers_to").alias("refers_to")
    )


ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
h as (select page_id, strlen(html)::bigint as payload_bytes, upper(sha1(html)) as s from p),
d as (
  select *, array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
      lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, (i * 5 + 1)::int, 5))::bigint >> k) % 32 + 1)::int, 1)), '')), '') as payload_digest,
    min(page_id) over (partition by s, payload_bytes) as first
  from h)
select page_id, payload_bytes, payload_digest, case when page_id is distinct from first and first is not null then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from first then first end as refers_to
from d
"""

import gzip
import hashlib
import os

import pytest

from spanforge.llm import common, warc


def build(n=6, zipped=True):
    parts = [warc.record(str(i), f"http://x/{i}", f"payload {i} ".encode() * 50, None) for i in range(n)]
    return [warc.member(p) for p in parts] if zipped else parts


def ids(found):
    return [r["record_id"].removeprefix(warc.ID) for r in found if r["kind"] == "record"]


def covered(found, n):
    at = 0
    for r in found:
        assert r["start"] == at
        at = r["stop"]
    assert at == n


@pytest.mark.parametrize("zipped", [True, False])
def test_clean_archive_has_no_gaps(zipped):
    data = b"".join(build(zipped=zipped))
    found = list(warc.salvage(data))
    assert ids(found) == list("012345") and all(r["kind"] == "record" for r in found)
    covered(found, len(data))


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("where", range(6))
def test_flipped_byte_loses_one_record(zipped, where):
    parts = build(zipped=zipped)
    bad = bytearray(parts[where])
    bad[len(bad) // 2] ^= 0xFF
    before = sum(map(len, parts[:where]))
    parts[where] = bytes(bad)
    data = b"".join(parts)
    found = list(warc.salvage(data))
    assert ids(found) == [str(i) for i in range(6) if i != where]
    gaps = [(r["start"], r["stop"]) for r in found if r["kind"] == "gap"]
    assert gaps == [(before, before + len(bad))]
    covered(found, len(data))


@pytest.mark.parametrize("zipped", [True, False])
def test_truncated_record_does_not_swallow_the_next(zipped):
    parts = build(zipped=zipped)
    parts[2] = parts[2][: len(parts[2]) * 2 // 3]
    data = b"junk" + b"".join(parts)[:-5]
    found = list(warc.salvage(data))
    assert ids(found) == ["0", "1", "3", "4"]
    assert [r["kind"] for r in found].count("gap") == 3
    covered(found, len(data))


def test_digest_is_checked():
    data = warc.record("1", None, b"abcdef", None).replace(b"abcdef", b"abcdeF")
    (gap,) = warc.salvage(data)
    assert gap["kind"] == "gap" and gap["reason"] == "block digest"


def test_members_join_to_an_ordinary_gzip_file():
    assert gzip.decompress(b"".join(build()) + warc.EMPTY_MEMBER).count(b"WARC/1.1\r\n") == 6
    assert list(warc.salvage(b"")) == []


def test_files_and_quarantine_log(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"http://h/{i}", "same" if i % 3 == 0 else f"p{i}") for i in range(50)], "page_id long, url string, html string")
    path = f"{tmp_path}/warc"
    warc.write(rows.repartition(2), path)
    (name,) = [p for p in (tmp_path / "warc").glob("part-*")][:1]
    data = bytearray(name.read_bytes())
    data[len(data) // 2] ^= 0x55
    name.write_bytes(bytes(data))
    (tmp_path / "warc" / f".{name.name}.crc").unlink(missing_ok=True)
    back = warc.read(spark, path).cache()
    log = warc.quarantine(back).collect()
    assert len(log) == 1 and log[0]["n_bytes"] > 0
    assert back.where("kind = 'record'").count() == 49
    revisits = {r["record_id"]: r["refers_to"] for r in back.where("record_type = 'revisit'").collect()}
    assert set(revisits.values()) == {warc.ID + "0"}


def test_threshold_keeps_small_payloads(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    warc.write(rows, f"{tmp_path}/w", least=4)
    kinds = {r["record_id"]: r["record_type"] for r in warc.read(spark, f"{tmp_path}/w").collect()}
    assert kinds == {warc.ID + "1": "response", warc.ID + "2": "response", warc.ID + "3": "response", warc.ID + "4": "revisit"}
    assert common.LOCAL_CHECKPOINTS


@pytest.mark.parametrize("where", range(6))
def test_failed_record_inside_a_member_costs_only_itself(where):
    parts = build(zipped=False)
    parts[where] = parts[where].replace(f"payload {where}".encode(), b"payload X", 1)
    data = warc.member(b"".join(build(2, zipped=False))) + warc.member(b"".join(parts))
    found = list(warc.salvage(data))
    assert ids(found) == ["0", "1"] + [str(i) for i in range(6) if i != where]
    before = sum(map(len, parts[:where]))
    assert [(r["inner_start"], r["inner_stop"], r["reason"]) for r in found if r["kind"] == "gap"] == [(before, before + len(parts[where]), "block digest")]
    assert found[-1]["stop"] == len(data)


def test_broken_member_keeps_the_records_that_are_sound():
    noise = [hashlib.sha512(str(i).encode()).hexdigest().encode() * 40 + os.urandom(3000) for i in range(6)]
    parts = [warc.record(str(i), None, p, None) for i, p in enumerate(noise)]
    whole, last = warc.member(b"".join(parts)), warc.member(parts[0])
    cut = list(warc.salvage(whole[:-2000] + last))
    assert ids(cut) == ["0", "1", "2", "3", "4", "0"] and [r["kind"] for r in cut].count("gap") == 1
    crc = bytearray(whole)
    crc[-8] ^= 1
    found = list(warc.salvage(bytes(crc) + last))
    assert ids(found) == [*"012345", "0"] and [r["reason"] for r in found if r["kind"] == "gap"] == ["deflate"]
    assert found[0]["stop"] == found[-1]["start"] == len(whole)
    plain = b"WARC/1.0\r\nWARC-Record-ID: <urn:x-row:9>\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    bad = bytearray(warc.member(plain + parts[0]))
    bad[-8] ^= 1
    assert ids(warc.salvage(bytes(bad))) == ["0"]  # without a digest nothing proves a record of a damaged stream


def test_members_beyond_256_mb():
    big = bytes(1 << 20) * 260
    parts = [warc.record("1", None, b"a", None), warc.record("2", None, big, None), warc.record("3", None, b"b", None)]
    data = warc.member(b"".join(parts))
    found = [(r["record_id"][-1], r["payload_bytes"], r["stop"]) for r in warc.salvage(data)]
    assert found == [("1", 1, len(data)), ("2", len(big), len(data)), ("3", 1, len(data))]

import struct

import pytest
import zstandard

from hirelake.llm import warc
from hirelake.session import Scratch, shared_path


def round_trip(spark, rows, schema="page_id long, url string, html string", **options):
    path, scratch = shared_path(spark, "warc"), Scratch(spark, "t")
    warc.write_archives(spark.createDataFrame(rows, schema), path, scratch, **options)
    scratch.drop()
    return warc.read_archives(spark, path)


def brute(rows, least=0):
    found = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        ids = [i for i, _, h in rows if (h or "") == (html or "") and i is not None]
        first = min(ids, default=None)
        revisit = len(body) >= least and first is not None and first != page_id
        found.append((page_id, len(body), warc.digest(body), "revisit" if revisit else "response",
                      first if revisit else None))
    return sorted(found, key=repr)


ROWS = [(5, "http://a/é b\r\nX: y", "<p>ü</p>\r\n\r\nWARC/1.1"), (3, None, "<p>ü</p>\r\n\r\nWARC/1.1"), (9, "u", None),
        (8, "u", ""), (None, "u", ""), (7, "u", "x" * 300_000), (7, "u", "x" * 300_000), (6, "u", "x" * 300_000),
        (None, "v", "alone"), (None, "v", "alone"), (11, "w", "P*M\x18\x00\x00\x00\x00 \n")]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip_equals_brute_force(spark, least):
    found = round_trip(spark, ROWS, least_bytes=least, archive_bytes=1000).collect()
    told = sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
                   for r in found), key=repr)
    assert told == brute(ROWS, least)
    bodies = {(r["page_id"], bytes(r["payload"])) for r in found if r["record_type"] == "response"}
    assert all((i, (h or "").encode()) in bodies for (i, _, h), kind in
               zip(ROWS, [t[3] for t in (brute([r])[0] for r in ROWS)], strict=True)
               if kind == "response" and not any((h or "") == (o or "") and r != i for r, _, o in ROWS))
    assert any(r["url"] == "http://a/%C3%A9%20b%0D%0AX:%20y" for r in found)


def test_many_pages_in_few_archives(spark):
    rows = [(i, f"http://x/{i}", f"<html><body>{'lorem ipsum ' * (i % 9)}{i % 50}</body></html>") for i in range(400)]
    found = round_trip(spark, rows).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                   for r in found), key=repr) == brute(rows)


def test_empty_table_and_other_columns(spark):
    assert round_trip(spark, []).collect() == []
    found = round_trip(spark, [(1, "u", "b", "k", 2)], "page_id long, url string, html string, key string, first int")
    assert found.first()["payload"] == b"b"


def test_dictionary_frame_may_be_compressed_and_frames_skipped():
    dictionary = warc.train([b"<html><head>%d</head>" % (i % 7) * 5 for i in range(500)])
    record = warc.record(1, "u", b"body", False, None)
    whole = warc.archive([record, record], dictionary)
    packed = zstandard.ZstdCompressor().compress(dictionary)
    frames = whole[8 + len(dictionary):]
    other = struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + warc.EMPTY_FRAME.encode() + frames
    assert [d for _, d in warc.frames(whole)] == [d for _, d in warc.frames(other)] == [record, record]


def test_faults_are_told():
    record = warc.record(1, "u", b"body", False, None)
    whole = warc.archive([record], b"")
    for bad in (b"", whole[8:], whole[:-3], whole + b"xx", whole[:20] + bytes([whole[20] ^ 255]) + whole[21:]):
        with pytest.raises(warc.ArchiveError):
            list(warc.frames(bad))
    for old, new in ((b"WARC/1.1", b"WARC/9.1"), (b"WARC-Type: response", b"WARC-Type: other"), (b"body", b"bodx"),
                     (b"Content-Length: 4", b"Content-Length: 5"), (b"WARC-Date: ", b"WARC-Day: "),
                     (b"Content-Type: application", b"Content-Type application"), (b"\r\n\r\nHTTP", b"\r\n\r\nXTTP")):
        with pytest.raises(warc.ArchiveError):
            warc.parse(record.replace(old, new), "r")
    revisit = warc.record(2, "u", b"body", True, 1)
    assert warc.parse(revisit, "r")["refers_to"] == 1
    with pytest.raises(warc.ArchiveError):
        warc.parse(revisit.replace(b"identical", b"other"), "r")


def test_damaged_file_stops_reading(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(warc.archive([warc.record(1, "u", b"b", False, None)], b"")[:-2])
    with pytest.raises(Exception, match="a.txt.*cut short"):
        warc.read_archives(spark, str(tmp_path)).collect()

"""Seekable bundles: written, read by seeking, and read from end to end."""

from __future__ import annotations

import base64
import hashlib
import io

import pytest
import zstandard

from docsieve.llm.common import shared_folder
from docsieve.llm.warc import parse_record, read_bundles, read_seek_table, record_bytes, seek_table, write_bundles


def expected(rows, least):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        first = min(same, default=None)
        revisit = len(data) >= least and page is not None and page > first
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,frame,bundle", [(0, 1 << 20, 1 << 28), (3, 200, 900)])
def test_round_trip(spark, least, frame, bundle):
    rows = [(i, f"http://a.org/{i}", "<p>é %d</p>" % (i % 9)) for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (102, "x\r\ny z", None), (None, "u", "<p>é 1</p>"), (None, "u", None), (7, "again", "<p>é 7</p>"), (200, "u", "\r\n\r\n"), (201, "u", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "s") for r in rows], "page_id long, url string, html string, sha string").repartition(3)
    index = write_bundles(pages, shared_folder(spark, "warc-test"), least=least, frame=frame, bundle=bundle)
    got = read_bundles(index).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == expected(rows, least)
    held = {r["page_id"]: bytes(r["payload"]) for r in got if r["record_type"] == "response" and r["page_id"] is not None}
    assert all(held[p] == (h or "").encode() for p, _, h in rows if p in held)
    assert len({r["record_id"] for r in got}) == len(rows)

    entries = index.collect()
    for name in {r["bundle"] for r in entries}:
        data = open(name.removeprefix("file://").removeprefix("file:"), "rb").read()
        frames = read_seek_table(data)
        mine = {(r["frame"], r["frame_start"], r["frame_bytes"]) for r in entries if r["bundle"] == name}
        starts = [sum(f[0] for f in frames[:i]) for i in range(len(frames))]
        assert mine == {(i, starts[i], frames[i][0]) for i in range(len(frames))}
        # any zstd reader that knows nothing of the table reads the whole bundle
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data[: sum(f[0] for f in frames)]), read_across_frames=True).read()
        assert len(whole) == sum(f[1] for f in frames) and whole.startswith(b"WARC/1.1\r\n")


def test_part_of_an_index_and_empty_table(spark):
    pages = spark.createDataFrame([(i, "u", "t%d" % i) for i in range(20)], "page_id long, url string, html string")
    index = write_bundles(pages, shared_folder(spark, "warc-test"), frame=100)
    assert [bytes(r["payload"]) for r in read_bundles(index.where("page_id = 7")).collect()] == [b"t7"]
    empty = write_bundles(pages.where("false"), shared_folder(spark, "warc-test"))
    assert empty.count() == 0 and read_bundles(empty).count() == 0


def test_record_and_table_forms():
    record = record_bytes("urn:uuid:1", "revisit", "http://a/", b"body", "D", 4, 2)
    fields, size, payload = parse_record(record)
    assert (fields["WARC-Type"], fields["X-Refers-To-Page-ID"], size, payload) == ("revisit", "2", 4, b"")
    assert read_seek_table(b"junk" + seek_table([(5, 9), (6, 7)])) == [(5, 9), (6, 7)]
    with pytest.raises(ValueError):
        parse_record(b"HTTP/1.1 200 OK\r\n\r\n")

import base64
import hashlib
import os
import struct

import pytest
import zstandard

from tensorloom.llm import warc as W
from tensorloom.llm.common import new_folder

SCHEMA = "page_id long, url string, html string"


def sha(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def expected(rows):
    largest = {}
    for i, _, h in rows:
        h = h or ""
        largest[h] = max([x for x in (largest.get(h), i) if x is not None], default=None)
    return sorted(((i, len((h or "").encode()), sha(h or ""), "response" if i == largest[h or ""] else "revisit", None if i == largest[h or ""] else largest[h or ""]) for i, _, h in rows), key=str)


def read(spark, folder, **options):
    return W.read_archives(spark, folder, **options).collect()


def test_round_trip(spark):
    rows = [(i, f"http://x/{i}", "<p>same</p>" if i % 3 == 0 else f"<p>{'é' * i}</p>") for i in range(60)]
    rows += [(100, None, None), (101, "http://y\r\n\x00 z", ""), (102, "u", "\r\n\r\n WARC/1.1"), (103, "u", "big " * 200_000), (5, "again", rows[5][2])]
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS sha", "'x' AS payload", "3 AS largest").repartition(3)
    folder = new_folder(spark, "warc")
    archives, records = W.write_archives(d, folder)
    got = read(spark, folder)
    assert records == len(rows) and archives >= 1
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    texts = {i: h for i, _, h in rows}
    assert all(bytes(r.payload).decode() == (texts[r.page_id] or "") for r in got if r.record_type == "response")
    assert all(r.payload is None for r in got if r.record_type == "revisit")
    assert all(r.payload is None for r in read(spark, folder, payloads=False))


def test_least_size_of_revisits(spark):
    folder = new_folder(spark, "warc")
    W.write_archives(spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "xxxx"), (4, "d", "xxxx")], SCHEMA), folder, least=4)
    assert {r.page_id: r.record_type for r in read(spark, folder)} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_null_ids_and_empty_tables(spark):
    folder = new_folder(spark, "warc")
    W.write_archives(spark.createDataFrame([(None, "a", "q"), (None, "a", "r"), (3, "b", "r")], SCHEMA), folder)
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in read(spark, folder)), key=str) == sorted([(None, "response", None), (None, "revisit", 3), (3, "response", None)], key=str)
    folder = new_folder(spark, "warc")
    assert W.write_archives(spark.createDataFrame([], SCHEMA), folder) == (0, 0)
    assert read(spark, folder) == []


def archive(tmp_path, content, name="a.warc.zst"):
    folder = tmp_path / name.replace(".", "_")
    os.makedirs(folder)
    (folder / name).write_bytes(content)
    return f"file://{folder}"


def frame(raw, dictionary=None):
    return zstandard.ZstdCompressor(dict_data=dictionary).compress(raw)


RAW = W.record(1, "http://x", b"hello", None)


def test_dictionaries(spark, tmp_path):
    records = [W.record(i, f"http://x/{i}", f"<html><p>{i * 7919}</p> some text {i}</html>".encode(), None) for i in range(400)]
    d = W.train(records)
    assert d is not None
    raw = d.as_bytes()
    body = b"".join(frame(x, d) for x in records[:3])
    for i, stored in enumerate((raw, frame(raw))):  # plain, and compressed itself
        content = struct.pack("<II", W.DICTIONARY_MAGIC, len(stored)) + stored + struct.pack("<II", 0x184D2A50, 3) + b"abc" + body
        assert len(read(spark, archive(tmp_path, content, f"d{i}.warc.zst"))) == 3
    with pytest.raises(Exception, match="can't be decoded"):
        read(spark, archive(tmp_path, body, "none.warc.zst"))


def test_streamed_frames_without_size(spark, tmp_path):
    c = zstandard.ZstdCompressor(write_checksum=True).compressobj()
    content = c.compress(RAW) + c.flush()
    assert [r.page_id for r in read(spark, archive(tmp_path, content + content))] == [1, 1]


@pytest.mark.parametrize(
    "raw,text",
    [
        (RAW[:-2], "Content-Length"),
        (RAW.replace(b"hello", b"hellO"), "digest"),
        (RAW.replace(b"WARC/1.1", b"WARC/9"), "version"),
        (RAW.replace(b"WARC-Date", b"WARC-Dat"), "without"),
        (RAW.replace(b"urn:page:1", b"urn:other"), "record's id"),
        (RAW.replace(b"WARC-Type: response", b"WARC-Type: metadata"), "metadata"),
        (RAW.replace(b"HTTP/1.1 200 OK", b"HTXP/1.1 200 OK"), "HTTP"),
        (RAW.replace(b"WARC-Type: response", b"WARC-Type response"), "header line"),
        (b"", "version"),
    ],
)
def test_invalid_records(spark, tmp_path, raw, text):
    folder = archive(tmp_path, frame(raw) + frame(RAW))
    with pytest.raises(Exception, match=text):
        read(spark, folder)
    got = read(spark, folder, strict=False)
    assert [r.error is None for r in got] == [False, True] and text in got[0].error


def test_broken_archives(spark, tmp_path):
    whole = frame(RAW)
    for i, content in enumerate((whole[:-3], b"12345678" + whole, whole + b"\x00", struct.pack("<II", W.DICTIONARY_MAGIC, 99) + b"x")):
        folder = archive(tmp_path, content, f"b{i}.warc.zst")
        with pytest.raises(Exception, match="cut off|no frame"):
            read(spark, folder)
        assert read(spark, folder, strict=False)[-1].error


def test_query_against_brute_force(spark):
    from tensorloom.llm.queries import queries, table

    d = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in table(spark, d, "pages").collect()]
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries()["op4_warc_zstd"](spark, d).collect()), key=str)
    assert got == expected(rows)

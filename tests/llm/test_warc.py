import struct
from hashlib import sha256

import pytest
import zstandard

from plumbline.llm import warc

SF = "/root/testdata/sf0.001"


def test_query_matches_sql(same_as_sql):
    assert same_as_sql("op2_warc_zstd", SF) > 0


def test_round_trip_of_odd_pages(spark, tmp_path):
    big = "<p>" + "grün 漢字 \n\r\n\r\n" * 40000
    rows = [(1, "http://a/\r\nX: y", big, 0), (2, None, None, 0), (3, "u", "", 0), (4, "u", "short", 0), (5, "u", "short", 0)]
    rows += [(9, "u", "L" * 100, 0), (7, "u", "L" * 100, 0), (None, "u", "L" * 100, 0), (7, "u", "L" * 100, 0), (None, "u", "M" * 200, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    out = warc.round_trip(df.repartition(3)).collect()
    got = sorted((r.record_id, r.record_type, r.refers_to or "", r.payload_bytes, r.payload_digest) for r in out)
    want = []
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        again = html == "L" * 100 and i != 7
        want.append((f"urn:page:{'' if i is None else i}", "revisit" if again else "response", "urn:page:7" if again else "", len(raw), sha256(raw).hexdigest()))
    assert got == sorted(want)
    assert all(r.payload.decode() == (h or "") for r in out if r.record_type == "response" for i, _, h, _ in rows if f"urn:page:{i}" == r.record_id)
    assert [r.target_uri for r in out if r.record_id == "urn:page:1"] == ["http://a/%0D%0AX: y"]
    assert warc.round_trip(df.limit(0)).count() == 0


def test_files_are_plain_archives(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    words = warc.train_dictionary(pages)
    warc.archive_pages(pages, f"file://{tmp_path}/a")
    files = [p.read_bytes() for p in (tmp_path / "a").glob("part-*")]
    assert len(words) > 1000 and files
    for data in files:
        magic, size = struct.unpack_from("<II", data)
        assert magic == 0x184D2A5D and data[8 : 8 + size] == words
        plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
        whole = plain.stream_reader(data, read_across_frames=True).read()
        assert whole == b"".join(warc.frames(data)) and whole.startswith(b"WARC/1.1\r\n")


def archive(*records, words=b""):
    return b"".join(zstandard.ZstdCompressor().compress(r) for r in records)


def test_damage_is_found():
    good = warc.record_bytes("response", "urn:x", "u", b"payload", "2024-01-01T00:00:00Z", None)
    assert warc.parse_record(good)["payload"] == b"payload"
    for bad in (
        good.replace(b"WARC/1.1", b"WARC/9.9"),
        good.replace(b"payload\r\n\r\n", b"paxload\r\n\r\n"),
        good[:-2],
        good + b"x",
        good.replace(b"WARC-Date", b"WARC-Dote"),
        good.replace(b"Content-Length: 7", b"Content-Length: 8"),
        b"",
    ):
        with pytest.raises(warc.DamagedArchive):
            warc.parse_record(bad)
    data = archive(good, good)
    assert list(warc.frames(data)) == [good, good] and list(warc.frames(b"")) == []
    for cut in (data[:-1], data[:-20], data + b"abc", b"\x00" * 20, data + struct.pack("<II", 0x184D2A50, 9) + b"1"):
        with pytest.raises(warc.DamagedArchive):
            list(warc.frames(cut))


def test_reader_names_damaged_archives(spark, tmp_path):
    good = warc.record_bytes("response", "urn:x", "u", b"payload", "2024-01-01T00:00:00Z", None)
    (tmp_path / "a.warc.zst").write_bytes(archive(good) + b"junk junk")
    (tmp_path / "b.warc.zst").write_bytes(archive(good))
    rows = warc.read_archives(spark, str(tmp_path), strict=False).collect()
    assert sorted(r.record_id or "" for r in rows) == ["", "urn:x", "urn:x"]
    assert "a.warc.zst" in next(r.error for r in rows if r.error)
    with pytest.raises(Exception, match="a.warc.zst"):
        warc.read_archives(spark, str(tmp_path)).collect()


def test_archives_are_closed_at_their_size(spark, tmp_path):
    rows = [(f"urn:{i}", "u", sha256(bytes([i % 256, i // 256])).digest() * 40, None) for i in range(300)]
    shape = "record_id string, uri string, payload binary, refers_to string"
    words = warc.train_dictionary(spark.read.parquet(f"{SF}/pages.parquet"))
    df = spark.createDataFrame(rows, shape).coalesce(1)
    warc.write_archives(df, f"file://{tmp_path}/a", words, archive_bytes=4000)
    files = list((tmp_path / "a").glob("part-*"))
    assert len(files) > 5 and max(p.stat().st_size for p in files) < len(words) + 3 * 4000
    got = warc.read_archives(spark, f"file://{tmp_path}/a").select("record_id", "payload").collect()
    assert sorted((r.record_id, bytes(r.payload)) for r in got) == sorted((r[0], r[2]) for r in rows)


def test_reading_goes_on_behind_damage(spark, tmp_path):
    rows = [(f"urn:{i}", "u", sha256(bytes([i])).digest() * 40, None) for i in range(100)]
    df = spark.createDataFrame(rows, "record_id string, uri string, payload binary, refers_to string").coalesce(1)
    warc.write_archives(df, f"file://{tmp_path}/a")
    (file,) = (tmp_path / "a").glob("part-*")
    data = bytearray(file.read_bytes())
    data[len(data) // 2] ^= 0xFF
    (tmp_path / "b.warc.zst").write_bytes(data)
    found = warc.read_archives(spark, f"file://{tmp_path}/b.warc.zst", strict=False).collect()
    assert len([r for r in found if r.error is None]) == 99 and len([r for r in found if r.error]) == 1
    with pytest.raises(Exception, match="b.warc.zst"):
        warc.read_archives(spark, f"file://{tmp_path}/b.warc.zst").collect()


def test_compressed_dictionary():
    words = zstandard.train_dictionary(4096, [b"sample %d of many words" % i * 20 for i in range(200)])
    frame = zstandard.ZstdCompressor().compress(words.as_bytes())
    body = zstandard.ZstdCompressor(dict_data=words).compress(b"hello")
    assert list(warc.frames(struct.pack("<II", 0x184D2A5D, len(frame)) + frame + body)) == [b"hello"]

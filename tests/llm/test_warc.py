import hashlib
import io
import struct
from collections import defaultdict

import pytest

from runlens.llm.warc import SKIPPABLE, ArchiveWriter, filesystem, make_record, read_archive, read_archives, train_dictionary, write_archives

from .helpers import SF


def brute(pages):
    groups = defaultdict(list)
    for p, h in pages.items():
        groups[h or ""].append(p)
    out = {}
    for h, ids in groups.items():
        raw = h.encode()
        for p in ids:
            again = len(raw) >= 1000 and p != max(ids)
            out[p] = (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", max(ids) if again else None)
    return out


def rows(df):
    got = df.collect()
    assert all(r.whole for r in got)
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got}


def test_table_and_awkward_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert rows(read_archives(write_archives(pages))) == brute({r.page_id: r.html for r in pages.collect()})
    big, small = "é" * 500, "é" * 499
    html = [None, "", big, big, small, small, big, "x" * 400_000, "a\r\n\r\nb" * 300, "a\r\n\r\nb" * 300]
    data = [(i, None if i % 3 else f"http://h/{i} a\r\nb", h, "clash") for i, h in enumerate(html)]
    frame = spark.createDataFrame(data, "page_id long, url string, html string, digest string")
    for options in ({}, {"max_broadcast_groups": 0, "max_archive_bytes": 1}):
        manifest = write_archives(frame, **options)
        assert rows(read_archives(manifest)) == brute(dict(enumerate(html)))
    assert manifest.count() == len(html)
    assert read_archives(write_archives(frame.limit(0))).count() == 0
    nulls = spark.createDataFrame([(None, None, big), (None, None, "q"), (7, None, big)], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in read_archives(write_archives(nulls)).collect())
    assert got == [("7", "response", None), ("None", "response", None), ("None", "revisit", 7)]


def test_files_begin_with_the_dictionary_frame(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    row = write_archives(pages).first()
    fs, path = filesystem(row.path)
    data = fs.open_input_stream(path).read()
    magic, length = struct.unpack("<II", data[:8])
    assert magic == SKIPPABLE and len(data) == row.n_bytes and length < len(data)
    assert data[8 + length : 12 + length] == b"\x28\xb5\x2f\xfd"  # each record is a Zstandard frame


def test_record_round_trip_and_damage():
    records = [make_record(f"urn:uuid:{i}", i, f"http://a/{i}", b"payload %d" % i * 50, "00" * 20, "2024-01-01T00:00:00Z") for i in range(300)]
    sink = io.BytesIO()
    writer = ArchiveWriter(sink, train_dictionary(records))
    for r in records:
        writer.add(r)
    data = sink.getvalue()
    assert len(data) < sum(map(len, records)) / 2
    got = list(read_archive(io.BytesIO(data), step=7))
    assert [h["WARC-Record-ID"] for h, _ in got] == [f"<urn:uuid:{i}>" for i in range(300)]
    assert got[5][1].endswith(b"payload 5" * 50)
    with pytest.raises(ValueError):
        list(read_archive(io.BytesIO(data[:-3])))


def test_records_have_what_the_format_asks_for(spark):
    big = "y" * 2000
    rows_ = [(1, "http://a/1", big), (2, "http://a/2", big), (3, "http://a/3", "s"), (3, "http://a/3", "s"), (None, None, "t"), (5, "http://a/5", big * 2), (5, "http://a/6", big * 2), (4, None, big * 2)]
    manifest = write_archives(spark.createDataFrame(rows_, "page_id long, url string, html string"))
    records, raw = [], []
    for r in manifest.collect():
        fs, path = filesystem(r.path)
        raw.append(first_record(fs.open_input_stream(path)))
        records += [h for h, _ in read_archive(fs.open_input_stream(path))]
    names = [h["WARC-Record-ID"] for h in raw + records]
    assert len(set(names)) == len(names) and all(n.startswith("<urn:uuid:") for n in names)
    assert all({"WARC-Type", "WARC-Date", "Content-Length"} <= set(h) and h["WARC-Date"] > "2024" for h in raw + records)
    by_page = {h["WARC-Target-URI"]: h for h in records}
    again = next(h for h in records if h["WARC-Type"] == "revisit" and h["Runlens-Page-ID"] == "1")
    assert again["WARC-Refers-To"] == by_page["http://a/2"]["WARC-Record-ID"] and again["WARC-Refers-To-Target-URI"] == "http://a/2"
    unsure = next(h for h in records if h["Runlens-Page-ID"] == "4")
    assert unsure["WARC-Type"] == "revisit" and "WARC-Refers-To" not in unsure and unsure["Runlens-Refers-To-Page-ID"] == "5"


def first_record(source):
    import zstandard

    _, length = struct.unpack("<II", source.read(8))
    dictionary = zstandard.ZstdDecompressor().decompress(source.read(length))
    data = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompressobj().decompress(source.read())
    head = data.partition(b"\r\n\r\n")[0].decode().split("\r\n")
    return dict(line.split(": ", 1) for line in head[1:])

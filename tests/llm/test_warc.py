import base64
import hashlib
import struct

import pytest
import zstandard

from tidemark.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip_with_payloads(spark):
    rows = [(i, f"http://x/{i}", f"<p>{'word ' * (i % 7)}{i % 5}</p>é") for i in range(60)] + [(70, None, None), (71, "http://e\r\nx", ""), (72, "u", "long " * 100_000)]
    df = pages(spark, rows)
    got = {r.page_id: r for r in warc.round_trip(df, with_payload=True).collect()}
    keeper = {}
    for i, _, h in rows:
        keeper[h or ""] = max(i, keeper.get(h or "", -1))
    assert len(got) == len(rows)
    for i, _, h in rows:
        data, r = (h or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        first = keeper[h or ""]
        assert (r.record_type, r.refers_to) == (("response", None) if i == first else ("revisit", first))
        assert r.payload == (data if i == first else None) or (i == first and bytes(r.payload) == data)


def test_archives_roll_and_lead_with_the_dictionary(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    df = pages(spark, [(i, "u", f"<html><body>common words in every page {hashlib.sha256(str(i).encode()).hexdigest()}</body></html>" * 3) for i in range(300)])
    folder = warc.scratch_path(spark, "t")
    manifest = warc.write_archives(df, folder)
    assert manifest.count() > 4 and manifest.agg({"records": "sum"}).first()[0] == 300
    raw = spark.read.format("binaryFile").load(folder).collect()
    assert {r.path.rsplit("/", 1)[1] for r in raw} == {r.file for r in manifest.collect()}
    assert all(struct.unpack_from("<I", r.content)[0] == warc.SKIPPABLE for r in raw)
    assert warc.read_archives(spark, folder, manifest).count() == warc.read_archives(spark, folder).count() == 300


def test_awkward_tables(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0
    rows = warc.round_trip(pages(spark, [(None, None, "x"), (1, None, "x"), (1, None, "x"), (None, None, "y")])).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in rows) == [(0, "response", None), (0, "revisit", 1), (1, "response", None), (1, "response", None)]


def by_hand(kind, ident, block, lower=False, **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{ident}>", "WARC-Date": "2020-01-01T00:00:00Z", "Content-Length": str(len(block)), **{k.replace("_", "-"): v for k, v in more.items()}}
    lines = [f"{k.lower() if lower else k}:{v}" for k, v in head.items()]
    return "\r\n".join(["WARC/1.0", *lines, "", ""]).encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("dictionary", ["none", "plain", "compressed"])
def test_archives_of_others(spark, tmp_path, dictionary):
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\ncontent-length: 5\r\n\r\nhello"
    records = [
        by_hand("warcinfo", "0-0", b"software: x\r\n", Content_Type="application/warc-fields"),
        by_hand("request", "0-1", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", Content_Type="application/http; msgtype=request"),
        by_hand("response", "0-2", http, lower=True, Content_Type="application/http; msgtype=response", WARC_Payload_Digest=sha(b"hello"), WARC_Block_Digest="sha1:" + hashlib.sha1(http).hexdigest(), WARC_Target_URI="http://h/\r\n  folded"),
        by_hand("metadata", "0-3", b"a: b"),
        by_hand("resource", "0-4", b"\x00\xff" * 400_000, WARC_Payload_Digest="md5:unchecked"),
        by_hand("revisit", "0-5", b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\n", Content_Type="application/http", WARC_Profile="p", WARC_Refers_To="<urn:uuid:0-2>"),
    ]
    trained = zstandard.train_dictionary(4096, [f"WARC/1.0 WARC-Type: response {i} common words {i * 7}".encode() * 5 for i in range(300)]).as_bytes()
    lead = {"none": b"", "plain": trained, "compressed": zstandard.ZstdCompressor().compress(trained)}[dictionary]
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(trained) if lead else None)
    body = [packer.compress(r) for r in records]
    body.insert(3, struct.pack("<II", warc.ANY_SKIPPABLE + 1, 7) + b"passed!")
    data = (struct.pack("<II", warc.SKIPPABLE, len(lead)) + lead if lead else b"") + b"".join(body)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x.warc.zst").write_bytes(data)
    (tmp_path / "other.txt").write_text("not an archive")
    got = warc.read_archives(spark, f"file://{tmp_path}", with_payload=True).collect()
    assert [r.record_type for r in got] == ["warcinfo", "request", "response", "metadata", "resource", "revisit"]
    assert [r.record_id for r in got] == [f"<urn:uuid:0-{k}>" for k in range(6)] and {r.file for r in got} == {"x.warc.zst"}
    assert bytes(got[2].payload) == b"hello" and got[2].target_uri == "http://h/ folded" and bytes(got[4].payload) == b"\x00\xff" * 400_000
    assert (got[5].payload_bytes, got[5].refers_to, got[5].payload) == (5, "<urn:uuid:0-2>", None)
    pages_ = warc.of_pages(warc.read_archives(spark, f"file://{tmp_path}")).collect()
    assert [(r.record_type, r.page_id) for r in pages_] == [("response", None), ("revisit", None)]
    for cut in (len(data) - 3, 5):
        (tmp_path / "deep" / "x.warc.zst").write_bytes(data[:cut])
        with pytest.raises(Exception, match="x.warc.zst"):
            warc.read_archives(spark, f"file://{tmp_path}").collect()


def test_folder_without_archives(spark, tmp_path):
    assert warc.read_archives(spark, f"file://{tmp_path}").count() == 0


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    df = pages(spark, [(1, "u", "x"), (2, "u", "x")]).withColumns({"digest": F.lit(1), "keeper": F.lit(1), "refers_to": F.lit(9), "n": F.lit(1), "_id": F.lit(3)})
    assert sorted((r.page_id, r.refers_to) for r in warc.round_trip(df).collect()) == [(1, 2), (2, None)]


def test_bad_records_are_refused():
    good = warc.record(1, "u", b"abc", None)
    assert warc.parse(good)["payload"] == b"abc"
    for bad in (good[:-1], good + good, good.replace(b"Content-Length: ", b"Content-Length: x", 1), good.replace(b"WARC-Date: ", b"WARC-Date "), good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"abc", b"abd"), good.replace(b"WARC-Date: ", b"Date: "), good.replace(b"Content-Length: 3", b"Content-Length: 4")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises(ValueError):
        list(warc.frames(struct.pack("<II", warc.SKIPPABLE, 99) + b"x"))

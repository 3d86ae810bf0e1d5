import hashlib
import io
import json
import zlib

from answerscope.llm import warc as W

SCHEMA = "page_id bigint, url string, html string, digest string, size bigint"


def test_cases(spark, tmp_path):
    big, nest = "<p>é</p>" * 200, "WARC/1.1\r\n\r\n" * 100
    rows = [(1, "http://a/", big, "x", 1), (2, "http://b/\r\n\r\n", big, "x", 1), (3, None, "small", "x", 1), (4, "u", "small", "x", 1), (5, "u", None, "x", 1),
            (6, "u", nest, "x", 1), (None, "u", nest, "x", 1), (7, "u", "y" * 3_000_000, "x", 1), (8, "u", "z" * 1000, "x", 1), (8, "u", "z" * 1000, "x", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, W.op5_warc_normalise(spark, str(tmp_path)).collect()), key=str)
    want = []
    for page, _, html, _, _ in rows:
        payload = (html or "").encode()
        to = {1: 2, None: 6}.get(page) if len(payload) >= 1000 else None
        want.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if to else "response", to))
    assert got == sorted(want, key=str)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert W.op5_warc_normalise(spark, str(tmp_path)).count() == 0


def test_normalised_members_and_index(tmp_path):
    payloads = [b"", b"a" * 5, b"\r\n\r\n" * 9, bytes(range(256)) * 9000]
    records = [W.record_bytes(k, f"http://h/{k}", p, hashlib.sha1(p).hexdigest(), "response", None) for k, p in enumerate(payloads)]
    deflate = zlib.compressobj(wbits=31)
    (tmp_path / "one.gz").write_bytes(deflate.compress(b"".join(records)) + deflate.flush())
    assert W.normalise_file(str(tmp_path / "one.gz"), str(tmp_path / "out"), "n") == (str(tmp_path / "out") + "/n", 4)
    data = (tmp_path / "out/n.warc.gz").read_bytes()
    assert list(W.records_of(io.BytesIO(data), 100)) == records  # members are read like one stream
    for entry, record in zip(map(json.loads, (tmp_path / "out/n.index").read_text().splitlines()), records, strict=True):
        assert zlib.decompress(data[entry["offset"]:entry["offset"] + entry["length"]], wbits=31) == record

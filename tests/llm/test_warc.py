import gzip
import hashlib
import zlib

import pytest
from evidentia.llm import warc

ROWS = [
    (1, "http://a/", "x" * 1000), (2, "http://b/", "x" * 1000), (3, None, None), (4, "u\r\nX-Page: 9", ""), (5, "ü", "<p>é</p>\r\n\r\nWARC/1.1"),
    (6, "a", "x" * 999), (7, "a", "x" * 999), (None, "n", "lonely"), (8, "b", "y" * 3_000_000), (9, "b", "y" * 3_000_000), (9, "b", "y" * 3_000_000),
    (None, "n", "x" * 1000),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")


def test_round_trip(spark, tmp_path):
    index = warc.archive(pages(spark).repartition(3), f"file://{tmp_path}/w")
    got = warc.read_records(index).collect()
    want = []
    for page_id, _, html in ROWS:
        data = (html or "").encode()
        twins = [p for p, _, h in ROWS if (h or "") == (html or "") and p is not None]
        last = max(twins, default=None) if len(data) >= 1000 else None
        revisit = last is not None and last != page_id
        want.append((str(page_id), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None, None if revisit else data))
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.payload is not None else None) for r in got), key=repr) == sorted(want, key=repr)
    for r in index.collect():
        with open(r.archive.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            headers, _ = warc.parse(gzip.decompress(f.read(r.length)))
        assert headers["WARC-Record-ID"] == r.record_id
    whole = sorted(tmp_path.glob("w/whole/*.gz"))
    for w in whole:
        assert b"".join(warc.records(iter([gzip.decompress(w.read_bytes())]))) == gzip.decompress((tmp_path / "w/members" / w.name).read_bytes())
        assert (tmp_path / "w/members" / f"{w.name}.idx").read_text().count("\n") == gzip.decompress(w.read_bytes()).count(b"WARC-Record-ID")


def test_streams():
    data = b"".join(warc.record(i, "u", b"z" * i, "00" * 20, None, False) for i in range(300))
    for size in (1, 7, 100_000):
        assert b"".join(warc.records(data[i : i + size] for i in range(0, len(data), size))) == data
    with pytest.raises(ValueError):
        list(warc.records(iter([data[:-5]])))
    import io

    many = b"".join(warc.deflated(data[i : i + 1000]) for i in range(0, len(data), 1000))
    assert b"".join(warc.inflated(io.BytesIO(many))) == data == zlib.decompress(warc.deflated(data), 31)


def test_empty(spark):
    assert warc.read_records(warc.archive(pages(spark, []))).collect() == []

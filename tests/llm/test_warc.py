import gzip
import hashlib

import pytest

from weftgraph.llm import warc


def test_framing():
    for n in (0, 1, 9, 10, 11, 5000):
        data = bytes(range(256)) * (n // 256 + 1)
        assert warc.unframe(warc.frame(data[:n], 10)) == data[:n]
    assert warc.unframe(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unframe(b"5\r\nabc\r\n0\r\n\r\n")
    assert warc.payload_of(b"HTTP/1.0 200 OK\r\nX: y\r\n\r\nplain") == b"plain"


def test_parse_any_cut_and_members():
    data = [b"", b"WARC/1.1\r\n\r\n", b"x" * 700, b"\r\n\r\n\r\n"]
    rows = [r for k, d in enumerate(data) for r in warc.records_of(f"n{k}", k, "http://a b\r\n", d, "0", None, 300)]
    whole = b"".join(rows)
    for step in (1, 7, 10_000):
        got = list(warc.parse(whole[i : i + step] for i in range(0, len(whole), step)))
        assert len(got) == len(rows) and b"%20b%0D" in got[0][0][b"warc-target-uri"]
    zipped = b"".join(map(gzip.compress, rows))
    assert list(warc.parse(warc.unzipped(zipped, 50))) == got == list(warc.parse(warc.unzipped(gzip.compress(whole))))
    with pytest.raises(ValueError):
        list(warc.parse(iter([whole[:-10]])))


def test_query_equals_brute_force(spark, tmp_path):
    long = "é<p>\r\n\r\nWARC/1.1\r\n" * 40_000
    rows = [(3, "u", "a" * 100), (1, None, "a" * 100), (2, "u", "a" * 99), (4, "u", "a" * 99), (5, "u", None), (6, "u", ""), (7, "u", long), (8, "u", long), (9, "u", long + "x"), (1, "u", "a" * 100), (None, "u", "a" * 100), (None, "u", "b" * 200)]
    spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").write.parquet(f"{tmp_path}/pages.parquet")
    want = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and len(data) >= 100 and p is not None]
        first = min(same, default=None)
        to = first if first is not None and first != page_id else None
        want.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to))
    got = [tuple(r) for r in warc.query(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.write(spark.createDataFrame([], "page_id long, url string, html string"))


def test_missing_segment_is_an_error(spark):
    rows = [("o", 1, None, 1, "d", b"ab"), ("o", 3, 5, None, None, b"e")]
    with pytest.raises(Exception, match="not whole"):
        warc.reassemble(spark.createDataFrame(rows, warc.PIECE)).collect()

import hashlib
import re
import zlib

import pytest

from weftgraph.llm import media


def test_interleave_keeps_order_positions_and_captions():
    html = "<title>T</title><p>one <b>two</b></p><figure><img src=a data-digest=d1 alt=x><figcaption>cap &amp; 1</figcaption></figure>mid<img data-digest=d2 alt='alt 2'/><script>no</script><p>end"
    got = [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in media.interleave(html)]
    assert got == [(0, "text", "T", None, None), (1, "text", "one two", None, None), (2, "media", None, "d1", "cap & 1"), (3, "text", "mid", None, None), (4, "media", None, "d2", "alt 2"), (5, "text", "end", None, None)]
    assert media.interleave(None) == media.interleave("") == []
    assert media.interleave("<figcaption>alone")[0]["text"] == "alone"


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 200])
def test_png_round_trip(n):
    data = bytes((i * i) % 251 for i in range(576 * n))
    stored = media.encode(data)
    assert media.decode(stored).tobytes() == data
    assert len(media.feature(media.decode(stored))) == 16
    with pytest.raises(ValueError):
        media.decode(stored[:40] + b"\0" + stored[41:])


def test_query_columns(spark, tmp_path):
    texts = ["", None, "é" * 288, "a" * 577, "x" * 200_000, "copy", "copy", "copy", "a < b & c > d\n\n<p>two</p>\r\n \nthree\n</article><img>\0\nlast"]
    rows = [(i if i != 7 else None, t, "clash") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, digest string").write.parquet(f"{tmp_path}/documents.parquet")
    got = media.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        data = (texts[r.doc_id if r.doc_id is not None else 7] or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        lines = re.split(r"[\n\r]+", data.decode())
        before = sum(bool(x.strip()) for x in lines[: len(lines) // 2])
        assert (r.media_sha256, r.position, r.caption) == (hashlib.sha256(media.encode(payload)).hexdigest(), before, f"{len(data)} bytes")
        assert r.media_bytes == len(media.encode(payload)) and r.feature == plain_feature(payload)


def plain_feature(payload):
    """The cells' means one by one, by the definition."""
    height = len(payload) // 576
    cells = []
    for i in range(8):
        rows = range(i * height // 8, (i + 1) * height // 8) or range(i * height // 8, i * height // 8 + 1)
        for j in range(8):
            values = [payload[y * 576 + x] for y in rows for x in range(j * 72, (j + 1) * 72)]
            cells.append(sum(values) / max((i + 1) * height // 8 - i * height // 8, 1))
    mean = sum(cells) / 64
    return f"{int(''.join('1' if c > mean else '0' for c in cells), 2):016x}"


@pytest.mark.parametrize("html", ["<p>a<![foo[ b", "<![x]]>", "<![CDATA[in]]>z", "<!", "<!-- open", "<a <b <c", "</", "&#xffffffff; &bogus;", "<![if !IE]>x<![endif]>y", "<p>\0<img data-digest=d", "<!DOCTYPE [<!ELEMENT x>]>t", "<![ignore[a]]>b<img data-digest=q>"])
def test_malformed_html_never_stops_a_page(html):
    got = media.interleave(f"before {html} after")
    assert [x["position"] for x in got] == list(range(len(got))) and got[0]["text"].startswith("before")


def test_paragraphs_and_figure_stay_in_order(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("one <i>\ntwo & more\nthree\nfour",)], "t string").select(media.page(F.col("t"), F.lit("d"), F.lit("cap")).alias("html"))
    got = [(x["kind"], x["text"], x["digest"], x["caption"]) for x in media.interleave(rows.first()["html"])]
    assert got == [("text", "one <i>", None, None), ("text", "two & more", None, None), ("media", None, "d", "cap"), ("text", "three", None, None), ("text", "four", None, None)]


def test_missing_payload_stays_with_nulls(spark):
    pages = spark.createDataFrame([(1, "<img data-digest=none alt=c>t"), (2, None)], "id long, html string")
    features = spark.createDataFrame([], media.FEATURES)
    got = media.resolve(media.sequences(pages, "id"), features, "id").collect()
    assert [(r.id, r.position, r.caption, r.feature) for r in got] == [(1, 0, "c", None)]

"""Charsets of landed bytes, and reading only the pages that are asked for."""

import codecs

import pytest
from pyspark.sql import functions as F

from fencewatch.functions import encodings
from fencewatch.operators import details
from fencewatch.operators.lookup import asked_snapshots, likely_among
from fencewatch.plans import search
from fencewatch.sources.landed import read_page_bytes
from fencewatch.sources.register import RegisterError, read_register, register_header
from fencewatch.sources.scratch import written
from fencewatch.workload import render

TEXT = "<p>Crème brûlée – “5 €” ñ ß</p>"
DECLARED = '<html><head><meta charset="{}"></head>' + TEXT


def _told(spark, contents):
    frame = spark.createDataFrame(list(enumerate(contents)), "n int, content binary")
    rows = frame.select("n", encodings.charset_of(F.col("content")).alias("c"), encodings.page_text(F.col("content")).alias("t")).orderBy("n").collect()
    return [(r["c"], r["t"]) for r in rows]


def test_charset_and_text(spark):
    latin = '<meta http-equiv="Content-Type" content="text/html; charset=ISO-8859-1">' + TEXT
    wrong = DECLARED.format("utf-16")
    unknown = DECLARED.format("koi8-r")
    xml = '<?xml version="1.0" encoding="windows-1252"?>' + TEXT
    far = " " * 2000 + DECLARED.format("windows-1252")
    cases = [
        (TEXT.encode(), ("UTF-8", TEXT)),
        (codecs.BOM_UTF8 + TEXT.encode(), ("UTF-8", TEXT)),
        (codecs.BOM_UTF16_LE + (TEXT + "😀").encode("utf-16-le"), ("UTF-16LE", TEXT + "😀")),
        (codecs.BOM_UTF16_BE + (TEXT + "😀").encode("utf-16-be"), ("UTF-16BE", TEXT + "😀")),
        (DECLARED.format("Windows-1252").encode("cp1252"), ("windows-1252", DECLARED.format("Windows-1252"))),
        (latin.encode("cp1252"), ("windows-1252", latin)),
        (xml.encode("cp1252"), ("windows-1252", xml)),
        (TEXT.encode("cp1252"), ("windows-1252", TEXT)),
        (wrong.encode(), ("UTF-8", wrong)),
        (unknown.encode(), ("UTF-8", unknown)),
        (far.encode(), ("UTF-8", far)),
        (b"", ("UTF-8", "")),
        (None, (None, None)),
    ]
    assert _told(spark, [content for content, _ in cases]) == [wanted for _, wanted in cases]


def test_broken_bytes_do_not_fail(spark):
    contents = [
        b'<meta charset="utf-8">\xff\xc3 a',
        codecs.BOM_UTF16_LE + b"a\x00\x00\xd8b\x00\x00\xdcc\x00\x3d\xd8\x00\xdedd",
        codecs.BOM_UTF16_BE + b"\x00a\xdc\x00\xd8\x00\xd8\x00\xdc\x00\x00",
        bytes(range(256)),
    ]
    texts = [t for _, t in _told(spark, contents)]
    assert texts[0].startswith('<meta charset="utf-8">�') and texts[0].endswith(" a")
    assert texts[1] == "a�b�c😀摤"
    assert texts[2] == "a��\U00010000"
    assert texts[3] == bytes(range(256)).decode("latin-1").translate(
        {c: bytes([c]).decode("cp1252") for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
    )


def test_page_files_of_several_encodings(spark, tmp_path):
    for name, data in (("a", TEXT.encode()), ("b", TEXT.encode("cp1252")), ("c", codecs.BOM_UTF16_LE + TEXT.encode("utf-16-le"))):
        (tmp_path / f"{name}.html").write_bytes(data)
    rows = read_page_bytes(spark, str(tmp_path)).collect()
    assert {r["url"][-6:]: (r["charset"], r["html"]) for r in rows} == {
        "a.html": ("UTF-8", TEXT), "b.html": ("windows-1252", TEXT), "c.html": ("UTF-16LE", TEXT)
    }


@pytest.mark.parametrize("encoding", ["UTF-8", "ISO-8859-1", "UTF-16LE"])
def test_register_in_an_encoding(spark, tmp_path, encoding):
    (tmp_path / "r.txt").write_bytes("Modèle\tColor\nVélo\tBLÜ\nñ\t\n".encode(encoding))
    path = str(tmp_path / "r.txt")
    assert register_header(spark, path, encoding) == ["Modèle", "Color"]
    if encoding == "UTF-16LE":
        return  # lines of wide units are parted by Spark's reader only where it is told how
    rows = read_register(spark, path, encoding=encoding).collect()
    assert [tuple(r) for r in rows] == [("Vélo", "BLÜ"), ("ñ", None)]


def test_register_header_with_a_mark(spark, tmp_path):
    (tmp_path / "r.txt").write_bytes(codecs.BOM_UTF8 + "Model\tColor\na\tb\n".encode())
    assert register_header(spark, str(tmp_path / "r.txt")) == ["Model", "Color"]
    (tmp_path / "e.txt").write_bytes(b"")
    with pytest.raises(RegisterError):
        register_header(spark, str(tmp_path / "e.txt"))


# --- only what is asked for


def test_likely_rows_hold_all_asked_ones_and_few_others(spark):
    frame = spark.range(200_000).selectExpr("id AS key", "'other' AS __note")
    wanted = written(frame.where("key % 1000 = 3").select(F.xxhash64("key").alias("hash")), "test-hashes")
    for bits in (1 << 29, 1 << 15):
        got = likely_among(frame, F.xxhash64("key"), wanted, bits)
        keys = {r["key"] for r in got.select("key").collect()}
        assert got.columns == frame.columns
        assert set(range(3, 200_000, 1000)) <= keys and len(keys) < 2500
    assert likely_among(frame, F.xxhash64("key"), wanted, 1 << 14).count() == 200_000
    none = wanted.where("false")
    assert likely_among(frame, F.xxhash64("key"), none).count() == 0


def test_a_null_address_is_not_asked_for(spark):
    pages = spark.createDataFrame([(None, "x", 1), ("a", "y", 1), ("a", "z", 2), ("b", "w", None)], "url string, html string, fetched_at int")
    links = spark.createDataFrame([("a",), (None,), ("a",), ("b",)], "link_url string")
    assert sorted(r["html"] for r in asked_snapshots(pages, links).collect()) == ["w", "z"]
    assert sorted(r["html"] for r in asked_snapshots(pages, links, unique=True).collect()) == ["w", "y", "z"]


@pytest.fixture(scope="module")
def many_pages(spark):
    """10,000 detail pages, each landed twice, and requests whose result pages name a hundredth of them."""
    links = F.concat(F.lit("http://t.en.example.org/bik/"), F.col("id").cast("string"), F.lit(".html"))
    body = F.concat(F.lit('<h2 class="postingtitle">T'), F.col("id").cast("string"), F.lit(" "), F.col("fetched_at").cast("string"))
    pages = spark.range(10_000).withColumn("fetched_at", F.explode(F.array(F.lit(1), F.lit(2))))
    pages = pages.select(
        links.alias("url"), F.concat(body, F.lit('</h2><section class="userbody">text</section>')).alias("html"), "fetched_at"
    )
    return written(pages, "many-pages")


def test_only_asked_pages_are_parsed(spark, many_pages, monkeypatch):
    row = '<p class="row"><span class="itemdate"> Oct 22</span><a href="http://t.en.example.org/bik/{}.html">s</a></p>'
    result = "<html><body>" + "".join(row.format(i * 100) for i in range(40)) + "</body></html>"
    requests = spark.createDataFrame([("r", "t", "0", "w")], "request_id string, city string, page string, terms string")
    from fencewatch.operators.results import with_search_url

    url = with_search_url(requests, render.HTML_RULES).first()["url"]
    results = spark.createDataFrame([(url, result)], "url string, html string")
    parsed = spark.sparkContext.accumulator(0)
    read = details.read_details

    def counted(pages, *args, **kwargs):
        kept = written(pages, "parsed-pages")
        parsed.add(kept.count())
        return read(kept, *args, **kwargs)

    monkeypatch.setattr(search, "read_details", counted)
    found = search.search_html(requests, results, many_pages, 2012, render.HTML_RULES).collect()
    assert sorted((r["link_url"], r["title"]) for r in found) == sorted(
        (f"http://t.en.example.org/bik/{i * 100}.html", f"T{i * 100} 2") for i in range(40)
    )
    assert 40 <= parsed.value < 100  # of 20,000

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fencewatch.operators import signals, tables
from fencewatch.sources import landed, rss, scratch
from fencewatch.sources.json_rows import object_fields, read_json_rows
from fencewatch.streaming import landing
from tests.pages import detail_page, feed


def sorted_values(frame, column, kind, **options):
    return [r[column] for r in tables.typed_sort(frame, column, kind, ["i"], **options).collect()]


def test_typed_sort(spark):
    dates = spark.createDataFrame(
        [(1, "02-01-2013"), (2, "31-12-2012"), (3, "01-02-2013")], "i int, v string"
    )
    assert sorted_values(dates, "v", "date") == ["31-12-2012", "02-01-2013", "01-02-2013"]
    numbers = spark.createDataFrame([(1, "10"), (2, "9"), (3, "n/a"), (4, "-1")], "i int, v string")
    assert sorted_values(numbers, "v", "numeric") == ["-1", "n/a", "9", "10"]
    assert sorted_values(numbers, "v", "numeric", descending=True) == ["10", "9", "n/a", "-1"]
    texts = spark.createDataFrame([(1, "b"), (2, "A"), (3, "a")], "i int, v string")
    assert sorted_values(texts, "v", "text") == ["A", "a", "b"]


def test_kind_comes_from_the_second_row(spark):
    frame = spark.createDataFrame([(1, "x"), (2, "12.5"), (3, "y")], "i int, v string")
    assert tables.kind_of_column(frame, "v", ["i"]) == "numeric"
    assert tables.kind_of_column(frame.where("i > 1"), "v", ["i"]) == "text"
    assert tables.kind_of_column(frame.where("i > 9"), "v", ["i"]) == "text"


def test_lookup_link(spark):
    frame = spark.createDataFrame([("p", "q")], "a string, b string")
    row = tables.with_lookup_link(frame, "l", "x?id=", "b").first()
    assert row.l == "x?id=q"
    row = tables.with_lookup_link_from_right(frame, "l", "x?id=", 1).first()
    assert row.l == "x?id=p"


def test_phone_reuse(spark):
    frame = spark.createDataFrame(
        [(1, "6045550000"), (2, "6045550000"), (3, "12345678"), (4, "12345678"), (5, None), (6, "1")],
        "i int, phone_number string",
    )
    got = {r.i: r.phone_adverts for r in signals.phone_reuse(frame).collect()}
    assert got == {1: 2, 2: 2, 3: None, 4: None, 5: None, 6: 1}


def test_price_outlier(spark):
    frame = spark.createDataFrame(
        [("r", "$10"), ("r", "$30"), ("r", "ask"), ("s", "ask"), ("t", "$0")],
        "request_id string, price string",
    )
    got = {(r.request_id, r.price): (r.amount, r.price_ratio) for r in signals.price_outlier(frame).collect()}
    assert got["r", "$10"] == (Decimal("10.00"), 0.5)
    assert got["r", "$30"] == (Decimal("30.00"), 1.5)
    assert got["r", "ask"] == (None, None) and got["s", "ask"] == (None, None)
    assert got["t", "$0"] == (Decimal("0.00"), None)


def test_known_price(spark):
    frame = spark.createDataFrame([("bike", "$50"), ("boat", "$9")], "category string, price string")
    known = spark.createDataFrame([("bike", 200.0)], "category string, average_price double")
    got = {r.category: r.known_price_ratio for r in signals.price_against_known(frame, known).collect()}
    assert got == {"bike": 0.25, "boat": None}


def test_missing_fields_and_points(spark):
    frame = spark.createDataFrame(
        [(1, "t", "12345678", None, 10), (2, " ", "6045551234", ["a"], 20)],
        "i int, title string, phone_number string, images array<string>, dodgy_score int",
    )
    counted = signals.missing_fields(frame, ["title", "phone_number", "images"])
    scored = signals.combine_signals(
        counted, {"missing": F.col("missing_fields") * 5, "none": F.lit(None)}
    )
    got = {r.i: (r.missing_fields, r.signal_points, r.total_score) for r in scored.collect()}
    assert got == {
        1: (2, {"missing": 10, "none": 0}, 20),
        2: (1, {"missing": 5, "none": 0}, 25),
    }


def test_stock_images(spark):
    listings = spark.createDataFrame([("a",), ("b",), ("c",)], "link_url string")
    counted = spark.createDataFrame(
        [("a", 0), ("a", 3), ("b", 0)], "listing_id string, match_count int"
    )
    got = {r.link_url: r.stock_images for r in signals.stock_images(listings, counted, "link_url").collect()}
    assert got == {"a": 1, "b": 0, "c": 0}


def test_page_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<h2>é</h2>\n<p>x</p>", encoding="utf-8")
    (tmp_path / "b.html").write_text("<h2>é</h2>", encoding="latin-1")
    rows = landed.read_page_files(spark, str(tmp_path / "a.html")).collect()
    assert rows[0].html == "<h2>é</h2>\n<p>x</p>" and rows[0].url.endswith("a.html")
    rows = landed.read_page_files(spark, str(tmp_path / "b.html"), "ISO-8859-1").collect()
    assert rows[0].html == "<h2>é</h2>" and rows[0].url.endswith("b.html")


def test_page_tables(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame([("u", "h", 1, 9)], "url string, html string, fetched_at int, x int").write.parquet(path)
    assert landed.read_pages(spark, path).columns == ["url", "html", "fetched_at"]
    sized = spark.createDataFrame([("u", "é" * 3), ("v", "abc")], "url string, html string")
    assert [r.url for r in landed.within_size(sized, 5).collect()] == ["v"]
    match = str(tmp_path / "match")
    spark.createDataFrame([("i", 200, "h")], "image_uri string, http_status int, html string").write.parquet(match)
    assert landed.read_match_page_table(spark, match).columns == ["image_uri", "http_status", "html"]


def test_feed_files(spark, tmp_path):
    (tmp_path / "f.xml").write_text(feed(["http://x/1?a=1&amp;b=2", "http://x/2"]))
    links = rss.read_feed_items(spark, str(tmp_path)).collect()
    assert {r.link_url for r in links} == {"http://x/1?a=1&b=2", "http://x/2"}
    assert all(r.url.endswith("f.xml") for r in links)
    assert rss.read_feeds(spark, str(tmp_path)).columns == ["url", "xml"]


def test_json_rows(spark, tmp_path):
    path = tmp_path / "rows.json"
    path.write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2.5, "c": True}], indent=1))
    rows = read_json_rows(spark, str(path)).orderBy("a").collect()
    assert [r.asDict() for r in rows] == [
        {"a": "1", "b": "x", "c": None},
        {"a": "2.5", "b": None, "c": "true"},
    ]


def test_json_fields(one):
    assert one('{"k": 69, "s": "t"}', object_fields) == {"k": "69", "s": "t"}


class Session:
    """Just enough of a session to ask for its settings."""

    def __init__(self, master, folder):
        self.sparkContext = self
        self.master = master
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}


def test_scratch_folder():
    assert scratch.shared_folder(Session("spark://x", "s3://b/c")) == "s3://b/c"
    for master in ("local[2]", "spark://x"):
        with pytest.raises(RuntimeError):
            scratch.shared_folder(Session(master, None))
    path = scratch.fresh_path(Session("spark://x", "s3://b/c/"), "n")
    assert path.startswith("s3://b/c/fencewatch/n-")


def test_written_tables_keep_rows_and_schema(spark):
    frame = scratch.written(spark.range(5), "five")
    assert frame.count() == 5 and frame.dtypes == [("id", "bigint")]
    assert scratch.shared_folder(spark) in frame.inputFiles()[0]


def test_stream_gives_the_batch_answer_and_goes_on(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "url string, html string"

    def land(*numbers):
        rows = [(f"u{n}", detail_page(f"t{n}")) for n in numbers]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        pages = landing.stream_pages(spark, source)
        query = landing.write_stream(landing.score_stream(pages), sink, state)
        query.awaitTermination(120)
        return spark.read.parquet(sink)

    land(1, 2)
    assert {r.title for r in run().collect()} == {"t1", "t2"}
    land(3)
    rows = run().collect()
    assert sorted(r.link_url for r in rows) == ["u1", "u2", "u3"]
    assert {r.dodgy_score for r in rows} == {999}

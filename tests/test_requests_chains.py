"""Requests by contained terms, as-of joins, answers over several pages, JSON arrays and price sketches."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from fencewatch.operators import contains, keyed
from fencewatch.operators.asof import first_adverts, next_event
from fencewatch.operators.chains import answer_locations, chain_starts, next_page, page_starts
from fencewatch.operators.contains import answers, grams, search_requests, starts
from fencewatch.operators.price_levels import price_level, price_sketches
from fencewatch.sources.json_rows import array_rows
from fencewatch.sources.scratch import written

# --- contains


def test_grams(one):
    assert sorted(one("abcab", grams)) == ["abc", "bca", "cab"]
    assert one("ab", grams) == [] and one("", grams) == []
    assert sorted(one("añ😀x", lambda t: F.array_intersect(grams(t), F.array(F.lit("añ😀"), F.lit("ñ😀x"))))) == ["añ😀", "ñ😀x"]
    assert sorted(one("a\nb", lambda t: grams(t, 2))) == ["\nb", "a\n"]


def test_a_long_text_is_taken_apart_in_linear_time(one):
    assert len(one("".join(chr(97 + i * i % 23) for i in range(300_000)), grams)) < 300_000


def _plain_search(requests, adverts):
    out = []
    for request_id, city, terms in requests:
        terms = (terms or "").lower().split()
        for advert_id, where, text in adverts:
            if terms and city is not None and city == where and text is not None and all(t in text.lower() for t in terms):
                out.append((request_id, advert_id))
    return sorted(out)


def test_requests_find_what_a_nested_loop_finds(spark):
    draw = random.Random(1)
    letters = "aabcñ😀"
    texts = ["".join(draw.choice(letters + "  ") for _ in range(draw.randint(0, 30))) for _ in range(120)]
    adverts = [(i, draw.choice(["x", "y", None]), draw.choice([t, t.upper()])) for i, t in enumerate(texts)] + [(500, "x", None)]
    requests = []
    for i in range(150):
        terms = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 5))) for _ in range(draw.randint(0, 3))]
        requests.append((f"r{i}", draw.choice(["x", "y", "z", None]), "  ".join(terms) or draw.choice(["", " ", None])))
    requests += [("again", "x", "A a"), ("twin", "x", "a")]
    found, members = search_requests(
        spark.createDataFrame(requests, "request_id string, city string, terms string"),
        spark.createDataFrame(adverts, "advert_id int, city string, text string"),
    )
    got = members.join(found, "set_id").select("request_id", "advert_id").collect()
    assert sorted(tuple(r) for r in got) == _plain_search(requests, adverts)
    sets = {r["request_id"]: r["set_id"] for r in members.collect()}
    assert sets["again"] == sets["twin"]


@pytest.mark.parametrize("at_once", [10, 1000])
def test_pairs_of_sets_and_texts_are_never_stored(spark, monkeypatch, at_once):
    sizes = []

    def counted(frame, name):
        stored = written(frame, name)
        sizes.append(stored.count())
        return stored

    monkeypatch.setattr(contains, "written", counted)
    monkeypatch.setattr(contains, "SETS_AT_ONCE", at_once, raising=False)
    one_word, other_word = [f"a{chr(98 + i)}c" for i in range(12)], [f"x{chr(98 + i)}z" for i in range(12)]
    requests = [(f"{a}-{b}", "x", f"{a} {b}") for a in one_word for b in other_word]
    adverts = [(i, "x", " ".join(one_word + other_word)) for i in range(40)]
    found, members = search_requests(
        spark.createDataFrame(requests, "request_id string, city string, terms string"),
        spark.createDataFrame(adverts, "advert_id int, city string, text string"),
    )
    got = members.join(found, "set_id").select("request_id", "advert_id").collect()
    assert sorted(tuple(r) for r in got) == _plain_search(requests, adverts)
    assert len(got) == 144 * 40 and max(sizes) <= 24 * 40


def test_starts(one):
    assert sorted(one("abcabcd e", lambda t: starts(t, 3))) == ["abc", "bca", "bcd", "cab", "cd", "d", "e"]
    assert one(" \n", starts) == [] and one("", starts) == []
    assert sorted(one("ñ😀xyz1", starts)) == ["1", "xyz1", "yz1", "z1", "ñ😀xyz", "😀xyz1"]
    assert len(one("".join(chr(97 + i * i % 23) for i in range(300_000)), starts)) < 300_000


@pytest.mark.parametrize("at_once", [80, 1000])
def test_answers_with_long_terms_many_terms_and_copies(spark, monkeypatch, at_once):
    monkeypatch.setattr(contains, "SETS_AT_ONCE", at_once)
    monkeypatch.setattr(contains, "REQUESTS_AT_ONCE", at_once)
    monkeypatch.setattr(contains, "LETTERS_OF_A_TASK", 500)
    draw = random.Random(at_once)
    words = ["".join(draw.choice("abñ😀") for _ in range(draw.randint(1, 9))) for _ in range(60)]
    adverts = [(i, draw.choice("xy"), " ".join(draw.choice(words) for _ in range(draw.randint(0, 40)))) for i in range(80)]
    # More terms than bits in a number, in one city.
    adverts += [(100 + i, "z", " ".join(f"t{n}" for n in range(i, 200, 3))) for i in range(3)]
    requests = []
    for i in range(120):
        terms = []
        for _ in range(draw.randint(1, 9)):
            word = draw.choice(words)
            at = draw.randint(0, len(word) - 1)
            terms.append(word[at : at + draw.randint(1, 9)])
        requests.append((draw.choice([f"r{i}", "same", None]), draw.choice("xy"), " ".join(terms)))
    requests += [(f"z{i}", "z", f"t{draw.randint(0, 199)} t{draw.randint(0, 199)}") for i in range(200)]
    # A longer term whose beginning is there, and one over the end of a word.
    adverts.append((200, "x", "qqqqqqq wwwww"))
    adverts.append((201, "x", "😀xyz"))
    requests += [("half", "x", "?xyz"), ("half", "x", "?xy"), ("long", "x", "qqqqqqq"), ("longer", "x", "qqqqqqqq"), ("over", "x", "qqwww")]
    named = [(request_id or "", city, terms) for request_id, city, terms in requests]
    wanted = _plain_search(named, adverts)
    wanted += [row for row in _plain_search(named, adverts[:10]) for _ in range(3)]  # two copies each find both
    wanted = [(request_id or None, advert_id) for request_id, advert_id in wanted]
    frame = spark.createDataFrame(adverts + adverts[:10] + [(None, "x", "a b"), (300, None, "a b")], "advert_id int, city string, text string")
    found, members = search_requests(spark.createDataFrame(requests, "request_id string, city string, terms string"), frame)
    by_id = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert by_id(answers(found, members).collect()) == by_id(wanted) and len(wanted) > 1000
    assert by_id(members.join(found, "set_id").select("request_id", "advert_id").collect()) == by_id(wanted)


def test_sets_meet_bits_and_matches_are_not_shuffled(spark):
    texts = [(i, "x", f"advert {i} of a chair") for i in range(50)]
    adverts = spark.createDataFrame(texts, "advert_id int, city string, text string")
    asked = [(f"r{i}", "x", f"{i} chair of advert a air dve") for i in range(50)]
    requests = spark.createDataFrame(asked, "request_id string, city string, terms string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found, members = search_requests(requests, adverts)
        given = answers(found, members)
        assert sorted(tuple(r) for r in given.collect()) == _plain_search(asked, texts)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = given._jdf.queryExecution().executedPlan().toString()
    # Texts are not looked at for a set, and neither texts nor matches are sorted for a join.
    assert "text#" not in plan and "contains(" not in plan.lower() and "SortMergeJoin" not in plan


def test_no_requests_or_no_adverts(spark):
    none = spark.createDataFrame([], "request_id string, city string, terms string")
    some = spark.createDataFrame([("r", "x", "a")], none.schema)
    adverts = spark.createDataFrame([], "advert_id int, city string, text string")
    assert search_requests(none, adverts)[0].count() == search_requests(some, adverts)[0].count() == 0


def test_no_answers(spark):
    none = spark.createDataFrame([], "request_id string, city string, terms string")
    adverts = spark.createDataFrame([(1, "x", "b")], "advert_id int, city string, text string")
    for requests in (none, spark.createDataFrame([("r", "x", "a")], none.schema)):
        for searched in (adverts, adverts.limit(0)):
            assert answers(*search_requests(requests, searched)).count() == 0


# --- as-of


@pytest.fixture
def many_parts(spark):
    """Small tables would be put into one part: keep the parts apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _plain_next(left, right):
    out = []
    for key, day, number in left:
        later = [(d, i) for k, d, i in right if k == key and d is not None and key is not None and day is not None and d >= day]
        out.append((key, day, number, *min(later, default=(None, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 8])
def test_next_event_equals_a_search(spark, many_parts, parts):
    draw = random.Random(parts)
    day = lambda: draw.choice([None, *[dt.date(2012, 1, 1) + dt.timedelta(draw.randint(0, 60)) for _ in range(20)]])
    keys = ["hot"] * 6 + ["a", "b", "c", None]
    left = [(draw.choice(keys), day(), i) for i in range(300)]
    left += left[:5]
    right = [(draw.choice(keys), day(), draw.randint(0, 50)) for i in range(250)] + [("only right", dt.date(2012, 1, 1), 1)]
    frames = (
        spark.createDataFrame(left, "key string, day date, number int").repartition(parts),
        spark.createDataFrame(right, "key string, posted date, listing int").repartition(parts),
    )
    got = next_event(*frames, "key", "day", "posted", "listing").collect()
    assert sorted((tuple(r) for r in got), key=repr) == _plain_next(left, right)


def test_a_hot_key_lies_in_several_parts(spark, many_parts):
    from fencewatch.operators import asof

    left = spark.range(2000).selectExpr("'hot' AS key", "date_add(DATE'2000-01-01', cast(id AS int)) AS day", "id AS number")
    right = spark.createDataFrame([("hot", dt.date(2005, 6, 1), 7)], "key string, posted date, listing int")
    sizes = []
    real = asof.written

    def noted(df, name):
        done = real(df, name)
        if name == "as-of":
            sizes.extend(r["count"] for r in done.groupBy("__part").count().collect())
        return done

    asof.written = noted
    try:
        rows = asof.next_event(left, right, "key", "day", "posted", "listing").collect()
    finally:
        asof.written = real
    assert len(sizes) > 1 and max(sizes) < 1500
    assert all((r["listing"] == 7) == (r["day"] <= dt.date(2005, 6, 1)) for r in rows) and len(rows) == 2000


def test_first_adverts_count_days(spark):
    thefts = spark.createDataFrame([("a", dt.date(2012, 3, 1)), ("b", dt.date(2012, 3, 1))], "item string, stolen_on date")
    adverts = spark.createDataFrame([("a", dt.date(2012, 2, 1), 1), ("a", dt.date(2012, 3, 4), 2)], "item string, posted date, listing_id int")
    rows = {r["item"]: (r["listing_id"], r["delay_days"]) for r in first_adverts(thefts, adverts, "item").collect()}
    assert rows == {"a": (2, 3), "b": (None, None)}


# --- chains


def test_next_page(one):
    page = '<a href="x">Next</a><div class="pagination" id=p><a href="/1">« Prev</a><a\nhref="/?p=2&amp;s=1">2</a><a href="/?p=3&amp;s=1">Next »</a></div>'
    assert one(page, next_page) == "/?p=3&s=1"
    assert one('<div class="pagination"><a href="/1">1</a></div>', next_page) is None
    assert one(None, next_page) is None


def test_starts_of_chains_rings_and_forks(spark):
    rows = [("s", "p1", True)] + [(f"p{i}", f"p{i + 1}" if i < 40 else None, False) for i in range(1, 41)]
    rows += [("r1", "r2", False), ("r2", "r3", False), ("r3", "r1", False), ("lost", None, False), ("self", "self", False)]
    rows += [("t", "u", True), ("u", "t", False), ("f1", "g", True), ("f2", "g", True), ("g", None, False), ("n", "not landed", True)]
    got = chain_starts(spark.createDataFrame(rows, "url string, next_url string, is_start boolean"))
    wanted = {"s": "s", "t": "t", "u": "t", "f1": "f1", "f2": "f2", "g": "f1", "n": "n"} | {f"p{i}": "s" for i in range(1, 41)}
    assert {r["url"]: r["start"] for r in got.collect()} == wanted


def test_locations_of_all_pages_of_an_answer(spark):
    def html(places, after=None):
        listed = "".join(f'<div class="search-results-location"><p><a href="{p}">x</a></p></div>' for p in places)
        link = f'<a href="{after}">Next »</a>' if after else ""
        return f'{listed}<div class="pagination">{link}</div>'

    rows = [
        ("a1", "A", 200, html(["x", "y"], "a2"), 1), ("a2", None, 200, html(["y", "z"], "a3"), 1), ("a3", None, 200, html(["w"]), 2),
        ("a3", None, 200, html(["old"]), 1), ("b1", "B", 200, html(["x"], "b2"), 1), ("b2", None, 500, html(["no"], "b3"), 1),
        ("b3", None, 200, html(["not reached"]), 1), ("c1", "C", 404, html(["no"], "a2"), 1), ("d1", "D", 200, html([]), 1),
    ]
    got = answer_locations(spark.createDataFrame(rows, "url string, image_uri string, http_status int, html string, fetched_at int"))
    assert sorted(tuple(r) for r in got.collect()) == [("A", "w"), ("A", "x"), ("A", "y"), ("A", "z"), ("B", "x")]


def test_locations_of_many_pages_come_in_parts_by_their_number(spark, monkeypatch):
    def html(answer, page):
        places = "".join(f'<div class="search-results-location"><p><a href="p{answer}/{(page * 3 + i) // 2}">x</a></p></div>' for i in range(4))
        after = f'<a href="u{answer}/{page + 1}">Next »</a>' if page < answer % 6 else ""
        return f'{places}<div class="pagination">{after}</div>'

    rows = [(f"u{n}/{p}", f"I{n % 90}" if p == 0 else None, 200, html(n, p)) for n in range(100) for p in range(n % 6 + 1)]
    rows += [rows[7], (None, "no address", 200, html(1, 1)), ("alone", None, 200, html(2, 9))]
    frame = spark.createDataFrame(rows, "url string, image_uri string, http_status int, html string")
    wanted = sorted({(f"I{n % 90}", f"p{n}/{(p * 3 + i) // 2}") for n in range(100) for p in range(n % 6 + 1) for i in range(4)})
    assert sorted(tuple(r) for r in answer_locations(frame).collect()) == wanted
    # 1,400 addresses of 350 pages: a task is given 20, not what adaptive execution takes for a small part.
    monkeypatch.setattr(keyed, "ROWS_OF_A_TASK", 20)
    found = answer_locations(frame).select("*", F.spark_partition_id().alias("part")).collect()
    assert sorted((r["image_uri"], r["original_url"]) for r in found) == wanted
    assert len({r["part"] for r in found}) > 40


def test_numbered_pages_of_chains(spark):
    rows = [(10, "b", "c", True), (11, "a", "c", True), (12, "c", "d", False), (13, "d", "c", False), (14, "x", None, False)]
    links = written(spark.createDataFrame(rows, "page long, url string, next_url string, is_start boolean"), "links")
    assert sorted(tuple(r) for r in page_starts(links).collect()) == [(10, 10), (11, 11), (12, 11), (13, 11)]


# --- JSON arrays


def test_arrays_keep_the_first_objects_order(spark):
    cells = [
        '[{"b": 1, "a": "x"}, {"a": null, "c": 3, "b": {"n": [1]}}]', "[]", None, "no array", '{"a": 1}', '[{}, {"a": 1}]', '[{"ü": true}]',
    ]
    rows = array_rows(spark.createDataFrame(list(enumerate(cells)), "n int, cell string"), "cell", "n").collect()
    got = {}
    for r in sorted(rows):
        got.setdefault(r["n"], []).append([tuple(f) for f in r["fields"]])
    assert got[0] == [[("b", "1"), ("a", "x")], [("b", '{"n":[1]}'), ("a", None)]]
    assert got[5] == [[], []] and got[6] == [[("ü", "true")]]
    assert not {1, 2, 3} & set(got)


def test_array_cells_equal_a_json_reader(spark):
    draw = random.Random(2)
    cells = []
    for _ in range(60):
        names = draw.sample(["a", "b", "c", "d"], draw.randint(1, 4))
        cells.append([{n: draw.choice([1, "t", None, True]) for n in draw.sample(names, draw.randint(1, len(names)))} for _ in range(draw.randint(1, 4))])
    frame = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cells)], "n int, cell string")
    text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
    wanted = [(i, pos, [(k, text(o.get(k))) for k in c[0]]) for i, c in enumerate(cells) for pos, o in enumerate(c)]
    got = [(r["n"], r["pos"], [tuple(f) for f in r["fields"]]) for r in array_rows(frame, "cell", "n").collect()]
    assert sorted(got, key=lambda r: r[:2]) == wanted


# --- price sketches


def test_levels_of_many_prices_are_within_the_stated_error(spark):
    rows = spark.range(40_000).selectExpr("'s' AS search", "cast(id % 7 AS int) AS day", "concat('$', id) AS price").repartition(8)
    sketches = price_sketches(rows, "search", "day")
    assert sketches.count() == 7
    got = price_level(rows, sketches, "search").select("amount", "price_eighth", "median_ratio").collect()
    for r in got:
        assert abs(r["amount"] / r["median_ratio"] - 20_000 if r["median_ratio"] else 0) <= 0.02 * 40_000
        exact = r["amount"] / 40_000 * 8
        assert exact - 1.2 <= r["price_eighth"] <= exact + 0.2


def test_days_are_merged_when_asked_for(spark):
    rows = [("s", d, f"${p}") for d in (1, 2, 3) for p in range(10 * d, 10 * d + 8)] + [("s", 1, ""), ("t", 1, "5"), ("u", 1, None)]
    frame = spark.createDataFrame(rows, "search string, day int, price string")
    sketches = price_sketches(frame, "search", "day")
    two = price_level(frame, sketches.where("day < 3"), "search").where("search = 's' AND day = 3").collect()
    assert {r["price_eighth"] for r in two} == {7} and all(r["median_ratio"] > 1.5 for r in two)
    rest = {(r["search"], r["price"]): (r["price_eighth"], r["median_ratio"]) for r in price_level(frame, sketches, "search").where("search <> 's' OR price = ''").collect()}
    assert rest == {("s", ""): (None, None), ("t", "5"): (0, 1.0), ("u", None): (None, None)}

import itertools
import random

import pytest
from pyspark.sql import functions as F

from fencewatch.operators import matching, register
from fencewatch.plans.register_job import match_reported_items
from fencewatch.sources.register import RegisterError, read_register
from fencewatch.sources.scratch import written
from tests.pages import REGISTER_HEADER, REGISTER_LINES


@pytest.fixture()
def write(tmp_path):
    def build(*lines, name="register.tsv", newline="\n"):
        path = tmp_path / name
        path.write_text("".join(line + newline for line in lines))
        return str(path)

    return build


HEADER = "\t".join(REGISTER_HEADER)


def test_all_columns_are_text(spark, write):
    frame = read_register(spark, write(HEADER, *REGISTER_LINES))
    assert frame.columns == REGISTER_HEADER
    assert {kind for _, kind in frame.dtypes} == {"string"}
    rows = frame.orderBy("Occurence Number").collect()
    assert rows[3]["Model"] == 'RIDGE "LANTERN"'
    assert rows[1]["Model"] is None and rows[1]["Seat style"] is None


def test_year_filter_and_projection(spark, write):
    frame = register.reported_in(read_register(spark, write(HEADER, *REGISTER_LINES)), "2013")
    rows = register.make_model_colour(frame).orderBy("make").collect()
    assert [tuple(r) for r in rows] == [
        ("FJORD", "7.4 DELTA", "BLK"),
        ("HALBERD", None, "BLU"),
        ("OTHER", 'RIDGE "LANTERN"', "BGE"),
    ]


def test_recent_years(spark, write):
    frame = read_register(spark, write(HEADER, *REGISTER_LINES))
    today = F.lit("2014-02-01").cast("date")
    assert register.reported_since(frame, today).count() == 3
    assert register.reported_since(frame, today, years=2).count() == 5


def test_missing_and_empty_files(spark, write, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_register(spark, str(tmp_path / "none.tsv"))
    with pytest.raises(RegisterError):
        read_register(spark, write())
    with pytest.raises(RegisterError):
        read_register(spark, write("", HEADER))
    with pytest.raises(RegisterError):
        read_register(spark, write("a\t\tb", "1\t2\t3"))


@pytest.mark.parametrize("bad", ["1\t2", "1\t2\t3\t4"])
def test_ragged_rows_fail_even_for_one_column(spark, write, bad):
    frame = read_register(spark, write("a\tb\tc", "1\t2\t3", bad))
    with pytest.raises(Exception, match="MALFORMED"):
        frame.select("a").collect()
    with pytest.raises(Exception, match="MALFORMED"):
        frame.count()


def test_ragged_rows_can_be_kept(spark, write):
    frame = read_register(spark, write("a\tb\tc", "1\t2\t3", "4\t5", "6\t7\t8\t9"), bad_rows="keep")
    rows = frame.orderBy("a").collect()
    assert [r.bad_row for r in rows] == [None, "4\t5", "6\t7\t8\t9"]


def test_colours(many):
    codes = ["BLK", "BRNBLK", " silred ", "XYZ", "BLKX", "", None]
    assert many(codes, register.colour_names) == [
        ["black"],
        ["brown", "black"],
        ["silver", "red"],
        ["xyz"],
        ["black", "x"],
        None,
        None,
    ]


def test_words(many):
    assert many(["Kona-Bike, KONA 1.2!", "", None, "Émile's"], matching.words) == [
        ["kona", "bike", "1", "2"],
        [],
        [],
        ["émile", "s"],
    ]


def one_off(a, b):
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def near(a, b):
    return a == b or (min(len(a), len(b)) >= 4 and one_off(a, b))


def test_near_spellings_against_brute_force(spark):
    dice = random.Random(7)
    words = {"".join(dice.choice("abc") for _ in range(dice.randint(1, 7))) for _ in range(300)}
    words = sorted(words | {"halberd", "halbrd", "specialized", "specialised", "oak", "oa"})
    known = words[::7] + ["halberd", "specialized", "oak"]
    known = sorted(set(known))
    got = matching.near_spellings(
        spark.createDataFrame([(w,) for w in words], "token string"),
        spark.createDataFrame([(w,) for w in known], "term string"),
    )
    pairs = {(r.term, r.token) for r in got.collect()}
    assert pairs == {(k, w) for k in known for w in words if near(k, w)}
    assert ("halberd", "halbrd") in pairs and ("specialized", "specialised") in pairs
    assert ("oak", "oa") not in pairs


def test_canonical_word_prefers_the_exact_one(spark):
    vocabulary = spark.createDataFrame([("fjords",), ("fjord",), ("zzzz",)], "token string")
    known = spark.createDataFrame([("fjord",), ("fjorc",), ("fjords",)], "term string")
    rows = matching.canonical_words(vocabulary, known).collect()
    assert {(r.token, r.term) for r in rows} == {("fjords", "fjords"), ("fjord", "fjord")}


@pytest.mark.parametrize("fuzzy", [False, True])
def test_texts_with_all_terms_against_brute_force(spark, fuzzy):
    dice = random.Random(11)
    vocabulary = ["alpha", "alpho", "bravo", "brava", "charlie", "delta", "echo", "fox", "golf", "blue"]
    texts = [(i, " ".join(dice.choices(vocabulary, k=dice.randint(0, 8)))) for i in range(120)]
    items = []
    for i in range(60):
        terms = dice.sample(vocabulary + ["missing"], k=dice.randint(0, 3))
        makes = [t for t in terms if dice.random() < 0.5]
        items.append((i, terms, makes))
    got = matching.texts_with_all_terms(
        spark.createDataFrame(items, "item_id int, terms array<string>, makes array<string>"),
        spark.createDataFrame(texts, "text_id int, text string"),
        "makes" if fuzzy else None,
    )
    pairs = [(r.item_id, r.text_id) for r in got.collect()]
    wanted = set()
    for (item, terms, makes), (text, body) in itertools.product(items, texts):
        have = set(body.split())
        ok = all(
            any(near(t, h) for h in have) if fuzzy and t in makes else t in have for t in terms
        )
        if terms and ok:
            wanted.add((item, text))
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == wanted


def test_common_words_alone_bring_no_more_pairs_than_common_beginnings(spark, monkeypatch):
    pairs = [(f"ox{i}", f"yak{j}") for i in range(20) for j in range(20)]
    sizes = []

    def counted(frame, name):
        stored = written(frame, name)
        sizes.append(stored.count())
        return stored

    monkeypatch.setattr(matching, "written", counted)
    got = matching.texts_with_all_terms(
        spark.createDataFrame([(i, list(pair)) for i, pair in enumerate(pairs)], "item_id int, terms array<string>"),
        spark.createDataFrame([(i, " ".join(pair)) for i, pair in enumerate(pairs)], "text_id int, text string"),
    )
    assert sorted((r.item_id, r.text_id) for r in got.collect()) == [(i, i) for i in range(len(pairs))]
    assert max(sizes) <= 2 * len(pairs)


def test_texts_and_items_that_come_twice_or_without_an_id(spark):
    items = [(1, ["red", "bike"]), (1, ["red", "bike"]), (None, ["red"]), (2, None), (3, [])]
    texts = [(7, "red bike"), (7, "a bike, red"), (7, "red"), (None, "red bike"), (8, None)]
    matches, members = matching.sets_in_texts(
        spark.createDataFrame(items, "item_id int, terms array<string>"),
        spark.createDataFrame(texts, "text_id int, text string"),
    )
    sets = {tuple(r.terms): r.set_id for r in members.where("size(terms) > 0").collect()}
    got = sorted((r.set_id, r.text_id) for r in matches.collect())
    assert got == sorted([(sets["bike", "red"], 7)] * 2 + [(sets["red",], 7)] * 3)


def test_register_job(spark, write):
    frame = read_register(spark, write(HEADER, *REGISTER_LINES))
    listings = spark.createDataFrame(
        [
            ("a", "Blue halbrd bike"),
            ("b", "halberd bike, red"),
            ("c", "Fjord 7.4 DELTA in black"),
            ("d", "white halberd"),
        ],
        "listing_id string, text string",
    )
    rows = match_reported_items(frame, listings, 2013).collect()
    assert {(r.item_id, r.listing_id) for r in rows} == {("3", "a"), ("5", "c")}
    exact = match_reported_items(frame, listings, 2013, misspelt_makes=False).collect()
    assert {(r.item_id, r.listing_id) for r in exact} == {("5", "c")}


def test_what_an_advert_has_to_say(spark):
    rows = [("OTHER", "RIDGE", "BLU"), ("Halbrd CO.", None, "GRN"), ("Oak", "7", "XYZRED"), (None, None, None)]
    frame = spark.createDataFrame(rows, "make string, model string, color string")
    terms = frame.select(register.search_terms(F.col("make"), F.col("model"), F.col("color"))).collect()
    assert [sorted(r[0]) for r in terms] == [["blue", "ridge"], ["green", "halbrd"], ["7", "oak", "red"], []]
    own = frame.limit(3).select(register.search_terms(F.col("make"), F.col("model"), F.col("color"), {"XYZ": "teal"}))
    assert sorted(own.collect()[2][0]) == ["7", "oak", "teal"]

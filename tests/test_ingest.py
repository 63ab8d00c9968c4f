import json
from datetime import date

import pytest

from tenurekit.columns import COMPLIMENTS, SINCE
from tenurekit.operators.quality import require_unique
from tenurekit.sources import ndjson


def write(path, records):
    path.write_text("\n".join(json.dumps(r) for r in records))
    return str(path)


@pytest.fixture
def paths(tmp_path):
    business = [
        {"business_id": "b1", "name": "One", "stars": 4.5, "review_count": 7, "is_open": 1,
         "latitude": 1.25, "longitude": -3.5, "categories": "Bars, RESTAURANTS", "extra": [1]},
        {"business_id": "b2", "name": "Two", "is_open": 0, "categories": "restaurants"},
        {"business_id": "b3", "name": "Three", "categories": "Shopping"},
        {"business_id": "b4", "name": "Four", "categories": None},
    ]
    user = [
        {"user_id": f"u{i}", SINCE: "2012-01-01 10:00:00", "average_stars": 3.456,
         "review_count": 3, "fans": 1, **{c: 1 for c in COMPLIMENTS}, "friends": f, "elite": e}
        for i, (f, e) in enumerate(
            [(None, None), ("", ""), (" ", "2018,2019"), ("a", "2018,20,20"), ("a, b", "x"),
             ("a,,b", "2017"), ("c", "")]
        )
    ]
    review = [
        {"review_id": f"r{i}", "user_id": "u1", "business_id": b, "stars": 4.0,
         "date": "2019-02-03 04:05:06", "text": "fine", "useful": 1, "funny": 0, "cool": -1}
        for i, b in enumerate(["b1", "b2", "b3", "b9"])
    ]
    tip = [
        {"user_id": u, "business_id": "b1", "text": t, "date": "2019-02-03", "compliment_count": 0}
        for u, t in [("u2", "z"), ("u1", "y"), ("u1", "x")]
    ]
    return {
        "business": write(tmp_path / "business.json", business),
        "user": write(tmp_path / "user.json", user),
        "review": write(tmp_path / "review.json", review),
        "tip": write(tmp_path / "tip.json", tip),
    }


def test_businesses(spark, paths, rows):
    found = ndjson.scan_businesses(spark, paths["business"], "Restaurants")
    assert rows(found, "business_id", "is_open") == [("b1", True), ("b2", False)]
    first = found.filter("business_id = 'b1'").first()
    assert (float(first.stars), first.review_count, first.latitude) == (4.5, 7, 1.25)
    assert dict(found.dtypes)["stars"] == "decimal(3,2)"


def test_open_flag_is_null_when_absent(spark, tmp_path):
    path = write(tmp_path / "b.json", [{"business_id": "b", "categories": "restaurants"}])
    assert ndjson.scan_businesses(spark, path, "Restaurants").first().is_open is None


def test_all_tables(spark, paths, rows):
    tables = ndjson.load_tables(spark, paths, "Restaurants")
    assert rows(tables["user_friends"]) == [
        ("u3", "a"), ("u4", "a"), ("u4", "b"), ("u5", "a"), ("u5", "b"), ("u6", "c")
    ]
    assert rows(tables["user_elite_years"]) == [
        ("u2", 2018), ("u2", 2019), ("u3", 2018), ("u5", 2017)
    ]
    assert rows(tables["reviews"], "review_id", "stars", "date") == [
        ("r0", 4, date(2019, 2, 3)), ("r1", 4, date(2019, 2, 3))
    ]
    assert rows(tables["tips"], "tip_id", "user_id", "text") == [
        (1, "u1", "x"), (2, "u1", "y"), (3, "u2", "z")
    ]
    assert "friends_json" not in tables["users"].columns
    assert float(tables["users"].first().average_stars) == 3.46


def test_repeated_pair_is_not_a_key(spark, tmp_path):
    path = write(tmp_path / "u.json", [{"user_id": "u", "friends": "a, a", "elite": "2018,2018"}])
    users = ndjson.scan_users(spark, path)
    for pairs, keys in (
        (ndjson.user_friends(users), ["user_id", "friend_id"]),
        (ndjson.user_elite_years(users), ["user_id", "elite_year"]),
    ):
        with pytest.raises(ValueError):
            require_unique(pairs, keys, "pairs")


def test_bad_input_fails(spark, tmp_path):
    broken = tmp_path / "broken.json"
    broken.write_text('{"business_id": "b1", "categories": "Restaurants"\n')
    with pytest.raises(Exception):
        ndjson.scan_businesses(spark, str(broken), "Restaurants").collect()
    wrong = write(tmp_path / "wrong.json", [{"user_id": "u", "fans": "many"}])
    with pytest.raises(Exception):
        ndjson.scan_users(spark, wrong).collect()


def test_numbers_are_rounded_half_away_from_zero(spark, rows):
    texts = spark.createDataFrame([("4.0",), ("2.5",), ("-2.5",), ("7",), (None,)], "t string")
    found = texts.select(ndjson.whole_number(texts.t).alias("n"))
    assert rows(found) == sorted([(4,), (3,), (-3,), (7,), (None,)], key=repr)


def test_bad_lines_are_set_aside_and_counts_add_up(spark, paths, tmp_path, rows):
    with open(paths["review"], "a") as file:
        file.write('\n{"review_id": "r9", "user_id": "u1", "business_id": "b1", "date": "2019-0')
        file.write('\n{"review_id": "r10", "user_id": "u1", "business_id": "b1", "date": "once", "stars": 4}')
        file.write('\n{"review_id": "r11", "user_id": "u1", "business_id": "b2", "date": "2019-02-05", "stars": 3}\n\n')
    with open(paths["user"], "a") as file:
        file.write('\n{"user_id": "u99", "fans": "many"}\nnot even close')
    with pytest.raises(Exception):
        ndjson.load_tables(spark, paths, "Restaurants")["reviews"].collect()
    aside = ndjson.SetAside(str(tmp_path / "aside"))
    tables = ndjson.load_tables(spark, paths, "Restaurants", aside)
    assert rows(tables["reviews"], "review_id") == [("r0",), ("r1",), ("r11",)]
    assert "u99" not in {r.user_id for r in tables["users"].collect()}
    files = [paths["review"], paths["user"]]
    assert rows(aside.line_counts(spark, files)) == [("review.json", 7, 5, 2), ("user.json", 9, 7, 2)]
    bad = rows(aside.bad_lines(spark, files), "file", "reason")
    assert bad == [("review.json", "date"), ("review.json", "not JSON"), ("user.json", "fans"), ("user.json", "not JSON")]
    lines = {r.line for r in aside.bad_lines(spark, files).collect()}
    assert "not even close" in lines and any('"date":"once"' in x for x in lines)


def test_a_category_has_no_wildcards(spark, tmp_path):
    path = write(tmp_path / "b.json", [{"business_id": c, "categories": c} for c in ("100% Organic", "1000 Organic", "a_b", "aXb")])
    assert [r.business_id for r in ndjson.scan_businesses(spark, path, "100% organic").collect()] == ["100% Organic"]
    assert [r.business_id for r in ndjson.scan_businesses(spark, path, "A_B").collect()] == ["a_b"]

from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statwright.functions import categories, dates, foreign, merchants, money


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r["y"] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_amounts(spark):
    cases = {"1,234.56": 123456, "1.234,56": 123456, "(12.00)": 1200, "12,50": 1250, "1,234": 123400, "1.234": 123, "-5": 500, "5-": 500, "$5.00 CR": 500, "abc": None, "": None, "1.2.3": None, ".": None, "1.115": 112, "£1,000": 100000}
    assert column(spark, list(cases), lambda c: money.cents(money.magnitude(c))) == list(cases.values())
    signs = {"(1.00)": True, "-1": True, "1-": True, "1": False, "1.00 DR": False}
    assert column(spark, list(signs), money.marked_negative) == list(signs.values())


def test_direction_words(spark):
    assert column(spark, ["DR", "Credit.", "w", "deposit", "x", None], money.direction_word) == [-1, 1, -1, 1, None, None]


def plan(spark, values, hint=None, explicit=None):
    rows = spark.createDataFrame([("f", v, hint, explicit) for v in values], "file string, raw string, hint boolean, explicit string")
    r = dates.date_plans(rows).first()
    return r["fmt"], r["day_first"], r["confidence"]


@pytest.mark.parametrize(("values", "hint", "want"), [
    (["2024-01-31", "2024-02-01 10:30"], None, ("%Y-%m-%d", None, 1.0)),
    (["31/01/2024", "01/02/2024"], None, ("%d/%m/%Y", True, 1.0)),
    (["01/31/2024", "02/01/2024"], None, ("%m/%d/%Y", False, 1.0)),
    (["01/02/2024", "02/03/2024"], None, ("%m/%d/%Y", False, 0.5)),
    (["01/02/2024", "02/03/2024"], True, ("%d/%m/%Y", True, 0.7)),
    (["01/02/2024", "02/02/2024", "03/02/2024", "11/02/2024"], None, ("%d/%m/%Y", True, 0.8)),
    (["5 Jan 2024"], None, ("%d %b %Y", True, 1.0)),
    (["01/02/2024", "garbage"], None, (None, None, None)),
])
def test_date_plans(spark, values, hint, want):
    assert plan(spark, values, hint) == want


def test_two_digit_years(spark):
    assert column(spark, ["13/02/24", "13/02/70", "1/1/2024"], lambda c: dates.parsed(c, "%d/%m/%y")) == [date(2024, 2, 13), date(1970, 2, 13), None]


NAMES = {
    "SQ *BLUE BOTTLE #4412 OAKLAND CA 05/14": "Blue Bottle", "TST* SWEETGREEN 0184 NEW YORK NY": "Sweetgreen", "AMZN Mktp US*2H4XY9DK3": "Amazon", "GglPay TST* THE CAFE": "The Cafe",
    "PADARIA SAO PAULO BR": "Padaria", "TRADER JOE'S #182 SAN JOSE CA": "Trader Joe's", "CAFE DE PARIS LONDON GB": "Cafe de Paris", "HOTEL SOL RIO DE JANEIRO BR": "Hotel Sol", "uber trip 1": "Uber", "UBER EATS 1": "Uber Eats", "PG&E": "PG&E", "": "Unknown", None: "Unknown",
}


def test_merchant_names(spark):
    assert column(spark, list(NAMES), merchants.normalize_merchant) == list(NAMES.values())


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ABCDE '*#&-/12 ", max_size=25), min_size=20, max_size=40))
def test_merchant_names_are_stable(spark, raws):
    """Prefixes and junk do not come back: a name's name is never empty, and equal inputs give equal names."""
    out = column(spark, [*raws, *raws], merchants.normalize_merchant)
    assert all(out) and out[: len(raws)] == out[len(raws) :]


def test_foreign_details(spark):
    got = column(spark, ["X SAO PAULO BR 125.00 BRL", "INR 1,250.00 y", "Sushi 1250 JPY", "R$ 10,50", "12.00 mexican peso", "LLC 12.00 USA", "0.00 BRL", None], foreign.foreign_amount)
    assert [r and tuple(r) for r in got] == [(12500, "BRL"), (125000, "INR"), (125000, "JPY"), (1050, "BRL"), (1200, "MXN"), None, None, None]
    assert column(spark, ["Exchange Rate 5.1415", "@ 2", "rate 0", "x"], foreign.fx_rate) == [5.1415, 2.0, None, None]
    assert column(spark, ["MUMBAI IN", "LONDON GB", "SAN JOSE COSTA RICA", "PARIS FRA", "OAKLAND CA", "x UK."], lambda c: foreign.country(c, F.lit(None).cast("string"))) == [None, "GB", "CR", "FR", None, "GB"]
    assert column(spark, ["MUMBAI IN"], lambda c: foreign.country(c, F.lit("INR"))) == ["IN"]
    assert column(spark, ["Foreign Transaction Fee", "INTL SERVICE FEE", "fx fee", "coffee"], foreign.is_foreign_fee) == [True, True, True, False]
    assert column(spark, ["INDIANAPOLIS IN", "LONDON GB", ""], foreign.ambiguous_code) == ["IN", None, None]


def test_categories_first_match_and_user_rules(spark):
    user = categories.rules_from({"categories": [{"category": "Mine", "match": ["blue", "["]}, {"match": ["x"]}, 3]})
    assert [r.pattern for r in user] == ["blue"]
    names = ["Blue Bottle", "Netflix", "Parent Co", "Nothing"]
    assert column(spark, names, lambda c: categories.categorize(c, c)) == ["Dining", "Subscriptions", "Rent & Mortgage", "Uncategorized"]
    assert column(spark, names, lambda c: categories.categorize(c, c, user + categories.BUILTIN))[0] == "Mine"

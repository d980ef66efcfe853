from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from statwright.operators import ledger as lg
from statwright.operators import questions as q
from statwright.operators import recurring as rec
from statwright.operators import trips as tr

COLUMNS = "id string, account string, posted_on date, amount_cents bigint, merchant string, category string, raw_description string, country string, is_fee boolean, original_currency string, original_amount_cents bigint, fx_rate double"


def row(i, day, cents, merchant="M", category="C", text=None, country=None, fee=False, currency=None, rate=None):
    return (f"{i:04}", "A", date.fromisoformat(day), cents, merchant, category, text or merchant, country, fee, currency, int(abs(cents) * rate) if rate else None, rate)


def test_limits():
    assert [q.clamp(x) for x in (None, 0, -3, 7, 900)] == [50, 50, 50, 7, 200]


def test_questions_on_a_small_ledger(spark):
    rows = [row(1, "2026-01-01", -100, "A", "X"), row(2, "2026-01-02", -300, "B", "Y"), row(3, "2026-02-01", 900, "P", "Income"), row(4, "2026-02-03", -100, "A", "Z", country="BR"), row(5, "2026-02-04", -10, "fee", "F", fee=True)]
    df = spark.createDataFrame(rows, COLUMNS)
    assert [(r["category"], r["spent_cents"], r["share"]) for r in q.spending_by_category(df, limit=2).collect()] == [("Y", 300, 58.8), ("X", 100, 19.6)]
    assert q.spending_by_category(df, limit=2).first()["matching"] == 4
    assert {r["merchant"]: r["category"] for r in q.spending_by_merchant(df).collect()}["A"] == "Z"
    assert [r["code"] for r in q.spending_by_country(df).collect()] == ["", "BR", "__fee__"]
    change = {r["category"]: (r["change_cents"], r["percent_change"]) for r in q.compare_periods(df, ("2026-01-01", "2026-01-31"), ("2026-02-01", "2026-02-28")).collect()}
    assert change["X"] == (-100, -100.0) and change["Z"] == (100, None)
    with pytest.raises(ValueError):
        q.between(df, "not a day")
    empty = df.where("false")
    assert q.overview(empty).first()["out_cents"] == 0
    assert q.spending_by_category(empty).count() == 0


def test_overlapping_exports_keep_the_larger_multiplicity(spark):
    cells = [("a.csv", k, "X  y") for k in (1, 2)] + [("b.csv", k, " x Y") for k in (1, 2, 3)]
    rows = spark.createDataFrame([("A", date(2026, 1, 1), -450, t, f, k) for f, k, t in cells], "account string, posted_on date, amount_cents bigint, raw_description string, source_file string, source_row int")
    ided = lg.with_id(lg.with_occurrence(rows))
    assert lg.first_of_each_id(ided).count() == 3
    assert lg.insert_ignore(ided.where("source_file = 'a.csv'"), ided).count() == 1
    assert lg.insert_ignore(ided, ided).count() == 0


def series(spark, **merchants):
    rows = [(m, d, i, c, "C") for m, xs in merchants.items() for i, (d, c) in enumerate(xs)]
    return spark.createDataFrame(rows, "merchant string, day date, ord int, cents bigint, category string")


def every(days, n, *cents, start=date(2025, 1, 1)):
    return [(start + timedelta(days=round(days * k)), -cents[k % len(cents)]) for k in range(n)]


def test_subscriptions(spark):
    store = every(30.44, 10, 299, start=date(2025, 1, 3)) + every(30.44, 10, 1099, start=date(2025, 1, 17))
    noise = [(date(2025, 1, 1) + timedelta(days=d), -c) for d, c in ((0, 500), (3, 9000), (50, 120), (51, 7000), (130, 10))]
    rows = series(spark, Video=every(30.44, 12, 1599), Gone=every(30.44, 6, 2499), Yearly=every(365, 3, 8400, start=date(2023, 12, 20)), Store=store, Noise=noise)
    got = {(r["merchant"], r["typical_cents"]): (r["cadence"], r["status"]) for r in rec.subscriptions(rows, date(2025, 12, 20)).collect()}
    assert got == {("Video", 1599): ("monthly", "active"), ("Gone", 2499): ("monthly", "likely_cancelled"), ("Yearly", 8400): ("annual", "active"), ("Store", 299): ("monthly", "likely_cancelled"), ("Store", 1099): ("monthly", "overdue")}


def test_price_points(spark):
    rows = series(spark, M=[(date(2025, 1, k + 1), -c) for k, c in enumerate((299, 300, 1099, 1100, 1130))])
    got = {(r["cents"], r["cluster"]) for r in rec.with_clusters(rows).collect()}
    assert got == {(-299, 1), (-300, 1), (-1099, 2), (-1100, 2), (-1130, 3)}


def test_trips_and_conversions(spark):
    abroad = [row(k, f"2026-09-{12 + k}", -1000 * (k + 1), f"R{k}", country="BR", currency="BRL", rate=5.0, text=f"R{k} SAO PAULO BR") for k in range(6)]
    fees = [row(20 + k, f"2026-09-{13 + k}", -27 * (k + 1), "fee", fee=True) for k in range(5)]
    bare = [row(40, "2026-09-15", -8421, "Shop", text="SHOP RIO BR", country="BR"), row(41, "2026-09-16", -227, "fee", fee=True)]
    other = [row(50, "2026-06-01", -900, "Book", country="GB", text="BOOK LONDON GB"), row(51, "2026-09-14", -500, "Home", text="HOME OAKLAND CA")]
    df = spark.createDataFrame(abroad + fees + bare + other, COLUMNS).withColumn("scope", F.lit(0))
    trip = tr.trips(df, "scope").collect()
    assert len(trip) == 1 and (trip[0]["transactions"], trip[0]["countries"], trip[0]["currencies"]) == (7, ["BR"], ["BRL"])
    assert trip[0]["top_merchants"][0] == "Shop" and len(trip[0]["top_merchants"]) == 5
    found = tr.suspected_conversions(df, "scope").collect()
    assert [(r["id"], r["country"], r["siblings"]) for r in found] == [("0040", "BR", 6)]
    with pytest.raises(ValueError):
        tr.suspected_conversions(df, "scope", gap_days=3)
    assert tr.trips(df.where("false"), "scope").count() == 0
    assert tr.rate_availability(df).first()["checkable_currencies"] == "BRL"
    assert {r["code"]: r["n"] for r in tr.unresolved_locations(df).collect()} == {"CA": 1}

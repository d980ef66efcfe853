"""Trips abroad, their costs, and charges that look converted at the till.

``scope`` is the column whose rows are one traveller's; trips of different
scopes are apart, so the work is spread by it. Without one, a constant scope
gives a single traveller's trips.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statwright.functions.fixed import FEE_DAYS, FEE_TOLERANCE, RATES_TO_COMPARE, SIBLINGS, TRIP_DAYS, TRIP_GAP_DAYS, TRIP_MERCHANTS, TRIP_ROWS
from statwright.functions.foreign import ambiguous_code, country

#: Merchants that a trip names.
TOP = 5
FOREIGN = "(country IS NOT NULL OR original_currency IS NOT NULL)"


def size() -> Column:
    return F.abs("amount_cents")


def trip_days(ledger: DataFrame, scope: str, gap_days: int = TRIP_GAP_DAYS) -> DataFrame:
    """(scope, posted_on, trip) of the days with foreign rows; a longer gap than ``gap_days`` begins another trip.

    The rows are reduced to distinct days before they meet, so what a window orders
    is a calendar, however many rows a scope has.
    """
    by = Window.partitionBy(scope).orderBy("posted_on")
    days = ledger.where(FOREIGN).select(scope, "posted_on").distinct()
    opens = F.coalesce(F.datediff("posted_on", F.lag("posted_on").over(by)) > gap_days, F.lit(True)).cast("int")
    return days.withColumn("opens", opens).withColumn("trip", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def clusters(ledger: DataFrame, scope: str, gap_days: int = TRIP_GAP_DAYS) -> DataFrame:
    """Foreign rows with ``trip``, a running number within the scope."""
    return ledger.where(FOREIGN).join(trip_days(ledger, scope, gap_days), [scope, "posted_on"])


def tagged(ledger: DataFrame, scope: str, gap_days: int = TRIP_GAP_DAYS) -> DataFrame:
    """All rows, foreign or not, on the days from a trip's first to its last one, with (trip, start, end)."""
    spans = trip_days(ledger, scope, gap_days).groupBy(scope, "trip").agg(F.min("posted_on").alias("start"), F.max("posted_on").alias("end"))
    return ledger.join(spans.select(scope, "trip", "start", "end", F.explode(F.sequence("start", "end", F.expr("interval 1 day"))).alias("posted_on")), [scope, "posted_on"])


def _name() -> Column:
    return F.when(F.coalesce("merchant", F.lit("")) == "", "Unknown").otherwise(F.col("merchant"))


def trips(ledger: DataFrame, scope: str, gap_days: int = TRIP_GAP_DAYS, min_transactions: int = TRIP_ROWS) -> DataFrame:
    """(scope, trip, start, end, ndays, transactions, countries, currencies, spend_cents, fee_cents, top_merchants), accepted trips only.

    Rows are tagged once and summed by merchant, and merchants by trip.
    """
    return _rolled(tagged(ledger, scope, gap_days), scope, min_transactions).drop("siblings", "detailed_cents")


def _rolled(rows: DataFrame, scope: str, min_transactions: int = TRIP_ROWS) -> DataFrame:
    """Accepted trips from tagged rows, with siblings and detailed_cents: charges that state their foreign amount."""
    keys = [scope, "trip", "start", "end"]
    foreign, spent = F.expr(FOREIGN), F.col("amount_cents") < 0
    charge = ~F.coalesce("is_fee", F.lit(False)) & spent & F.col("original_currency").isNotNull()
    total = lambda c: F.sum(F.when(c, size()))
    by_merchant = rows.groupBy(*keys, _name().alias("merchant_name")).agg(
        F.count_if(foreign).alias("n"), F.max(foreign & (F.col("merchant") != "")).alias("named"), total(foreign & spent).alias("spent_cents"), F.min(F.when(foreign & spent, F.struct("posted_on", "id"))).alias("seen"),
        F.collect_set(F.when(foreign, F.col("country"))).alias("countries"), F.collect_set(F.when(foreign, F.col("original_currency"))).alias("currencies"),
        total(F.col("is_fee")).alias("fee_cents"), F.count_if(charge).alias("siblings"), total(charge).alias("detailed_cents"),
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("spent_cents"), "seen"))
    first = F.when((F.col("rank") <= TOP) & F.col("spent_cents").isNotNull(), F.struct("rank", "merchant_name"))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    sums = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    rolled = by_merchant.withColumn("rank", rank).groupBy(*keys).agg(
        F.sum("n").alias("transactions"), F.count_if("named").alias("merchants"), union("countries"), union("currencies"), F.coalesce(F.sum("spent_cents"), F.lit(0)).alias("spend_cents"),
        sums("fee_cents"), sums("siblings"), sums("detailed_cents"), F.transform(F.array_sort(F.collect_list(first)), lambda x: x["merchant_name"]).alias("top_merchants"),
    ).withColumn("ndays", F.datediff("end", "start") + 1)
    kept = rolled.where((F.col("transactions") >= min_transactions) & (F.col("merchants") >= TRIP_MERCHANTS) & (F.col("ndays") >= TRIP_DAYS))
    return kept.select(*keys, "ndays", "transactions", "countries", "currencies", "spend_cents", "fee_cents", "top_merchants", "siblings", "detailed_cents")


def top_merchants(rows: DataFrame, scope: str, n: int = TOP) -> DataFrame:
    """(scope, trip, rank, merchant, spent_cents): by spending, of equal ones the earliest."""
    spent = rows.where("amount_cents < 0").groupBy(scope, "trip", _name().alias("merchant")).agg(F.sum(size()).alias("spent_cents"), F.min(F.struct("posted_on", "id")).alias("seen"))
    rank = F.row_number().over(Window.partitionBy(scope, "trip").orderBy(F.desc("spent_cents"), "seen"))
    return spent.withColumn("rank", rank).where(F.col("rank") <= n).select(scope, "trip", "rank", "merchant", "spent_cents")


def during(rows: DataFrame, spans: DataFrame, scope: str, slack: int = 0) -> DataFrame:
    """Rows within the days of their scope's spans (and ``slack`` around), with (trip, start, end).

    A range join as an equi join: both sides are keyed by month, so a hot scope
    is spread over its months rather than compared with all its spans.
    """
    first, last = F.date_sub("start", slack), F.date_add("end", slack)
    months = spans.select(scope, "trip", "start", "end", F.explode(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))).alias("_month"))
    keyed = rows.withColumn("_month", F.trunc("posted_on", "month"))
    return keyed.join(months, [scope, "_month"]).where(F.col("posted_on").between(first, last)).drop("_month")


def looks_foreign(descriptor: Column, countries: Column) -> Column:
    """The country that a descriptor names; an ambiguous code counts only among the trip's."""
    code = ambiguous_code(descriptor)
    return F.coalesce(country(descriptor, F.lit(None).cast("string")), F.when(F.array_contains(countries, code), code))


def fee_candidates(ledger: DataFrame, charges: DataFrame, scope: str) -> DataFrame:
    """(scope, charge_id, fee_id, gap, actual_cents): fees within three days of a charge (scope, id, posted_on).

    Keyed by the fee's day: a charge looks up seven days, so no row meets all of a scope's fees.
    """
    days = charges.select(scope, F.col("id").alias("charge_id"), F.col("posted_on").alias("day"), F.explode(F.sequence(F.date_sub("posted_on", FEE_DAYS), F.date_add("posted_on", FEE_DAYS), F.expr("interval 1 day"))).alias("posted_on"))
    fees = ledger.where("is_fee").select(scope, "posted_on", F.col("id").alias("fee_id"), size().alias("actual_cents"))
    return days.join(fees, [scope, "posted_on"]).select(scope, "charge_id", "fee_id", F.abs(F.datediff("posted_on", "day")).alias("gap"), "actual_cents")


def suspected_conversions(ledger: DataFrame, scope: str, **options: int) -> DataFrame:
    """(scope, trip, id, merchant, posted_on, billed_cents, country, fee_observed, siblings, confidence).

    Charges of a trip without conversion detail at a foreign place, where three
    or more siblings have theirs. Fees are claimed one by one in the order of the
    charges, which a fold per trip does; trips lie too far apart to share a fee. The
    fold holds one trip's charges without detail and the fees within three days of each.
    """
    gap_days = options.get("gap_days", TRIP_GAP_DAYS)
    if gap_days < 2 * FEE_DAYS:
        raise ValueError("trips must be further apart than both fee windows")
    rows = tagged(ledger, scope, gap_days)
    about = _rolled(rows, scope, options.get("min_transactions", TRIP_ROWS)).where(F.col("siblings") >= SIBLINGS).select(scope, "trip", "countries", "fee_cents", "siblings", "detailed_cents")
    undetailed = rows.where(~F.coalesce("is_fee", F.lit(False)) & (F.col("amount_cents") < 0) & F.col("original_currency").isNull())
    name = F.coalesce("raw_description", "merchant", F.lit(""))
    bare = undetailed.drop("start", "end").join(about, [scope, "trip"]).withColumn("place", looks_foreign(name, F.col("countries"))).where("place IS NOT NULL")
    charges = bare.select(scope, "trip", "id", "posted_on", "merchant", size().alias("billed_cents"), F.col("place").alias("country"), "siblings", (F.col("fee_cents") / F.col("detailed_cents")).alias("rate"))
    near = fee_candidates(ledger, charges.select(scope, "id", "posted_on"), scope).withColumnRenamed("charge_id", "id")
    expected = F.col("billed_cents") * F.col("rate")
    pairs = charges.join(near, [scope, "id"], "left").withColumn("error", F.abs(F.col("actual_cents") - expected))
    usable = F.col("fee_id").isNotNull() & (F.col("rate") > 0) & (F.col("error") <= FEE_TOLERANCE * expected)
    pairs = pairs.withColumn("fee_id", F.when(usable, F.col("fee_id"))).withColumn("error", F.when(usable, F.col("error")))
    schema = charges.withColumn("fee_observed", F.lit(True)).schema

    def claim(batch: pd.DataFrame) -> pd.DataFrame:
        taken: set = set()
        out = []
        for _, rows in batch.sort_values(["posted_on", "id"]).groupby(["posted_on", "id"], sort=True):
            free = rows[rows["fee_id"].notna() & ~rows["fee_id"].isin(taken)].sort_values(["error", "fee_id"])
            if len(free):
                taken.add(free["fee_id"].iloc[0])
            out.append(rows.iloc[:1].assign(fee_observed=bool(len(free))))
        return pd.concat(out)[[f.name for f in schema]]

    judged = pairs.groupBy(scope, "trip").applyInPandas(claim, schema)
    sure = F.round(F.lit(0.6) + F.when(F.col("fee_observed"), 0.25).otherwise(0.0) + F.when(F.col("siblings") >= 2 * SIBLINGS, 0.1).otherwise(0.0), 2)
    return judged.drop("rate").withColumn("confidence", sure)


def currency_summary(ledger: DataFrame) -> DataFrame:
    """(original_currency, transactions, billed_cents, typical_rate) of foreign spending."""
    rows = ledger.where((F.col("amount_cents") < 0) & F.col("original_currency").isNotNull())
    return rows.groupBy("original_currency").agg(F.count("*").alias("transactions"), F.sum(size()).alias("billed_cents"), F.round(F.median(F.when(F.col("fx_rate") != 0, F.col("fx_rate"))), 4).alias("typical_rate"))


def rate_availability(ledger: DataFrame) -> DataFrame:
    """One row: foreign rows that are no fees, those with amount and rate, and the currencies with enough rates to compare."""
    foreign = ledger.where(F.expr(FOREIGN) & ~F.coalesce("is_fee", F.lit(False)))
    rated = F.coalesce((F.col("fx_rate") != 0) & (F.col("original_amount_cents") != 0), F.lit(False))
    by = foreign.groupBy("original_currency").agg(F.count("*").alias("n"), F.count_if(rated).alias("with_rate"))
    enough = F.when((F.col("with_rate") >= RATES_TO_COMPARE) & F.col("original_currency").isNotNull(), F.col("original_currency"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("foreign_transactions"), F.coalesce(F.sum("with_rate"), F.lit(0)).alias("with_original_amount_and_rate"), F.array_join(F.array_sort(F.collect_set(enough)), ",").alias("checkable_currencies"))


def unresolved_locations(ledger: DataFrame) -> DataFrame:
    """(code, n): domestic rows whose trailing code is also a country."""
    code = ambiguous_code(F.coalesce("raw_description", "merchant", F.lit("")))
    return ledger.where(f"NOT {FOREIGN}").select(code.alias("code")).where("code IS NOT NULL").groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code")


def foreign_costs(ledger: DataFrame) -> DataFrame:
    """One row: foreign spending, fees and their share; in one pass."""
    fee, spend = F.sum(F.when(F.col("is_fee"), size())), F.sum(F.when(F.expr(FOREIGN) & (F.col("amount_cents") < 0), size()))
    one = ledger.agg(F.coalesce(fee, F.lit(0)).alias("fee_cents"), F.coalesce(spend, F.lit(0)).alias("spend_cents"), F.count_if("is_fee").alias("fee_count"))
    return one.withColumn("effective_fee_percent", F.when(F.col("spend_cents") != 0, F.round(F.col("fee_cents") / F.col("spend_cents") * 100, 2)).otherwise(0.0))

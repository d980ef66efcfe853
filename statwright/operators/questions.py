"""The questions asked of a ledger, each a DataFrame from a DataFrame.

A ledger has (id, account, posted_on, amount_cents, merchant, category,
raw_description, country, is_fee, ...); cents are signed, negative is money out.
Every order before a limit has a unique tie-break, and every limited result
carries the count that tells whether it was cut: ``matching`` is the number of
groups before the limit, summed over the buckets from which the first ones are
taken (no second scan). Only ``list_transactions``, whose rows are not grouped,
counts by a scan of its own, which reads the filtered columns.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statwright.functions.fixed import UNCATEGORIZED
from statwright.functions.foreign import country_label

DEFAULT_LIMIT, MAX_LIMIT = 50, 200
SPENT, RECEIVED = "amount_cents < 0", "amount_cents > 0"


def clamp(limit: int | None) -> int:
    """The default for none, zero or less; the maximum at most."""
    return DEFAULT_LIMIT if not limit or limit < 1 else min(int(limit), MAX_LIMIT)


def between(ledger: DataFrame, start: str | date | None = None, end: str | date | None = None) -> DataFrame:
    """Both days included; a malformed day is an error rather than a text comparison."""
    for day, keep in ((start, lambda d: F.col("posted_on") >= d), (end, lambda d: F.col("posted_on") <= d)):
        if day:
            ledger = ledger.where(keep(F.lit(day if isinstance(day, date) else date.fromisoformat(day))))
    return ledger


def money(cents: Column) -> Column:
    return F.round(F.coalesce(cents, F.lit(0)) / 100, 2)


def _out() -> Column:
    return F.sum(F.when(F.expr(SPENT), -F.col("amount_cents")).otherwise(0))


def _in() -> Column:
    return F.sum(F.when(F.expr(RECEIVED), F.col("amount_cents")).otherwise(0))


#: Buckets of groups that are ordered apart, so that no task orders all groups.
BUCKETS = 64


def _top(grouped: DataFrame, key: str, limit: int | None, order: list[Column], **totals: str) -> DataFrame:
    """The first rows in an order, each with the number of groups (``matching``) and totals of columns over all groups.

    One pass: each bucket of groups gives its first rows, its count and its totals,
    and these few rows are ordered and summed again.
    """
    n = clamp(limit)
    sums = {"matching": F.lit(1)} | {name: F.col(c) for name, c in totals.items()}
    bucket = Window.partitionBy("_bucket")
    apart = grouped.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS))).withColumn("_nth", F.row_number().over(bucket.orderBy(*order)))
    apart = apart.withColumns({name: F.sum(c).over(bucket) for name, c in sums.items()}).where(F.col("_nth") <= n)
    every = Window.partitionBy()
    whole = apart.withColumns({name: F.sum(F.when(F.col("_nth") == 1, F.col(name))).over(every) for name in sums})
    return whole.orderBy(*order).limit(n).drop("_bucket", "_nth")


def overview(ledger: DataFrame) -> DataFrame:
    """One row: count, first and last day, cents out, in and net, and how many are uncategorized."""
    return ledger.agg(
        F.count("*").alias("transaction_count"), F.min("posted_on").alias("first"), F.max("posted_on").alias("last"),
        F.coalesce(_out(), F.lit(0)).alias("out_cents"), F.coalesce(_in(), F.lit(0)).alias("in_cents"),
        F.count_if(F.col("category") == UNCATEGORIZED).alias("uncategorized_count"),
    ).withColumn("net_cents", F.col("in_cents") - F.col("out_cents"))


def account_activity(accounts: DataFrame, ledger: DataFrame) -> DataFrame:
    """(account, transactions, first, last) of every account, those without rows included. The ledger is aggregated before the join."""
    used = ledger.groupBy("account").agg(F.count("id").alias("n"), F.min("posted_on").alias("first"), F.max("posted_on").alias("last"))
    return accounts.select("account").distinct().join(used, "account", "left").select("account", F.coalesce("n", F.lit(0)).alias("transactions"), "first", "last").orderBy(F.desc("transactions"), "account")


def spending_by_category(ledger: DataFrame, start=None, end=None, limit: int | None = None) -> DataFrame:
    spent = between(ledger, start, end).where(SPENT)
    grouped = spent.groupBy("category").agg(F.sum(-F.col("amount_cents")).alias("spent_cents"), F.count("*").alias("transactions"))
    top = _top(grouped, "category", limit, [F.desc("spent_cents"), F.asc("category")], all_cents="spent_cents")
    return top.select("category", "spent_cents", "transactions", F.round(F.col("spent_cents") / F.col("all_cents") * 100, 1).alias("share"), "matching")


def spending_by_merchant(ledger: DataFrame, start=None, end=None, category: str | None = None, limit: int | None = None) -> DataFrame:
    """The category is that of the merchant's latest charge."""
    spent = between(ledger, start, end).where(SPENT)
    if category:
        spent = spent.where(F.col("category") == category)
    grouped = spent.groupBy("merchant").agg(
        F.max_by("category", F.struct("posted_on", "id")).alias("category"), F.sum(-F.col("amount_cents")).alias("spent_cents"),
        F.count("*").alias("transactions"), F.min("posted_on").alias("first"), F.max("posted_on").alias("last"),
    )
    return _top(grouped, "merchant", limit, [F.desc("spent_cents"), F.asc("merchant")]).select("merchant", "category", "spent_cents", "transactions", "first", "last", F.col("matching").alias("total_merchants"))


def monthly_summary(ledger: DataFrame, start=None, end=None, limit: int | None = None) -> DataFrame:
    """Newest month first; the average is over the months returned."""
    month = F.date_format("posted_on", "yyyy-MM").alias("month")
    grouped = between(ledger, start, end).groupBy(month).agg(_out().alias("spent_cents"), _in().alias("received_cents"), F.count("*").alias("transactions"))
    top = _top(grouped, "month", limit, [F.desc("month")]).withColumn("net_cents", F.col("received_cents") - F.col("spent_cents"))
    return top.withColumn("average_spend", F.round(F.avg("spent_cents").over(Window.partitionBy()) / 100, 2)).select("month", "spent_cents", "received_cents", "net_cents", "transactions", "average_spend", "matching")


def list_transactions(ledger: DataFrame, start=None, end=None, merchant: str | None = None, category: str | None = None, min_amount: float | None = None, max_amount: float | None = None, limit: int | None = None) -> DataFrame:
    """Rows, newest and largest first. In ``merchant``, ``%`` and ``_`` are wildcards; case does not count."""
    rows = between(ledger, start, end)
    size = F.abs("amount_cents")
    if merchant:
        rows = rows.where(F.col("merchant").ilike(f"%{merchant}%"))
    if category:
        rows = rows.where(F.col("category") == category)
    if min_amount is not None:
        rows = rows.where(size >= int(round(min_amount * 100)))
    if max_amount is not None:
        rows = rows.where(size <= int(round(max_amount * 100)))
    matching = rows.agg(F.count("*").alias("matching"))
    top = rows.orderBy(F.desc("posted_on"), size.desc(), "id").limit(clamp(limit)).join(F.broadcast(matching))
    return top.select("id", "posted_on", "merchant", "category", "amount_cents", F.substring("raw_description", 1, 80).alias("description"), "matching")


def top_uncategorized(ledger: DataFrame, limit: int | None = None) -> DataFrame:
    spent = ledger.where((F.col("category") == UNCATEGORIZED) & F.expr(SPENT))
    grouped = spent.groupBy("merchant").agg(F.sum(-F.col("amount_cents")).alias("spent_cents"), F.count("*").alias("transactions"), F.substring(F.max("raw_description"), 1, 80).alias("example"))
    return grouped.orderBy(F.desc("spent_cents"), "merchant").limit(clamp(limit))


def compare_periods(ledger: DataFrame, a: tuple, b: tuple, limit: int | None = None) -> DataFrame:
    """Category totals of two periods, which may overlap, in one pass; the largest change first."""
    day = lambda d: F.lit(d if isinstance(d, date) else date.fromisoformat(d))
    within = lambda p: F.col("posted_on").between(day(p[0]), day(p[1]))
    total = lambda p: F.sum(F.when(within(p), -F.col("amount_cents")).otherwise(0))
    grouped = ledger.where(F.expr(SPENT) & (within(a) | within(b))).groupBy("category").agg(total(a).alias("a_cents"), total(b).alias("b_cents"))
    change = F.col("b_cents") - F.col("a_cents")
    percent = F.when(F.col("a_cents") != 0, F.round(change / F.col("a_cents") * 100, 1))
    changes = grouped.withColumn("change_cents", change).withColumn("percent_change", percent)
    return _top(changes, "category", limit, [F.abs("change_cents").desc(), F.asc("category")], total_a_cents="a_cents", total_b_cents="b_cents")


def spending_by_country(ledger: DataFrame, start=None, end=None, limit: int | None = None) -> DataFrame:
    """Fees have a bucket of their own, and rows without country are at home, so the shares add up."""
    code = F.when(F.col("is_fee"), "__fee__").otherwise(F.coalesce("country", F.lit("")))
    spent = between(ledger, start, end).where(SPENT)
    grouped = spent.groupBy(code.alias("code")).agg(F.sum(-F.col("amount_cents")).alias("spent_cents"), F.count("*").alias("transactions"), F.min("posted_on").alias("first"), F.max("posted_on").alias("last"))
    top = _top(grouped, "code", limit, [F.desc("spent_cents"), F.asc("code")], all_cents="spent_cents")
    return top.select("code", country_label(F.col("code")).alias("country"), "spent_cents", "transactions", "first", "last", F.round(F.col("spent_cents") / F.col("all_cents") * 100, 1).alias("share"), "matching")


def distinct_merchants(ledger: DataFrame) -> DataFrame:
    return ledger.where(SPENT).agg(F.countDistinct("merchant").alias("merchants"))


def date_range(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count("*").alias("transactions"), F.min("posted_on").alias("first"), F.max("posted_on").alias("last"))

"""Recurring charges: cadence, coverage and amount statistics of a series, and which series are subscriptions.

A series is the rows of one ``key`` (columns day, cents, ord, category). All is
grouping and column math: gaps by ``lag``, cadence credit per gap, medians, and
the last three amounts from a sorted array of the series. Series of one merchant
stay together by the shuffle on the merchant, which every step shares.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statwright.functions.fixed import CADENCES, CLUSTER_LEAST, CLUSTER_POOL, CLUSTER_SHARE, CLUSTER_TOLERANCE, CV_CEILING, MIN_COVERAGE, MIN_REGULARITY, MIN_SPLIT_REGULARITY, SPLIT_BELOW_STABILITY


def credit(gap: Column, period: float, tolerance: float) -> Column:
    """1 for a gap near the period, 0.6 for one near two or three of them (with the root of that much more slack), else 0."""
    near = lambda k: F.abs(gap - k * period) <= tolerance * k**0.5
    return F.when(near(1), 1.0).when(near(2) | near(3), 0.6).otherwise(0.0)


def _placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with gap (days since the one before, null for none or the same day) and late (true for a series' last three); one sort a series."""
    by = Window.partitionBy(*keys).orderBy("day", "ord")
    gap = F.datediff("day", F.lag("day").over(by))
    return rows.withColumn("gap", F.when(gap > 0, gap)).withColumn("late", F.lead("ord", 3).over(by).isNull())


def _gap_aggregates() -> list[Column]:
    return [F.count("gap").alias("n_gaps"), F.median("gap").alias("median_gap"), *[F.avg(F.when(F.col("gap").isNotNull(), credit(F.col("gap"), p, t))).alias(f"fit_{name}") for name, p, t in CADENCES]]


def _amount_aggregates() -> list[Column]:
    """What the amounts of a series need, besides three values in constant space."""
    size, place = F.abs("cents"), F.struct("day", "ord")
    return [
        F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"), F.min(size).alias("min_cents"), F.max(size).alias("max_cents"),
        F.max_by("category", place).alias("category"), F.avg(size).alias("mean"), F.stddev_pop(size).alias("sd"), F.min_by(size.cast("double"), place).alias("x0"), F.max_by(size.cast("double"), place).alias("x1"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("late"), F.struct("day", "ord", size.cast("double").alias("x"))))), lambda s: s["x"]).alias("recent"),
    ]


def gap_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_gaps, median_gap, a credit for each cadence)."""
    return _placed(rows, keys).groupBy(*keys).agg(*_gap_aggregates()).where("n_gaps > 0")


def best_cadence(stats: DataFrame) -> DataFrame:
    """Adds cadence and regularity: the best credit, of equal ones the shortest period."""
    regularity = F.greatest(*[F.col(f"fit_{n}") for n, _, _ in CADENCES])
    name = F.coalesce(*[F.when(F.col(f"fit_{n}") == F.col("regularity"), n) for n, _, _ in CADENCES])
    return stats.withColumn("regularity", regularity).withColumn("cadence", name)


def _spread(xs: Column) -> Column:
    """The population's coefficient of variation of an array of doubles; 0 for a mean of 0 or one value."""
    n = F.size(xs)
    total = lambda ys: F.aggregate(ys, F.lit(0.0), lambda a, y: a + y)
    mean = total(xs) / n
    var = F.transform(F.array(mean), lambda m: total(F.transform(xs, lambda x: (x - m) * (x - m))) / n)[0]
    return F.when((mean == 0) | (n < 2), 0.0).otherwise(F.sqrt(var) / mean)


AMOUNTS = ["n", "first", "last", "min_cents", "max_cents", "typical_cents", "stability", "amount_varies", "price_changed", "category"]


def _amounts(grouped: DataFrame) -> DataFrame:
    """AMOUNTS from ``_amount_aggregates``, with the other columns kept."""
    middle = lambda r: F.when(F.size(r) % 2 == 1, F.get(F.sort_array(r), F.floor(F.size(r) / 2).cast("int"))).otherwise((F.get(r, 0) + F.get(r, 1)) / 2)
    overall = F.when((F.col("mean") == 0) | (F.col("n") < 2), 0.0).otherwise(F.col("sd") / F.col("mean"))
    stable = F.when(F.col("mean") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.least(F.col("overall"), F.col("recent_cv")) / CV_CEILING)))
    changed = F.when((F.col("mean") == 0) | (F.col("x0") == 0), False).otherwise(F.abs(F.col("x1") - F.col("x0")) / F.col("x0") > 0.05)
    told = grouped.withColumn("overall", overall).withColumn("recent_cv", _spread(F.col("recent")))
    told = told.withColumn("typical_cents", F.floor(middle(F.col("recent"))).cast("bigint")).withColumn("stability", stable).withColumn("amount_varies", (F.col("mean") != 0) & (F.col("overall") > 0.10)).withColumn("price_changed", changed)
    return told.drop("overall", "recent_cv", "recent", "mean", "sd", "x0", "x1")


def amount_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, first, last, min_cents, max_cents, typical_cents, stability, amount_varies, price_changed, category)."""
    return _amounts(_placed(rows, keys).groupBy(*keys).agg(*_amount_aggregates())).select(*keys, *AMOUNTS)


def scored(rows: DataFrame, keys: list[str], as_of: date, min_occurrences: int = 3) -> DataFrame:
    """Every series with enough rows and some gap, with its scores; ``periodic`` tells whether regularity and coverage suffice. One pass over the rows."""
    return _scored(_placed(rows, keys).groupBy(*keys).agg(*_amount_aggregates(), *_gap_aggregates()), keys, as_of, min_occurrences)


def _scored(grouped: DataFrame, keys: list[str], as_of: date, min_occurrences: int) -> DataFrame:
    fits = [f"fit_{n}" for n, _, _ in CADENCES]
    both = best_cadence(_amounts(grouped.where((F.col("n") >= min_occurrences) & (F.col("n_gaps") > 0)))).select(*keys, *AMOUNTS, "n_gaps", "median_gap", *fits, "regularity", "cadence")
    period = F.col("median_gap")
    coverage = F.least(F.lit(1.0), F.col("n") / (F.datediff("last", "first") / period + 1))
    confidence = 0.40 * F.col("regularity") + 0.25 * F.col("stability") + 0.20 * F.col("coverage") + 0.15 * F.least(F.lit(1.0), (F.col("n") - 2) / 4)
    overdue = F.datediff(F.lit(as_of), "expected_next")
    return (
        both.withColumn("coverage", coverage).withColumn("confidence", F.least(F.lit(1.0), confidence))
        .withColumn("expected_next", F.date_add("last", F.bround(period, 0).cast("int")))
        .withColumn("days_overdue", F.greatest(F.lit(0), overdue))
        .withColumn("status", F.when(overdue > 1.5 * period, "likely_cancelled").when(overdue > 0.5 * period, "overdue").otherwise("active"))
        .withColumn("annualized_cents", F.bround(F.col("typical_cents") * (F.lit(365.25) / period), 0).cast("bigint"))
        .withColumn("periodic", (F.col("regularity") >= MIN_REGULARITY) & (F.col("coverage") >= MIN_COVERAGE))
    )


def price_points(rows: DataFrame, key: str = "merchant") -> DataFrame:
    """(key, anchors): the first amounts of a merchant's price points, ascending.

    The distinct amounts of a merchant are folded once; each point spans 2 %, so
    there are some hundreds of them at most, whatever the number of amounts.
    """
    amounts = rows.select(key, F.abs("cents").alias("x")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    start = F.struct(F.lit(0).cast("bigint").alias("anchor"), F.array().cast("array<bigint>").alias("anchors"))

    def step(a: Column, x: Column) -> Column:
        same = (a["anchor"] > 0) & ((x - a["anchor"]) / a["anchor"] <= CLUSTER_TOLERANCE)
        return F.when(same, a).otherwise(F.struct(x.alias("anchor"), F.concat(a["anchors"], F.array(x)).alias("anchors")))

    return amounts.select(key, F.aggregate("xs", start, step, lambda a: a["anchors"]).alias("anchors"))


def with_clusters(rows: DataFrame, key: str = "merchant") -> DataFrame:
    """Numbers the price points of a merchant: in ascending order, an amount over 2 % above its cluster's first one begins the next.

    A later amount can only fit the latest cluster, so a fold with one anchor is
    exact, and an amount's cluster is the number of anchors up to it.
    """
    return rows.join(price_points(rows, key), key).withColumn("cluster", F.size(F.filter("anchors", lambda a: a <= F.abs(F.col("cents"))))).drop("anchors")


def subscriptions(rows: DataFrame, as_of: date, min_occurrences: int = 3, min_confidence: float = 0.55) -> DataFrame:
    """Accepted series, by annual cost: the whole merchant, or its price points where these tell more.

    Price points are tried if the whole is not accepted or its amounts are
    unstable; they need a real share of the merchant's rows and more regularity.
    Two or more of them replace the whole; one replaces only a whole that is not accepted.

    Each row counts for its merchant (cluster 0) and for its price point; all
    series are scored in one aggregation, and what to keep is decided by windows
    over the merchant's scored series.
    """
    placed = with_clusters(rows)
    both = placed.withColumn("cluster", F.explode(F.array(F.lit(0), F.col("cluster"))))
    keys = ["merchant", "cluster"]
    grouped = _placed(both, keys).groupBy(*keys).agg(*_amount_aggregates(), *_gap_aggregates())
    of = Window.partitionBy("merchant")
    grouped = grouped.withColumn("pool", F.max(F.when(F.col("cluster") == 0, F.col("n"))).over(of)).withColumn("clusters", F.max("cluster").over(of))
    judged = _scored(grouped, [*keys, "pool", "clusters"], as_of, min_occurrences)
    whole = F.col("cluster") == 0
    accepted = F.col("periodic") & (F.col("confidence") >= min_confidence)
    real = (F.col("n") >= CLUSTER_SHARE * F.col("pool")) | ((F.col("n") >= CLUSTER_LEAST) & (F.col("pool") <= CLUSTER_POOL))
    judged = (
        judged.withColumn("whole_ok", F.coalesce(F.max(F.when(whole, accepted)).over(of), F.lit(False)))
        .withColumn("stable", F.coalesce(F.max(F.when(whole & F.col("periodic"), F.col("stability"))).over(of), F.lit(0.0)))
        .withColumn("split", ~whole & (F.col("clusters") >= 2) & (~F.col("whole_ok") | (F.col("stable") < SPLIT_BELOW_STABILITY)) & real & accepted & (F.col("regularity") >= MIN_SPLIT_REGULARITY))
        .withColumn("splits", F.sum(F.col("split").cast("int")).over(of))
    )
    kept = judged.where((whole & F.col("whole_ok") & (F.col("splits") < 2)) | (F.col("split") & ((F.col("splits") >= 2) | ~F.col("whole_ok"))))
    return kept.drop("pool", "clusters", "whole_ok", "stable", "split", "splits").orderBy(F.desc("annualized_cents"), "merchant", "cluster")

"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statwright.functions import categories, dates, foreign, merchants
from statwright.functions import money as m
from statwright.functions.fixed import CADENCES, CLUSTER_LEAST, CLUSTER_POOL, CLUSTER_SHARE, FEE_DAYS, FEE_TOLERANCE, MIN_SPLIT_REGULARITY, SIBLINGS, SPLIT_BELOW_STABILITY
from statwright.operators import ledger as lg
from statwright.operators import questions as q
from statwright.operators import recurring as rec
from statwright.operators import trips as tr
from statwright.plans.view import LEDGER, SERIES, ledger, series, table

AS_OF = date(2024, 2, 15)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _with(*parts: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


# --- questions ------------------------------------------------------------------------------------

@query(_with(LEDGER, body="""SELECT count(*) AS transaction_count, min(posted_on) AS first, max(posted_on) AS last,
  sum(CASE WHEN amount_cents < 0 THEN -amount_cents ELSE 0 END)::BIGINT AS out_cents, sum(CASE WHEN amount_cents > 0 THEN amount_cents ELSE 0 END)::BIGINT AS in_cents,
  count(*) FILTER (category = 'Uncategorized') AS uncategorized_count, sum(amount_cents)::BIGINT AS net_cents FROM ledger"""))
def overview(spark, d):
    return q.overview(ledger(spark, d))


@query(_with(LEDGER, body="""SELECT s.account, count(l.id) AS transactions, min(posted_on) AS first, max(posted_on) AS last
  FROM (SELECT DISTINCT account FROM (SELECT c_mktsegment AS account FROM customer UNION ALL SELECT 'EMPTY')) s LEFT JOIN ledger l ON l.account = s.account GROUP BY s.account"""))
def account_activity(spark, d):
    accounts = table(spark, d, "customer").select(F.col("c_mktsegment").alias("account")).union(spark.range(1).select(F.lit("EMPTY")))
    return q.account_activity(accounts, ledger(spark, d))


@query(_with(LEDGER, body="""SELECT category, sum(-amount_cents)::BIGINT AS spent_cents, count(*) AS transactions,
  round(sum(-amount_cents) / sum(sum(-amount_cents)) OVER () * 100, 1) AS share, count(*) OVER () AS matching FROM ledger WHERE amount_cents < 0 GROUP BY category"""))
def spending_by_category(spark, d):
    return q.spending_by_category(ledger(spark, d))


@query(_with(LEDGER, body="""SELECT merchant, arg_max(category, (posted_on, id)) AS category, sum(-amount_cents)::BIGINT AS spent_cents, count(*) AS transactions, min(posted_on) AS first, max(posted_on) AS last,
  count(*) OVER () AS total_merchants FROM ledger WHERE amount_cents < 0 AND posted_on BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY merchant ORDER BY spent_cents DESC, merchant LIMIT 25"""))
def spending_by_merchant(spark, d):
    return q.spending_by_merchant(ledger(spark, d), "1996-01-01", "1999-12-31", limit=25)


@query(_with(LEDGER, body="""SELECT *, round(avg(spent_cents) OVER () / 100, 2) AS average_spend FROM (
  SELECT strftime(posted_on, '%Y-%m') AS month, sum(CASE WHEN amount_cents < 0 THEN -amount_cents ELSE 0 END)::BIGINT AS spent_cents, sum(CASE WHEN amount_cents > 0 THEN amount_cents ELSE 0 END)::BIGINT AS received_cents,
  sum(amount_cents)::BIGINT AS net_cents, count(*) AS transactions, count(*) OVER () AS matching FROM ledger GROUP BY month ORDER BY month DESC LIMIT 24)"""))
def monthly_summary(spark, d):
    return q.monthly_summary(ledger(spark, d), limit=24)


@query(_with(LEDGER, body="""SELECT id, posted_on, merchant, category, amount_cents, left(raw_description, 80) AS description, count(*) OVER () AS matching FROM ledger
  WHERE posted_on >= DATE '1997-01-01' AND merchant ILIKE '%00001%' AND abs(amount_cents) BETWEEN 1000000 AND 40000000 ORDER BY posted_on DESC, abs(amount_cents) DESC, id LIMIT 50"""))
def transactions_page(spark, d):
    return q.list_transactions(ledger(spark, d), start="1997-01-01", merchant="00001", min_amount=10_000, max_amount=400_000)


@query(_with(LEDGER, body="""SELECT merchant, sum(-amount_cents)::BIGINT AS spent_cents, count(*) AS transactions, left(max(raw_description), 80) AS example FROM ledger
  WHERE category = 'Uncategorized' AND amount_cents < 0 GROUP BY merchant ORDER BY spent_cents DESC, merchant LIMIT 20"""))
def top_uncategorized(spark, d):
    return q.top_uncategorized(ledger(spark, d), 20)


@query(_with(LEDGER, """t AS (SELECT category, sum(CASE WHEN posted_on BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' THEN -amount_cents ELSE 0 END)::BIGINT AS a_cents,
  sum(CASE WHEN posted_on BETWEEN DATE '1996-07-01' AND DATE '1997-06-30' THEN -amount_cents ELSE 0 END)::BIGINT AS b_cents FROM ledger WHERE amount_cents < 0 AND posted_on BETWEEN DATE '1996-01-01' AND DATE '1997-06-30' GROUP BY category)""",
  body="""SELECT category, a_cents, b_cents, b_cents - a_cents AS change_cents, CASE WHEN a_cents <> 0 THEN round((b_cents - a_cents) / a_cents * 100, 1) END AS percent_change,
  count(*) OVER () AS matching, (sum(a_cents) OVER ())::BIGINT AS total_a_cents, (sum(b_cents) OVER ())::BIGINT AS total_b_cents FROM t"""))
def compare_periods(spark, d):
    return q.compare_periods(ledger(spark, d), ("1996-01-01", "1996-12-31"), ("1996-07-01", "1997-06-30"))


@query(_with(LEDGER, body="""SELECT code, CASE code WHEN '__fee__' THEN 'Foreign transaction fees' WHEN '' THEN 'Home country' ELSE upper(code) END AS country, sum(-amount_cents)::BIGINT AS spent_cents, count(*) AS transactions,
  min(posted_on) AS first, max(posted_on) AS last, round(sum(-amount_cents) / sum(sum(-amount_cents)) OVER () * 100, 1) AS share, count(*) OVER () AS matching
  FROM (SELECT *, CASE WHEN is_fee THEN '__fee__' ELSE coalesce(country, '') END AS code FROM ledger WHERE amount_cents < 0) GROUP BY code"""))
def spending_by_country(spark, d):
    return q.spending_by_country(ledger(spark, d))


@query(_with(LEDGER, body="SELECT count(DISTINCT merchant) AS merchants FROM ledger WHERE amount_cents < 0"))
def distinct_merchants(spark, d):
    return q.distinct_merchants(ledger(spark, d))


@query(_with(LEDGER, body="SELECT count(*) AS transactions, min(posted_on) AS first, max(posted_on) AS last FROM ledger"))
def date_range(spark, d):
    return q.date_range(ledger(spark, d))


# --- identity and deduplication -------------------------------------------------------------------

FILES = """files AS (
  SELECT account, posted_on, amount_cents, merchant AS raw_description, CASE WHEN id % 3 = 0 THEN 'a.csv' ELSE 'b.csv' END AS source_file, CAST(id AS INTEGER) AS source_row FROM ledger
  UNION ALL SELECT account, posted_on, amount_cents, '  ' || upper(merchant) || ' ', 'c.csv', CAST(id AS INTEGER) FROM ledger WHERE id % 4 = 0
), numbered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY source_file, posted_on, amount_cents, lower(trim(regexp_replace(raw_description, '\\s+', ' ', 'g'))) ORDER BY source_row) - 1 AS INTEGER) AS occurrence FROM files
), ids AS (
  SELECT *, left(sha256(account || '|' || CAST(posted_on AS VARCHAR) || '|' || CAST(amount_cents AS VARCHAR) || '|' || lower(trim(regexp_replace(raw_description, '\\s+', ' ', 'g'))) || '|' || CAST(occurrence AS VARCHAR)), 32) AS id FROM numbered
)"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    base = ledger(spark, d)
    one = lambda rows, text, file: rows.select("account", "posted_on", "amount_cents", text.alias("raw_description"), file.alias("source_file"), F.col("id").cast("int").alias("source_row"))
    ab = F.when(F.col("id") % 3 == 0, "a.csv").otherwise("b.csv")
    again = base.where(F.col("id") % 4 == 0)  # the overlap of a second export
    return one(base, F.col("merchant"), ab).union(one(again, F.concat(F.lit("  "), F.upper("merchant"), F.lit(" ")), F.lit("c.csv")))


@query(_with(LEDGER, FILES, body="SELECT source_file, source_row, occurrence, id FROM ids"))
def content_ids(spark, d):
    return lg.with_id(lg.with_occurrence(_files(spark, d))).select("source_file", "source_row", "occurrence", "id")


@query(_with(LEDGER, FILES, body="""SELECT id, account, posted_on, amount_cents, raw_description, source_file, source_row FROM ids
  WHERE id NOT IN (SELECT id FROM ids WHERE source_file = 'a.csv') QUALIFY row_number() OVER (PARTITION BY id ORDER BY source_file, source_row) = 1"""))
def dedup_overlap(spark, d):
    rows = lg.with_id(lg.with_occurrence(_files(spark, d)))
    known = rows.where("source_file = 'a.csv'")
    return lg.insert_ignore(known, rows).select("id", "account", "posted_on", "amount_cents", "raw_description", "source_file", "source_row")


@query(_with(LEDGER, FILES, body="""SELECT source_file, count(*) AS rows_read, count(*) FILTER (new) AS rows_inserted, count(*) FILTER (NOT new) AS rows_skipped FROM (
  SELECT source_file, row_number() OVER (PARTITION BY id ORDER BY source_file, source_row) = 1 AS new FROM ids) GROUP BY source_file"""))
def import_counters(spark, d):
    rows = lg.with_id(lg.with_occurrence(_files(spark, d)))
    return lg.import_counters(rows, lg.first_of_each_id(rows))


@query(_with(LEDGER, body="SELECT DISTINCT account, 'USD' AS currency FROM ledger WHERE account NOT IN ('BUILDING', 'MACHINERY')"))
def accounts_to_add(spark, d):
    known = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "account string")
    return lg.accounts_to_add(known, ledger(spark, d))


@query("SELECT sha256(o_orderpriority) AS file_hash, o_orderpriority AS path FROM (SELECT DISTINCT o_orderpriority FROM orders) WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM orders WHERE o_orderkey % 1000 = 1 AND o_orderpriority LIKE '1%')")
def new_files(spark, d):
    orders = table(spark, d, "orders")
    hashed = lambda df: df.select(F.sha2(F.col("o_orderpriority").cast("binary"), 256).alias("file_hash"), F.col("o_orderpriority").alias("path")).distinct()
    log = hashed(orders.where("o_orderkey % 1000 = 1 AND o_orderpriority LIKE '1%'"))
    return lg.new_files(hashed(orders), log)


# --- series ---------------------------------------------------------------------------------------

GAPS = """gaps AS (SELECT merchant, gap FROM (SELECT merchant, day - lag(day) OVER (PARTITION BY merchant ORDER BY day, ord) AS gap FROM series) WHERE gap > 0)"""


def _credit(p: float, t: float) -> str:
    near = lambda k: f"abs(gap - {k * p}) <= {t * k**0.5!r}"
    return f"avg(CASE WHEN {near(1)} THEN 1.0::DOUBLE WHEN {near(2)} OR {near(3)} THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END)"


FITS = ", ".join(f"{_credit(p, t)} AS fit_{n}" for n, p, t in CADENCES)
STATS = f"stats AS (SELECT merchant, count(*) AS n_gaps, median(gap)::DOUBLE AS median_gap, {FITS} FROM gaps GROUP BY merchant)"
BEST = "best AS (SELECT *, CASE " + " ".join(f"WHEN fit_{n} = regularity THEN '{n}'" for n, _, _ in CADENCES) + " END AS cadence FROM (SELECT *, greatest(" + ", ".join(f"fit_{n}" for n, _, _ in CADENCES) + ") AS regularity FROM stats))"


@query(_with(SERIES, GAPS, STATS, body="SELECT merchant, n_gaps, median_gap, " + ", ".join(f"round(fit_{n}, 9) AS fit_{n}" for n, _, _ in CADENCES) + " FROM stats"))
def gap_stats(spark, d):
    s = rec.gap_stats(series(spark, d), ["merchant"])
    return s.select("merchant", "n_gaps", "median_gap", *[F.round(f"fit_{n}", 9).alias(f"fit_{n}") for n, _, _ in CADENCES])


@query(_with(SERIES, GAPS, STATS, BEST, body="SELECT merchant, cadence, round(regularity, 9) AS regularity FROM best"))
def cadence_fit(spark, d):
    return rec.best_cadence(rec.gap_stats(series(spark, d), ["merchant"])).select("merchant", "cadence", F.round("regularity", 9).alias("regularity"))


AMOUNTS = """sorted AS (SELECT *, abs(cents)::DOUBLE AS x, row_number() OVER (PARTITION BY merchant ORDER BY day, ord) AS i, row_number() OVER (PARTITION BY merchant ORDER BY day DESC, ord DESC) AS back FROM series),
amounts AS (SELECT merchant, count(*) AS n, min(day) AS first, max(day) AS last, min(abs(cents)) AS min_cents, max(abs(cents)) AS max_cents, floor(median(x) FILTER (back <= 3))::BIGINT AS typical_cents,
  avg(x) AS mean, CASE WHEN avg(x) = 0 OR count(*) < 2 THEN 0 ELSE stddev_pop(x) / avg(x) END AS overall, CASE WHEN count(*) < 2 OR avg(x) FILTER (back <= 3) = 0 THEN 0 ELSE stddev_pop(x) FILTER (back <= 3) / avg(x) FILTER (back <= 3) END AS recent_cv,
  max(x) FILTER (i = 1) AS x1, max(x) FILTER (back = 1) AS xn, arg_max(category, i) AS category FROM sorted GROUP BY merchant),
a AS (SELECT merchant, n, first, last, min_cents, max_cents, typical_cents, CASE WHEN mean = 0 THEN 0 ELSE greatest(0.0, 1 - least(1.0, least(overall, recent_cv) / 0.35)) END AS stability,
  mean <> 0 AND overall > 0.10 AS amount_varies, CASE WHEN mean = 0 OR x1 = 0 THEN false ELSE abs(xn - x1) / x1 > 0.05 END AS price_changed, category FROM amounts)"""


@query(_with(SERIES, AMOUNTS, body="SELECT merchant, n, first, last, min_cents, max_cents, typical_cents, round(stability, 9) AS stability, amount_varies, price_changed, category FROM a"))
def amount_stats(spark, d):
    return rec.amount_stats(series(spark, d), ["merchant"]).withColumn("stability", F.round("stability", 9))


SCORED = f"""z AS (SELECT a.*, b.median_gap, b.regularity, b.cadence, least(1.0, n / ((last - first) / median_gap + 1)) AS coverage FROM a JOIN best b USING (merchant) WHERE n >= 3),
zz AS (SELECT *, last + CAST(round_even(median_gap, 0) AS INTEGER) AS expected_next FROM z),
scored AS (SELECT *, DATE '{AS_OF}' - expected_next AS overdue, least(1.0, 0.40 * regularity + 0.25 * stability + 0.20 * coverage + 0.15 * least(1.0, (n - 2) / 4)) AS confidence, regularity >= 0.6 AND coverage >= 0.7 AS periodic FROM zz)"""
SCORED_COLUMNS = ["merchant", "cadence", "n", "first", "last", "typical_cents", "expected_next", "days_overdue", "status", "annualized_cents", "periodic", "coverage", "confidence"]


def _scored_out(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in ("coverage", "confidence") else F.col(c) for c in SCORED_COLUMNS])


@query(_with(SERIES, GAPS, STATS, BEST, AMOUNTS, SCORED, body="""SELECT merchant, cadence, n, first, last, typical_cents, expected_next, CAST(greatest(0, overdue) AS INTEGER) AS days_overdue,
  CASE WHEN overdue > 1.5 * median_gap THEN 'likely_cancelled' WHEN overdue > 0.5 * median_gap THEN 'overdue' ELSE 'active' END AS status,
  CAST(round_even(typical_cents * (365.25::DOUBLE / median_gap), 0) AS BIGINT) AS annualized_cents, periodic, round(coverage, 6) AS coverage, round(confidence, 6) AS confidence FROM scored"""))
def recurring_scored(spark, d):
    return _scored_out(rec.scored(series(spark, d), ["merchant"], AS_OF))


@query(_with(SERIES, """xs AS (SELECT merchant, list_sort(list(DISTINCT abs(cents))) AS xs FROM series GROUP BY merchant),
walk AS (SELECT merchant, xs, 1 AS i, xs[1] AS anchor, 1 AS cluster FROM xs
  UNION ALL SELECT merchant, xs, i + 1, CASE WHEN anchor > 0 AND (xs[i + 1] - anchor) / anchor <= 0.02 THEN anchor ELSE xs[i + 1] END, CASE WHEN anchor > 0 AND (xs[i + 1] - anchor) / anchor <= 0.02 THEN cluster ELSE cluster + 1 END FROM walk WHERE i < len(xs))""",
  body="SELECT s.merchant, w.cluster, count(*) AS n, min(abs(cents)) AS lo, max(abs(cents)) AS hi FROM series s JOIN walk w ON w.merchant = s.merchant AND w.xs[w.i] = abs(s.cents) GROUP BY s.merchant, w.cluster"))
def amount_clusters(spark, d):
    rows = rec.with_clusters(series(spark, d))
    return rows.groupBy("merchant", "cluster").agg(F.count("*").alias("n"), F.min(F.abs("cents")).alias("lo"), F.max(F.abs("cents")).alias("hi"))


#: The whole merchants and their price points as series named merchant and number, so that the statements above score both.
POINTS = """xs AS (SELECT merchant, list_sort(list(DISTINCT abs(cents))) AS xs FROM base GROUP BY merchant),
walk AS (SELECT merchant, xs, 1 AS i, xs[1] AS anchor, 1 AS cluster FROM xs
  UNION ALL SELECT merchant, xs, i + 1, CASE WHEN anchor > 0 AND (xs[i + 1] - anchor) / anchor <= 0.02 THEN anchor ELSE xs[i + 1] END, CASE WHEN anchor > 0 AND (xs[i + 1] - anchor) / anchor <= 0.02 THEN cluster ELSE cluster + 1 END FROM walk WHERE i < len(xs)),
series AS (SELECT merchant || '#0' AS merchant, day, ord, cents, category FROM base
  UNION ALL SELECT s.merchant || '#' || w.cluster, day, ord, cents, category FROM base s JOIN walk w ON w.merchant = s.merchant AND w.xs[w.i] = abs(s.cents))"""
CHOSEN = f"""named AS (SELECT * EXCLUDE (merchant), split_part(merchant, '#', 1) AS merchant, CAST(split_part(merchant, '#', 2) AS INTEGER) AS cluster, periodic AND confidence >= 0.4 AS accepted FROM scored),
points AS (SELECT split_part(merchant, '#', 1) AS merchant, count(DISTINCT merchant) - 1 AS points, count(*) / 2 AS pool FROM series GROUP BY 1),
wholes AS (SELECT p.*, coalesce(w.accepted, false) AS ok, CASE WHEN w.periodic THEN w.stability ELSE 0 END AS stable FROM points p LEFT JOIN named w ON w.merchant = p.merchant AND w.cluster = 0),
splits AS (SELECT n.*, w.ok FROM named n JOIN wholes w USING (merchant) WHERE n.cluster > 0 AND w.points >= 2 AND (NOT w.ok OR w.stable < {SPLIT_BELOW_STABILITY})
  AND (n.n >= {CLUSTER_SHARE} * w.pool OR (n.n >= {CLUSTER_LEAST} AND w.pool <= {CLUSTER_POOL})) AND n.accepted AND n.regularity >= {MIN_SPLIT_REGULARITY}),
found AS (SELECT merchant, count(*) AS splits FROM splits GROUP BY merchant),
chosen AS (SELECT n.* FROM named n LEFT JOIN found f USING (merchant) WHERE n.cluster = 0 AND n.accepted AND coalesce(f.splits, 0) < 2
  UNION ALL SELECT s.* EXCLUDE (ok) FROM splits s JOIN found f USING (merchant) WHERE f.splits >= 2 OR NOT s.ok)"""


@query(_with(SERIES.replace("series AS", "base AS"), POINTS, GAPS, STATS, BEST, AMOUNTS, SCORED, CHOSEN, body="""SELECT merchant, cluster, cadence, n, first, last, typical_cents, expected_next, CAST(greatest(0, overdue) AS INTEGER) AS days_overdue,
  CASE WHEN overdue > 1.5 * median_gap THEN 'likely_cancelled' WHEN overdue > 0.5 * median_gap THEN 'overdue' ELSE 'active' END AS status,
  CAST(round_even(typical_cents * (365.25::DOUBLE / median_gap), 0) AS BIGINT) AS annualized_cents, periodic, round(coverage, 6) AS coverage, round(confidence, 6) AS confidence, amount_varies, price_changed, category FROM chosen"""))
def subscriptions(spark, d):
    found = rec.subscriptions(series(spark, d), AS_OF, min_confidence=0.4)
    return found.select("cluster", "amount_varies", "price_changed", "category", *[F.round(c, 6).alias(c) if c in ("coverage", "confidence") else F.col(c) for c in SCORED_COLUMNS])


@query(_with(SERIES, GAPS, STATS, BEST, AMOUNTS, SCORED, body="""SELECT count(*) AS accepted, count(*) FILTER (overdue <= 0.5 * median_gap) AS active,
  coalesce(sum(CAST(round_even(typical_cents * (365.25::DOUBLE / median_gap), 0) AS BIGINT)) FILTER (overdue <= 0.5 * median_gap), 0)::BIGINT AS active_annual_cents FROM scored WHERE periodic AND confidence >= 0.4"""))
def subscription_totals(spark, d):
    rows = rec.scored(series(spark, d), ["merchant"], AS_OF).where("periodic AND confidence >= 0.4")
    active = F.col("status") == "active"
    return rows.agg(F.count("*").alias("accepted"), F.count_if(active).alias("active"), F.coalesce(F.sum(F.when(active, F.col("annualized_cents"))), F.lit(0)).alias("active_annual_cents"))


# --- trips ----------------------------------------------------------------------------------------

CLUSTERS = """opened AS (SELECT *, coalesce(posted_on - lag(posted_on) OVER (PARTITION BY scope ORDER BY posted_on, id) > 6, true) AS opens FROM ledger WHERE country IS NOT NULL OR original_currency IS NOT NULL),
clusters AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY scope ORDER BY posted_on, id ROWS UNBOUNDED PRECEDING)::BIGINT AS trip FROM opened)"""
TRIPS = """rolled AS (SELECT scope, trip, min(posted_on) AS start, max(posted_on) AS "end", count(*) AS transactions, list_sort(list(DISTINCT country) FILTER (country IS NOT NULL)) AS countries,
  coalesce(list_sort(list(DISTINCT original_currency) FILTER (original_currency IS NOT NULL)), []) AS currencies, coalesce(sum(abs(amount_cents)) FILTER (amount_cents < 0), 0)::BIGINT AS spend_cents, count(DISTINCT merchant) AS merchants FROM clusters GROUP BY scope, trip),
trips AS (SELECT *, CAST("end" - start + 1 AS INTEGER) AS ndays FROM rolled WHERE transactions >= 3 AND merchants >= 2 AND "end" - start + 1 >= 2)"""
TOP = """spent AS (SELECT scope, trip, merchant, sum(abs(amount_cents))::BIGINT AS spent_cents, min((posted_on, id)) AS seen FROM clusters WHERE amount_cents < 0 GROUP BY scope, trip, merchant),
top AS (SELECT scope, trip, CAST(row_number() OVER (PARTITION BY scope, trip ORDER BY spent_cents DESC, seen) AS INTEGER) AS rank, merchant, spent_cents FROM spent QUALIFY rank <= 5)"""


@query(_with(LEDGER, CLUSTERS, body="SELECT scope, trip, min(posted_on) AS start, max(posted_on) AS finish, count(*) AS transactions FROM clusters GROUP BY scope, trip"))
def trip_clusters(spark, d):
    return tr.clusters(ledger(spark, d), "scope").groupBy("scope", "trip").agg(F.min("posted_on").alias("start"), F.max("posted_on").alias("finish"), F.count("*").alias("transactions"))


@query(_with(LEDGER, CLUSTERS, TRIPS, TOP, body="""SELECT t.scope, t.trip, start, "end" AS finish, ndays, transactions, array_to_string(countries, ',') AS countries, array_to_string(currencies, ',') AS currencies, spend_cents,
  coalesce((SELECT sum(abs(f.amount_cents)) FROM ledger f WHERE f.is_fee AND f.scope = t.scope AND f.posted_on BETWEEN t.start AND t."end"), 0)::BIGINT AS fee_cents,
  coalesce((SELECT string_agg(merchant, ',' ORDER BY rank) FROM top WHERE top.scope = t.scope AND top.trip = t.trip), '') AS top_merchants FROM trips t"""))
def trip_rollup(spark, d):
    joined = lambda c: F.array_join(c, ",").alias(c)
    return tr.trips(ledger(spark, d), "scope").select("scope", "trip", "start", F.col("end").alias("finish"), "ndays", "transactions", joined("countries"), joined("currencies"), "spend_cents", "fee_cents", joined("top_merchants"))


@query(_with(LEDGER, CLUSTERS, TOP, body="SELECT * FROM top"))
def top_merchants_per_trip(spark, d):
    return tr.top_merchants(tr.clusters(ledger(spark, d), "scope"), "scope")


@query(_with(LEDGER, CLUSTERS, TRIPS, body="""SELECT l.id, l.scope, t.trip FROM ledger l JOIN trips t ON l.scope = t.scope AND l.posted_on BETWEEN t.start AND t."end" WHERE l.is_fee"""))
def fees_within_trips(spark, d):
    base = ledger(spark, d)
    return tr.during(base.where("is_fee"), tr.trips(base, "scope").select("scope", "trip", "start", "end"), "scope").select("id", "scope", "trip")


@query(_with(LEDGER, body="""SELECT c.scope, c.id AS charge_id, f.id AS fee_id, CAST(abs(f.posted_on - c.posted_on) AS INTEGER) AS gap, abs(f.amount_cents) AS actual_cents
  FROM ledger c JOIN ledger f ON f.is_fee AND f.scope = c.scope AND f.posted_on BETWEEN c.posted_on - 3 AND c.posted_on + 3 WHERE c.original_currency IS NULL AND NOT c.is_fee AND c.amount_cents < 0"""))
def fee_candidates(spark, d):
    base = ledger(spark, d)
    return tr.fee_candidates(base, base.where("original_currency IS NULL AND NOT is_fee AND amount_cents < 0").select("scope", "id", "posted_on"), "scope")


#: Places are codes here; IN and CA are also states, and count only among the trip's countries.
PLACED = LEDGER.replace("ledger AS", "plain AS") + """, ledger AS (SELECT * REPLACE (CASE WHEN country IS NOT NULL THEN (['BR', 'MX', 'IN', 'CA', 'GB'])[scope % 5 + 1] END AS country) FROM plain)"""
CONVERTED = f"""members AS (SELECT l.*, t.trip, t.countries FROM ledger l JOIN trips t ON l.scope = t.scope AND l.posted_on BETWEEN t.start AND t."end" WHERE NOT l.is_fee AND l.amount_cents < 0),
told AS (SELECT scope, trip, count(*) AS siblings, sum(abs(amount_cents)) AS detailed FROM members WHERE original_currency IS NOT NULL GROUP BY scope, trip HAVING count(*) >= {SIBLINGS}),
fees AS (SELECT t.scope, t.trip, sum(abs(f.amount_cents)) AS fee_cents FROM trips t JOIN ledger f ON f.is_fee AND f.scope = t.scope AND f.posted_on BETWEEN t.start AND t."end" GROUP BY t.scope, t.trip),
charges AS (SELECT m.scope, m.trip, m.id, m.merchant, m.posted_on, abs(m.amount_cents) AS billed, m.country AS place, d.siblings, coalesce(f.fee_cents, 0) / d.detailed AS rate, row_number() OVER (PARTITION BY m.scope, m.trip ORDER BY m.posted_on, m.id) AS k
  FROM members m JOIN told d USING (scope, trip) LEFT JOIN fees f USING (scope, trip) WHERE m.original_currency IS NULL AND m.country IS NOT NULL AND (m.country NOT IN ('IN', 'CA') OR list_contains(m.countries, m.country))),
near AS (SELECT c.scope, c.trip, c.k, list(f.id ORDER BY abs(abs(f.amount_cents) - c.billed * c.rate), f.id) AS candidates FROM charges c
  JOIN ledger f ON f.is_fee AND f.scope = c.scope AND f.posted_on BETWEEN c.posted_on - {FEE_DAYS} AND c.posted_on + {FEE_DAYS} AND c.rate > 0 AND abs(abs(f.amount_cents) - c.billed * c.rate) <= {FEE_TOLERANCE} * (c.billed * c.rate) GROUP BY c.scope, c.trip, c.k),
known AS (SELECT c.*, coalesce(n.candidates, []) AS candidates FROM charges c LEFT JOIN near n USING (scope, trip, k)),
claims AS (SELECT *, list_slice(candidates, 1, 1) AS own, list_slice(candidates, 1, 1) AS taken FROM known WHERE k = 1
  UNION ALL SELECT c.*, list_slice(list_filter(c.candidates, lambda x: NOT list_contains(w.taken, x)), 1, 1), list_concat(w.taken, list_slice(list_filter(c.candidates, lambda x: NOT list_contains(w.taken, x)), 1, 1))
  FROM claims w JOIN known c ON c.scope = w.scope AND c.trip = w.trip AND c.k = w.k + 1)"""


@query(_with(PLACED, CLUSTERS, TRIPS, CONVERTED, body=f"""SELECT scope, trip, id, merchant, posted_on, billed AS billed_cents, place AS country, len(own) > 0 AS fee_observed, siblings,
  round(0.6 + CASE WHEN len(own) > 0 THEN 0.25 ELSE 0 END + CASE WHEN siblings >= {2 * SIBLINGS} THEN 0.1 ELSE 0 END, 2)::DOUBLE AS confidence FROM claims"""))
def suspected_conversions(spark, d):
    codes = F.element_at(F.array(*[F.lit(c) for c in ("BR", "MX", "IN", "CA", "GB")]), (F.col("scope") % 5 + 1).cast("int"))
    placed = ledger(spark, d).withColumn("country", F.when(F.col("country").isNotNull(), codes)).withColumn("raw_description", F.concat(F.col("merchant"), F.lit(" CITY "), F.coalesce("country", F.lit(""))))
    return tr.suspected_conversions(placed, "scope")


@query(_with(LEDGER, body="SELECT original_currency, count(*) AS transactions, sum(abs(amount_cents))::BIGINT AS billed_cents, round(median(fx_rate), 4) AS typical_rate FROM ledger WHERE amount_cents < 0 AND original_currency IS NOT NULL GROUP BY original_currency"))
def fx_by_currency(spark, d):
    return tr.currency_summary(ledger(spark, d))


@query(_with(LEDGER, body="""SELECT (SELECT count(*) FROM ledger WHERE (country IS NOT NULL OR original_currency IS NOT NULL) AND NOT is_fee) AS foreign_transactions,
  (SELECT count(*) FROM ledger WHERE fx_rate <> 0 AND original_amount_cents <> 0 AND NOT is_fee) AS with_original_amount_and_rate,
  (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT original_currency AS c FROM ledger WHERE fx_rate <> 0 AND original_amount_cents <> 0 AND NOT is_fee GROUP BY c HAVING count(*) >= 4)) AS checkable_currencies"""))
def rate_availability(spark, d):
    return tr.rate_availability(ledger(spark, d))


@query("""SELECT code, count(*) AS n FROM (SELECT (['CA', 'IN', 'FR', 'DE', 'XX', 'MA'])[p_partkey % 6 + 1] AS code FROM part) WHERE code IN ('CA', 'IN', 'DE', 'MA') GROUP BY code""")
def unresolved_codes(spark, d):
    code = F.element_at(F.array(*[F.lit(c) for c in ("CA", "IN", "FR", "DE", "XX", "MA")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    none = F.lit(None).cast("string")
    rows = table(spark, d, "part").select(F.concat("p_name", F.lit(" TOWN "), code).alias("raw_description"), F.col("p_name").alias("merchant"), none.alias("country"), none.alias("original_currency"))
    return tr.unresolved_locations(rows)


@query(_with(LEDGER, body="""SELECT sum(abs(amount_cents)) FILTER (is_fee)::BIGINT AS fee_cents, sum(abs(amount_cents)) FILTER ((country IS NOT NULL OR original_currency IS NOT NULL) AND amount_cents < 0)::BIGINT AS spend_cents, count(*) FILTER (is_fee) AS fee_count,
  round(sum(abs(amount_cents)) FILTER (is_fee) / sum(abs(amount_cents)) FILTER ((country IS NOT NULL OR original_currency IS NOT NULL) AND amount_cents < 0) * 100, 2) AS effective_fee_percent FROM ledger"""))
def foreign_costs(spark, d):
    return tr.foreign_costs(ledger(spark, d))


# --- cells and descriptors ------------------------------------------------------------------------

AMOUNT_TEXT = """t AS (SELECT l_orderkey AS k, l_linenumber AS i, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem),
cells AS (SELECT k, i, c, CASE k % 5 WHEN 0 THEN CAST(c // 100 AS VARCHAR) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') WHEN 1 THEN '(' || CAST(c // 100 AS VARCHAR) || ',' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || ')' WHEN 2 THEN '$' || CAST(c // 100000 AS VARCHAR) || ',' || lpad(CAST(c // 100 % 1000 AS VARCHAR), 3, '0') || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || '-' WHEN 3 THEN '-' || CAST(c // 100 AS VARCHAR) || ' CR' ELSE 'n/a' END AS raw FROM t)"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    c = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    whole, part = F.floor(F.col("c") / 100).cast("string"), F.lpad((F.col("c") % 100).cast("string"), 2, "0")
    thousands = F.concat(F.floor(F.col("c") / 100000).cast("string"), F.lit(","), F.lpad((F.floor(F.col("c") / 100) % 1000).cast("string"), 3, "0"))
    kind = F.col("k") % 5
    raw = F.when(kind == 0, F.concat(whole, F.lit("."), part)).when(kind == 1, F.concat(F.lit("("), whole, F.lit(","), part, F.lit(")"))).when(kind == 2, F.concat(F.lit("$"), thousands, F.lit("."), part, F.lit("-"))).when(kind == 3, F.concat(F.lit("-"), whole, F.lit(" CR"))).otherwise("n/a")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), c.alias("c")).withColumn("raw", raw)


@query(_with(AMOUNT_TEXT, body="SELECT k, i, raw, CASE k % 5 WHEN 3 THEN c // 100 * 100 WHEN 4 THEN NULL ELSE c END AS cents, k % 5 IN (1, 2, 3) AS negative FROM cells"))
def parse_amounts(spark, d):
    return _cells(spark, d).select("k", "i", "raw", m.cents(m.magnitude(F.col("raw"))).alias("cents"), m.marked_negative(F.col("raw")).alias("negative"))


@query("""SELECT 'f' || CAST(l_suppkey % 6 AS VARCHAR) AS file, CASE l_suppkey % 6 WHEN 0 THEN 'debit_credit' WHEN 1 THEN 'signed' WHEN 2 THEN 'signed' WHEN 3 THEN 'typed' WHEN 4 THEN 'signed' ELSE 'assume_outflow' END AS mode,
  l_suppkey % 6 <> 1 AS negative_is_outflow, CASE l_suppkey % 6 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.99::DOUBLE WHEN 3 THEN 0.95::DOUBLE WHEN 4 THEN 0.9::DOUBLE ELSE 0.55::DOUBLE END AS confidence FROM lineitem GROUP BY l_suppkey % 6""")
def sign_plans(spark, d):
    f = F.col("l_suppkey") % 6
    negative = ((f == 2) & (F.col("l_linenumber") % 2 == 0)) | (f == 4)
    rows = table(spark, d, "lineitem").select(
        F.concat(F.lit("f"), f.cast("string")).alias("file"), F.concat(F.when(negative, "-").otherwise(""), F.col("l_extendedprice").cast("decimal(12,2)").cast("string")).alias("amount"),
        F.when(f == 3, F.when(F.col("l_linenumber") % 2 == 0, "DR").otherwise("Credit")).alias("type"), (f == 0).alias("has_debit_credit"), F.when(f == 1, False).alias("override"))
    return m.sign_plans(rows)


@query("""WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 4 AS f FROM orders), g AS (SELECT f, count(*) AS n FROM x GROUP BY f)
SELECT 'f' || CAST(f AS VARCHAR) AS file, CASE f WHEN 0 THEN '%Y-%m-%d' WHEN 1 THEN '%d/%m/%Y' WHEN 2 THEN '%m/%d/%Y' ELSE '%d-%b-%Y' END AS fmt, CASE f WHEN 0 THEN NULL ELSE f <> 2 END AS day_first, 1.0::DOUBLE AS confidence FROM g""")
def date_votes(spark, d):
    f, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    raw = F.when(f == 0, F.date_format(day, "yyyy-MM-dd HH:mm")).when(f == 1, F.date_format(day, "dd/MM/yyyy")).when(f == 2, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "dd-MMM-yyyy"))
    rows = table(spark, d, "orders").select(F.concat(F.lit("f"), f.cast("string")).alias("file"), raw.alias("raw"), F.lit(None).cast("boolean").alias("hint"), F.lit(None).cast("string").alias("explicit"))
    return dates.date_plans(rows)


DESCRIPTORS = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'SQ *' || p_brand || ' SHOP #' || (1000 + p_partkey) || ' OAKLAND CA' WHEN 1 THEN 'POS DEBIT ' || p_brand || ' ' || (100000 + p_partkey) WHEN 2 THEN 'AMZN Mktp ' || p_partkey
  WHEN 3 THEN 'TST* Cafe ' || p_brand || ' SAO PAULO BR 12.50 BRL' WHEN 4 THEN 'uber trip ' || p_partkey ELSE 'Foreign Transaction Fee ' || p_partkey END AS raw FROM part"""


def _descriptors(spark: SparkSession, d: str) -> DataFrame:
    p, k = table(spark, d, "part"), F.col("p_partkey") % 6
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    key, brand = F.col("p_partkey"), F.col("p_brand")
    raw = (
        F.when(k == 0, text("SQ *", brand, " SHOP #", key + 1000, " OAKLAND CA")).when(k == 1, text("POS DEBIT ", brand, " ", key + 100000)).when(k == 2, text("AMZN Mktp ", key))
        .when(k == 3, text("TST* Cafe ", brand, " SAO PAULO BR 12.50 BRL")).when(k == 4, text("uber trip ", key)).otherwise(text("Foreign Transaction Fee ", key))
    )
    return p.select("p_partkey", "p_brand", raw.alias("raw"))


@query(f"""WITH d AS ({DESCRIPTORS}), t AS (SELECT d.p_partkey, raw, replace(p_brand, '#', ' ') AS b, p_brand FROM d JOIN part USING (p_partkey))
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN upper(left(b, 1)) || lower(substr(b, 2)) WHEN 1 THEN upper(left(b, 1)) || lower(substr(b, 2)) WHEN 2 THEN 'Amazon' WHEN 3 THEN 'Cafe ' || upper(left(b, 1)) || lower(substr(b, 2)) WHEN 4 THEN 'Uber' ELSE
  CASE WHEN length(CAST(p_partkey AS VARCHAR)) >= 4 THEN 'Foreign Transaction Fee' ELSE 'Foreign Transaction Fee ' || p_partkey END END AS merchant,
  CASE p_partkey % 6 WHEN 2 THEN 'Shopping' WHEN 3 THEN 'Dining' WHEN 4 THEN 'Transport' WHEN 5 THEN 'Fees & Charges' ELSE 'Uncategorized' END AS category FROM t""")
def merchant_names(spark, d):
    name = merchants.normalize_merchant(foreign.without_fx(F.col("raw")))
    rows = _descriptors(spark, d).select("p_partkey", "raw", name.alias("merchant"))
    return rows.select("p_partkey", "merchant", categories.categorize(F.col("merchant"), F.col("raw")).alias("category"))


@query(f"""WITH d AS ({DESCRIPTORS}) SELECT p_partkey, CASE WHEN p_partkey % 6 = 3 THEN 1250::BIGINT END AS original_amount_cents, CASE WHEN p_partkey % 6 = 3 THEN 'BRL' END AS original_currency,
  CASE WHEN p_partkey % 6 = 3 THEN 5.0::DOUBLE END AS fx_rate, CASE WHEN p_partkey % 6 = 3 THEN 'BR' END AS country, p_partkey % 6 = 5 AS is_fee, CASE WHEN p_partkey % 6 = 3 THEN left(raw, length(raw) - 10) ELSE raw END AS bare FROM d""")
def foreign_details(spark, d):
    rows = _descriptors(spark, d).withColumn("a", foreign.analysed(F.col("raw"), F.lit(""), F.lit(-250)))
    return rows.select("p_partkey", "a.*", foreign.without_fx(F.col("raw")).alias("bare"))


@query(f"""WITH d AS ({DESCRIPTORS}) SELECT count(*) AS examined, count(*) FILTER (p_partkey % 6 IN (2, 3, 4, 5)) AS changed FROM d""")
def recategorize(spark, d):
    rows = _descriptors(spark, d).select(F.col("p_partkey").alias("id"), merchants.normalize_merchant(foreign.without_fx(F.col("raw"))).alias("merchant"), F.col("raw").alias("raw_description"), F.lit("Uncategorized").alias("category"))
    return lg.recategorize_summary(rows)

"""The tool surface: each tool gives a small dict that says when it was cut.

Only results bounded by a limit, or by the number of accounts, trips or
subscriptions, are collected.
"""

from __future__ import annotations

from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statwright.functions.categories import BUILTIN, load_rules
from statwright.functions.fixed import COUNTRY_NAMES
from statwright.operators import questions as q
from statwright.operators import recurring as rec
from statwright.operators import trips as tr
from statwright.store import Store

RULES_FILE = "categories.yaml"


def dollars(cents: int | None) -> float:
    return round((cents or 0) / 100, 2)


def plain(value: object) -> object:
    return value.isoformat() if isinstance(value, date) else value


def rows(df: DataFrame, *drop: str) -> list[dict]:
    """Collected rows with cents as amounts and days as text."""
    return [{k.removesuffix("_cents"): dollars(v) if k.endswith("_cents") else plain(v) for k, v in r.asDict().items() if k not in drop} for r in df.collect()]


class Tools:
    def __init__(self, store: Store, rules_path: str | Path | None = None):
        self.store, self.rules_path = store, rules_path

    def _rules(self):
        return load_rules(self.rules_path)

    def import_statements(self, path: str, force: bool = False) -> dict:
        fs, p = self.store._fs(path)
        if not fs.exists(p):
            return {"error": f"{path} does not exist"}
        done = self.store.import_path(path, force, self._rules())
        return {"imported": done, "total_inserted": sum(r["rows_inserted"] for r in done), "database": self.overview()}

    def overview(self) -> dict:
        one = q.overview(self.store.ledger()).first()
        accounts = rows(q.account_activity(self.store.accounts(), self.store.ledger()))
        return {
            "transaction_count": one["transaction_count"], "date_range": {"start": plain(one["first"]), "end": plain(one["last"])},
            "total_out": dollars(one["out_cents"]), "total_in": dollars(one["in_cents"]), "net": dollars(one["net_cents"]), "uncategorized_count": one["uncategorized_count"],
            "accounts": [{"name": a["account"], "transactions": a["transactions"], "from": a["first"], "to": a["last"]} for a in accounts],
        }

    def spending_by_category(self, start: str | None = None, end: str | None = None, limit: int = 25) -> dict:
        got = q.spending_by_category(self.store.ledger(), start, end, limit).collect()
        whole = q.between(self.store.ledger(), start, end).where(q.SPENT).agg(F.sum(-F.col("amount_cents"))).first()[0]
        return {"period": {"start": start, "end": end}, "total_spent": dollars(whole), "categories": [{"category": r["category"], "spent": dollars(r["spent_cents"]), "transactions": r["transactions"], "share": r["share"]} for r in got], "truncated": bool(got) and got[0]["matching"] > len(got)}

    def spending_by_merchant(self, start: str | None = None, end: str | None = None, category: str | None = None, limit: int = 25) -> dict:
        got = rows(q.spending_by_merchant(self.store.ledger(), start, end, category, limit))
        total = got[0]["total_merchants"] if got else 0
        return {"period": {"start": start, "end": end}, "category": category, "merchants": [{k: v for k, v in r.items() if k != "total_merchants"} for r in got], "returned": len(got), "total_merchants": total, "truncated": total > len(got)}

    def monthly_summary(self, start: str | None = None, end: str | None = None, limit: int = 24) -> dict:
        got = rows(q.monthly_summary(self.store.ledger(), start, end, limit))
        return {"months": [{k: v for k, v in r.items() if k not in ("average_spend", "matching")} for r in got], "average_monthly_spend": got[0]["average_spend"] if got else 0.0, "truncated": bool(got) and got[0]["matching"] > len(got)}

    def get_transactions(self, start=None, end=None, merchant=None, category=None, min_amount=None, max_amount=None, limit: int = 50) -> dict:
        got = rows(q.list_transactions(self.store.ledger(), start, end, merchant, category, min_amount, max_amount, limit), "id")
        total = got[0]["matching"] if got else 0
        return {"transactions": [{"date": r["posted_on"], **{k: r[k] for k in ("merchant", "category", "amount", "description")}} for r in got], "returned": len(got), "total_matching": total, "truncated": total > len(got)}

    def compare_periods(self, period_a_start: str, period_a_end: str, period_b_start: str, period_b_end: str, limit: int = 25) -> dict:
        a, b = (period_a_start, period_a_end), (period_b_start, period_b_end)
        got = q.compare_periods(self.store.ledger(), a, b, limit).collect()
        side = lambda p, k: {"start": p[0], "end": p[1], "total": dollars(got[0][k]) if got else 0.0}
        changes = [{"category": r["category"], "period_a": dollars(r["a_cents"]), "period_b": dollars(r["b_cents"]), "change": dollars(r["change_cents"]), "percent_change": r["percent_change"]} for r in got]
        return {"period_a": side(a, "total_a_cents"), "period_b": side(b, "total_b_cents"), "changes": changes, "truncated": bool(got) and got[0]["matching"] > len(got)}

    def spending_by_country(self, start: str | None = None, end: str | None = None, limit: int = 25) -> dict:
        got = rows(q.spending_by_country(self.store.ledger(), start, end, limit))
        return {"period": {"start": start, "end": end}, "countries": [{**{k: v for k, v in r.items() if k != "matching"}, "code": r["code"] if r["code"] not in ("", "__fee__") else None} for r in got], "truncated": bool(got) and got[0]["matching"] > len(got)}

    def find_subscriptions(self, status: str | None = None, min_confidence: float = 0.55, as_of: str | None = None) -> dict:
        day = date.fromisoformat(as_of) if as_of else date.today()
        series = self.store.ledger().where(q.SPENT).select("merchant", F.col("posted_on").alias("day"), F.col("id").alias("ord"), F.col("amount_cents").alias("cents"), "category")
        found = rec.subscriptions(series, day, min_confidence=min_confidence)
        got = (found.where(F.col("status") == status) if status else found).collect()
        active = sum(r["annualized_cents"] for r in got if r["status"] == "active")
        listed = [{
            "merchant": r["merchant"], "category": r["category"], "cadence": r["cadence"], "typical_amount": dollars(r["typical_cents"]), "annualized_cost": dollars(r["annualized_cents"]), "occurrences": r["n"], "first_seen": plain(r["first"]),
            "last_seen": plain(r["last"]), "expected_next": plain(r["expected_next"]), "status": r["status"], "confidence": round(r["confidence"], 2), "amount_varies": r["amount_varies"], "price_changed": r["price_changed"],
        } for r in got]
        return {"subscriptions": listed, "count": len(got), "active_count": sum(r["status"] == "active" for r in got), "active_annual_total": dollars(active), "active_monthly_total": round(active / 1200, 2)}

    def _scoped(self) -> DataFrame:
        return self.store.ledger().withColumn("scope", F.lit(0))

    def find_trips(self, min_transactions: int = 3) -> dict:
        got = tr.trips(self._scoped(), "scope", min_transactions=min_transactions).orderBy(F.desc("start")).collect()
        open_codes = {r["code"]: r["n"] for r in tr.unresolved_locations(self.store.ledger()).collect()}
        name = lambda c: COUNTRY_NAMES.get(c.upper(), c.upper())
        listed = [{"countries": [name(c) for c in r["countries"]], "start": plain(r["start"]), "end": plain(r["end"]), "days": r["ndays"], "transactions": r["transactions"], "spend": dollars(r["spend_cents"]), "fees": dollars(r["fee_cents"]), "total_cost": dollars(r["spend_cents"] + r["fee_cents"]), "currencies": r["currencies"], "top_merchants": r["top_merchants"]} for r in got]
        notes = [f"{sum(open_codes.values())} charges end in a code that is a country and a state ({', '.join(f'{k} x{n}' for k, n in open_codes.items())}) and carry no currency, so they count as domestic; a trip may be missing."] if open_codes else []
        return {"trips": listed, "count": len(got), "total_spent_abroad": dollars(sum(r["spend_cents"] + r["fee_cents"] for r in got)), "notes": notes}

    def foreign_transaction_costs(self) -> dict:
        base = self.store.ledger()
        one, rates = tr.foreign_costs(base).first(), tr.rate_availability(base).first()
        suspects = tr.suspected_conversions(self._scoped(), "scope").orderBy(F.desc("confidence"), F.desc("billed_cents")).collect()
        codes = [c for c in rates["checkable_currencies"].split(",") if c]
        notes = []
        if one["spend_cents"] and not rates["with_original_amount_and_rate"]:
            notes.append("No original amounts or rates are in this export, so conversions at the till cannot be told: that is unknown, not none.")
        if suspects:
            notes.append("Suspected conversions cannot be priced, as the local amount is what is missing.")
        return {
            "foreign_spend": dollars(one["spend_cents"]), "foreign_transaction_fees": dollars(one["fee_cents"]), "fee_count": one["fee_count"], "effective_fee_percent": one["effective_fee_percent"],
            "suspected_point_of_sale_conversions": [{"merchant": r["merchant"], "date": plain(r["posted_on"]), "billed": dollars(r["billed_cents"]), "country": COUNTRY_NAMES.get(r["country"], r["country"]), "foreign_fee_charged": r["fee_observed"], "confidence": r["confidence"], "siblings_with_detail": r["siblings"], "cost": None} for r in suspects],
            "suspected_conversion_count": len(suspects), "cost_of_suspected_conversions": None, "total_measurable_cost_of_going_abroad": dollars(one["fee_cents"]),
            "by_currency": {r["original_currency"]: {"transactions": r["transactions"], "billed": dollars(r["billed_cents"]), "typical_rate": r["typical_rate"]} for r in tr.currency_summary(base).orderBy("original_currency").collect()},
            "rate_data": {"foreign_transactions": rates["foreign_transactions"], "with_original_amount_and_rate": rates["with_original_amount_and_rate"], "checkable_currencies": codes, "can_check_conversions": bool(codes)}, "notes": notes,
        }

    def suggest_category_rules(self, limit: int = 20) -> dict:
        got = rows(q.top_uncategorized(self.store.ledger(), limit))
        return {"merchants": got, "returned": len(got), "existing_categories": sorted({r.category for r in self._rules()}), "rules_file": str(self.rules_path or RULES_FILE), "yaml_format": 'categories:\n  - category: Coffee\n    match:\n      - "first name|second name"\n'}

    def apply_category_rules(self) -> dict:
        return self.store.recategorize(self._rules() or BUILTIN)

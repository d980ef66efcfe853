"""Command line: import, status, subscriptions, categories, and a tool server where its library is installed."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from statwright import __version__


def home() -> Path:
    """``STATWRIGHT_HOME``, else the user's data folder."""
    if own := os.environ.get("STATWRIGHT_HOME"):
        return Path(own).expanduser()
    return Path(os.environ.get("XDG_DATA_HOME") or Path.home() / ".local" / "share").expanduser() / "statwright"


def tools():
    from statwright.api import RULES_FILE, Tools
    from statwright.session import local_session
    from statwright.store import Store

    return Tools(Store(local_session(), str(home() / "ledger")), home() / RULES_FILE)


def show(value: object) -> None:
    print(json.dumps(value, indent=2, default=str, ensure_ascii=False))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="statwright", description="Questions of your statement exports, answered locally.")
    p.add_argument("--version", action="version", version=f"statwright {__version__}")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("import", help="import a folder of exports, or one file")
    one.add_argument("path")
    one.add_argument("--force", action="store_true", help="also files that are already imported")
    sub.add_parser("status", help="what is there")
    subs = sub.add_parser("subscriptions", help="recurring charges")
    subs.add_argument("--min-confidence", type=float, default=0.55)
    subs.add_argument("--as-of", help="judge as at this day")
    subs.add_argument("--json", action="store_true")
    cat = sub.add_parser("categories", help="uncategorized merchants, or apply the rules again")
    cat.add_argument("--apply", action="store_true")
    cat.add_argument("--limit", type=int, default=20)
    sub.add_parser("serve", help="serve the tools over stdio")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "import" and not Path(args.path).expanduser().exists():
        print(f"error: {args.path} does not exist", file=sys.stderr)
        return 1
    t = tools()
    if args.command == "import":
        for r in t.import_statements(str(Path(args.path).expanduser()), args.force)["imported"]:
            print(f"{r['file']:<34} " + ("skipped (already imported)" if r["already_imported"] else f"{r['rows_inserted']} imported, {r['rows_skipped']} skipped"))
            for e in r["errors"][:3]:
                print(f"  x {e}")
    elif args.command == "status":
        show(t.overview())
    elif args.command == "subscriptions":
        got = t.find_subscriptions(min_confidence=args.min_confidence, as_of=args.as_of)
        if args.json:
            show(got["subscriptions"])
        elif not got["count"]:
            print("No recurring charges detected.")
        else:
            for s in got["subscriptions"]:
                print(f"{s['merchant']:<32} {s['cadence']:<10} {s['typical_amount']:>9,.2f} {s['annualized_cost']:>10,.2f}  {s['status']}")
            print(f"\n{got['active_count']} active: {got['active_annual_total']:,.2f} a year ({got['active_monthly_total']:,.2f} a month)")
    elif args.command == "categories":
        show(t.apply_category_rules() if args.apply else t.suggest_category_rules(args.limit))
    else:
        try:
            from mcp.server.fastmcp import FastMCP
        except ImportError:
            print("error: serving needs the mcp package", file=sys.stderr)
            return 1
        server = FastMCP("statwright")
        for name in ("import_statements", "overview", "spending_by_category", "spending_by_merchant", "monthly_summary", "find_subscriptions", "get_transactions", "compare_periods", "spending_by_country", "find_trips", "foreign_transaction_costs", "suggest_category_rules", "apply_category_rules"):
            server.tool()(getattr(t, name))
        server.run()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

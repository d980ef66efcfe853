"""Category rules in order, the first match wins; user rules go before the shipped ones."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from statwright.functions.fixed import CATEGORY_RULES, UNCATEGORIZED


@dataclass(frozen=True)
class CategoryRule:
    category: str
    field: str
    pattern: str
    source: str = "builtin"


BUILTIN = [CategoryRule(c, f, p) for c, f, ps in CATEGORY_RULES for p in ps]


def compiles(pattern: str) -> bool:
    """Whether the engine that runs the rules reads a pattern; without a session, whether Python does."""
    spark = SparkSession.getActiveSession()
    try:
        if spark is None:
            re.compile(pattern)
        else:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
    except (re.error, IllegalArgumentException):
        return False
    return True


def rules_from(entries: object, source: str = "user") -> list[CategoryRule]:
    """Rules from the entries of a rules file; what is malformed, or no regular expression, is left out."""
    out = []
    for e in (entries.get("categories") or []) if isinstance(entries, dict) else []:
        name = str(e.get("category", "")).strip() if isinstance(e, dict) else ""
        if not name:
            continue
        field = str(e.get("field", "merchant")).strip().lower()
        for p in e.get("match") or []:
            if not compiles(str(p)):
                continue
            out.append(CategoryRule(name, field if field in ("merchant", "description") else "merchant", str(p), source))
    return out


def load_rules(path: str | Path | None = None) -> list[CategoryRule]:
    """The rules of a YAML file, if it is there, and then the shipped ones."""
    if path and Path(path).is_file():
        import yaml

        return rules_from(yaml.safe_load(Path(path).read_text(encoding="utf-8"))) + BUILTIN
    return BUILTIN


def categorize(merchant: Column, description: Column, rules: list[CategoryRule] = BUILTIN) -> Column:
    """Rules of one category and field that follow each other are one pattern, so a row tries few."""
    merged: list[tuple[str, str, list[str]]] = []
    for r in rules:
        if merged and merged[-1][:2] == (r.category, r.field):
            merged[-1][2].append(r.pattern)
        else:
            merged.append((r.category, r.field, [r.pattern]))
    tests = [F.when((merchant if field == "merchant" else description).rlike("(?i)" + "|".join(f"(?:{p})" for p in ps)), F.lit(c)) for c, field, ps in merged]
    return F.coalesce(*tests, F.lit(UNCATEGORIZED))

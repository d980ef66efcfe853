"""Date columns of unknown format: every candidate format votes in one aggregation by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statwright.functions.fixed import DATE_FORMATS


def without_time(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(raw), r"[ T]\d{1,2}:\d{2}(:\d{2})?(\s*[AaPp][Mm])?\s*$", ""))


def parsed(raw: Column, fmt: str) -> Column:
    """The date under one of the known formats (by its strftime name), else null.

    Two-digit years go to 1969 to 2068. Shapes are matched first, as a parser
    may read more digits than a format has.
    """
    java = next(j for f, j, _ in DATE_FORMATS if f == fmt)
    text = without_time(raw)
    shape = "^" + "".join({"yyyy": r"\d{4}", "yy": r"\d{2}", "MMMM": r"\p{L}+", "MMM": r"\p{L}{3}", "M": r"\d{1,2}", "d": r"\d{1,2}"}.get(p, p.replace(".", r"\.")) for p in _fields(java)) + "$"
    value = F.try_to_date(text, java)
    if java.endswith("yy") and not java.endswith("yyyy"):
        value = F.when(F.year(value) > 2068, F.add_months(value, -1200)).otherwise(value)
    return F.when(text.rlike(shape), value)


def _fields(java: str) -> list[str]:
    import re

    return re.findall(r"y+|M+|d+|[^yMd]+", java)


def date_plans(rows: DataFrame) -> DataFrame:
    """(file, fmt, day_first, confidence) from rows (file, raw, hint, explicit); fmt is null where no format reads every value.

    A format is viable if no non-blank value fails. Neutral formats win; then
    the only reading left; then the one with the tighter span, from four values
    on and if the spans differ by more than 45 days; then the hint; then month first.
    """
    used = rows.where(F.coalesce(F.trim("raw"), F.lit("")) != "")
    # a file has few distinct values; each is parsed once under each format
    values = used.groupBy("file", "raw").agg(F.count("*").alias("times"), F.max("hint").alias("hint"), F.max("explicit").alias("explicit"))
    read = values.withColumn("read", F.array(*[parsed(F.col("raw"), fmt) for fmt, _, _ in DATE_FORMATS]))
    day = lambda k: F.get("read", k)
    tally = read.groupBy("file").agg(
        F.sum("times").alias("n"), F.max("hint").alias("hint"), F.max("explicit").alias("explicit"),
        *[x for k in range(len(DATE_FORMATS)) for x in (F.count_if(day(k).isNull()).alias(f"bad{k}"), F.datediff(F.max(day(k)), F.min(day(k))).alias(f"span{k}"))],
    )

    def first(flag: bool | None, of) -> Column:
        return F.coalesce(*[F.when(F.col(f"bad{k}") == 0, of(k)) for k, (_, _, day) in enumerate(DATE_FORMATS) if day is flag])

    name = lambda k: F.lit(DATE_FORMATS[k][0])
    span = lambda k: F.col(f"span{k}")
    neutral, day, month = first(None, name), first(True, name), first(False, name)
    day_span, month_span = first(True, span), first(False, span)
    spans = (F.col("n") >= 4) & (F.abs(day_span - month_span) > 45)
    own = F.coalesce(*[F.when((F.col("explicit") == f) & (F.col(f"bad{k}") == 0), f) for k, (f, _, _) in enumerate(DATE_FORMATS)])
    both = day.isNotNull() & month.isNotNull()

    def ladder(explicit, iso, one_day, one_month, tight_day, tight_month, hint_day, hint_month, default) -> Column:
        return (
            F.when(F.col("explicit").isNotNull(), explicit).when(neutral.isNotNull(), iso)
            .when(day.isNotNull() & month.isNull(), one_day).when(month.isNotNull() & day.isNull(), one_month)
            .when(both & spans & (day_span < month_span), tight_day).when(both & spans, tight_month)
            .when(both & F.col("hint"), hint_day).when(both & ~F.col("hint"), hint_month).when(both, default)
        )

    lit = lambda *xs: [F.lit(x) for x in xs]
    none = F.lit(None).cast("boolean")
    return tally.select(
        "file", ladder(own, neutral, day, month, day, month, day, month, month).alias("fmt"),
        ladder(F.col("hint"), none, *lit(True, False, True, False, True, False, False)).alias("day_first"),
        ladder(*lit(1.0, 1.0, 1.0, 1.0, 0.8, 0.8, 0.7, 0.7, 0.5)).alias("confidence"),
    )


def read_date(raw: Column, fmt: Column) -> Column:
    """The date under the row's own format."""
    out = F.lit(None).cast("date")
    for name, _, _ in DATE_FORMATS:
        out = F.when(fmt == name, parsed(raw, name)).otherwise(out)
    return out

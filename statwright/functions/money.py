"""Money cells as column expressions: magnitudes, cents, direction words, and per-file sign plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statwright.functions.fixed import CREDIT_WORDS, DEBIT_WORDS

DECIMAL = "decimal(24,6)"


def magnitude(raw: Column) -> Column:
    """The cell's value without sign, as a decimal; null if it is none.

    Of ``.`` and ``,`` the later one is the decimal separator. Commas alone are
    thousands, unless there is one with two digits after it.
    """
    kept = _digits(raw)
    plain = F.regexp_replace(kept, "-", "")
    dot, comma = F.instr(F.reverse(plain), "."), F.instr(F.reverse(plain), ",")
    number = (
        F.when((dot > 0) & (comma > 0), F.when(dot < comma, F.replace(plain, F.lit(","), F.lit(""))).otherwise(F.replace(F.replace(plain, F.lit("."), F.lit("")), F.lit(","), F.lit("."))))
        .when(comma > 0, F.when((comma == 3) & (F.length(plain) - F.length(F.replace(plain, F.lit(","), F.lit(""))) == 1), F.replace(plain, F.lit(","), F.lit("."))).otherwise(F.replace(plain, F.lit(","), F.lit(""))))
        .otherwise(plain)
    )
    return F.when(number.rlike(r"^(\d+\.?\d*|\.\d+)$"), number.try_cast(DECIMAL))


def _digits(raw: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(raw)), r"\b(dr|cr)\b\.?$", "")
    return F.regexp_replace(bare, r"[^\d,.\-]", "")


def marked_negative(raw: Column) -> Column:
    """Whether the cell has parentheses, or a minus at either end."""
    kept = _digits(raw)
    bare = F.regexp_replace(F.lower(F.trim(raw)), r"\b(dr|cr)\b\.?$", "")
    return (bare.contains("(") & bare.contains(")")) | kept.startswith("-") | kept.endswith("-")


def cents(value: Column) -> Column:
    """Half-up."""
    return F.round(value * 100, 0).cast("bigint")


def direction_word(raw: Column) -> Column:
    """-1 for money out, 1 for money in, null for neither."""
    word = F.regexp_replace(F.lower(F.trim(raw)), r"\.+$", "")
    return F.when(word.isin(DEBIT_WORDS), -1).when(word.isin(CREDIT_WORDS), 1)


def sign_plans(rows: DataFrame) -> DataFrame:
    """(file, mode, negative_is_outflow, confidence) from rows (file, amount, type, has_debit_credit, override): one aggregation by file."""
    known = F.count(direction_word(F.col("type")))
    n = F.count(magnitude(F.col("amount")))
    negative = F.count_if(magnitude(F.col("amount")).isNotNull() & marked_negative(F.col("amount")))
    tally = rows.groupBy("file").agg(F.max("has_debit_credit").alias("split"), F.max("override").alias("override"), n.alias("n"), negative.alias("neg"), known.alias("known"))
    pos = F.col("n") - F.col("neg")
    typed = (F.col("known") > 0) & (F.col("known") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2)))
    case = lambda a, b, c, d, e, f: F.when(F.col("split"), a).when(F.col("override").isNotNull(), b).when((F.col("neg") > 0) & (pos > 0), c).when(typed, d).when(F.col("neg") > 0, e).otherwise(f)
    return tally.select(
        "file", case("debit_credit", "signed", "signed", "typed", "signed", "assume_outflow").alias("mode"),
        F.coalesce(F.when(F.col("split"), F.lit(None)).otherwise(F.col("override")), F.lit(True)).alias("negative_is_outflow"),
        case(*[F.lit(x) for x in (1.0, 1.0, 0.99, 0.95, 0.9, 0.55)]).alias("confidence"),
    )


def signed_cents(mode: Column, negative_is_outflow: Column, amount: Column, debit: Column, credit: Column, kind: Column) -> Column:
    """The row's cents under its file's plan; null if a cell it needs is no amount."""
    side = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(0).cast(DECIMAL)).otherwise(magnitude(c))
    value, negative = cents(magnitude(amount)), marked_negative(amount)
    word = F.coalesce(direction_word(kind), F.when(negative, -1).otherwise(1))
    return (
        F.when(mode == "debit_credit", cents(side(credit) - side(debit)))
        .when(mode == "typed", value * word)
        .when(mode == "assume_outflow", -value)
        .otherwise(F.when(negative == negative_is_outflow, -value).otherwise(value))
    )

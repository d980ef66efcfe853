"""Ledger rows: identity, deduplication, accounts, and re-categorization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statwright.functions.categories import BUILTIN, CategoryRule, categorize


def normal_text(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")))


def with_occurrence(rows: DataFrame) -> DataFrame:
    """Numbers equal charges (day, cents, description) of a file from 0, in file order, so that two equal coffees both count."""
    order = Window.partitionBy("source_file", "posted_on", "amount_cents", normal_text(F.col("raw_description"))).orderBy("source_row")
    return rows.withColumn("occurrence", F.row_number().over(order) - 1)


def content_id(account: Column, day: Column, cents: Column, description: Column, occurrence: Column) -> Column:
    """The first 32 hex digits of the content's sha256."""
    parts = F.concat_ws("|", account, day.cast("string"), cents.cast("string"), normal_text(description), occurrence.cast("string"))
    return F.substring(F.sha2(parts.cast("binary"), 256), 1, 32)


def with_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id", content_id(F.col("account"), F.col("posted_on"), F.col("amount_cents"), F.col("raw_description"), F.col("occurrence")))


def first_of_each_id(rows: DataFrame) -> DataFrame:
    """One row an id: of the first file, and its first row."""
    columns = [c for c in rows.columns if c != "id"]
    kept = rows.groupBy("id").agg(F.min_by(F.struct(*columns), F.struct("source_file", "source_row")).alias("r"))
    return kept.select("id", "r.*").select(*rows.columns)


def insert_ignore(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows whose id the ledger lacks, one an id."""
    return first_of_each_id(rows).join(ledger.select("id"), "id", "left_anti")


def new_files(files: DataFrame, log: DataFrame) -> DataFrame:
    """The files whose content hash is not in the import log."""
    return files.join(log.select("file_hash"), "file_hash", "left_anti")


def accounts_to_add(accounts: DataFrame, rows: DataFrame, currency: str = "USD") -> DataFrame:
    """(account, currency) of accounts that rows name and the table lacks; a known account keeps its currency."""
    return rows.select("account").distinct().join(accounts.select("account"), "account", "left_anti").withColumn("currency", F.lit(currency))


def import_counters(rows: DataFrame, inserted: DataFrame) -> DataFrame:
    """(source_file, rows_read, rows_inserted, rows_skipped)."""
    n = inserted.groupBy("source_file").agg(F.count("*").alias("rows_inserted"))
    read = rows.groupBy("source_file").agg(F.count("*").alias("rows_read"))
    out = read.join(n, "source_file", "left").withColumn("rows_inserted", F.coalesce("rows_inserted", F.lit(0)))
    return out.withColumn("rows_skipped", F.col("rows_read") - F.col("rows_inserted"))


def recategorized(ledger: DataFrame, rules: list[CategoryRule] = BUILTIN) -> DataFrame:
    """The ledger under the rules as they are now; ``changed`` marks the rows whose category differs."""
    new = categorize(F.col("merchant"), F.col("raw_description"), rules)
    return ledger.withColumn("new_category", new).withColumn("changed", ~F.col("new_category").eqNullSafe(F.col("category"))).withColumn("category", F.col("new_category")).drop("new_category")


def recategorize_summary(ledger: DataFrame, rules: list[CategoryRule] = BUILTIN) -> DataFrame:
    return recategorized(ledger, rules).agg(F.count("*").alias("examined"), F.count_if("changed").alias("changed"))

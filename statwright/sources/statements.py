"""Statement files as rows: a reader for folders of exports of unknown layout, and their normalization.

Files are read by Spark (``binaryFile``), so any store it reaches will do. A
task turns each file into rows of role cells, or one error; all that follows is
column expressions: date and sign plans are aggregated by file and broadcast to
the rows where small, as Spark decides from their size. A PDF is read as its
ruled tables or else its lines, whose rows come from ``pages`` with the direction
that its section headings state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, fields
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statwright.functions import categories, foreign
from statwright.functions import money as m
from statwright.functions.dates import date_plans, read_date
from statwright.functions.merchants import normalize_merchant
from statwright.operators.ledger import with_id, with_occurrence
from statwright.sources import pages
from statwright.sources.layout import LayoutError, account_of, data_rows, layout_of

SUFFIXES = "*.{csv,tsv,txt,pdf,CSV,TSV,TXT,PDF}"
ROWS = "path string, source_file string, file_hash string, account string, source_row int, date string, description string, amount string, debit string, credit string, type string, currency string, has_debit_credit boolean, error string, detail string, directed boolean, layout string, checks string"
#: What a line of a PDF has besides.
LINE = ", page int, line_text string, x0 double, x1 double, top double"
ROLES = ("date", "description", "amount", "debit", "credit", "type", "currency")


@dataclass(frozen=True)
class Override:
    """What a user states about the exports of a folder; what is None is inferred."""

    date_column: str | None = None
    amount_column: str | None = None
    debit_column: str | None = None
    credit_column: str | None = None
    description_column: str | None = None
    date_format: str | None = None
    day_first: bool | None = None
    negative_is_outflow: bool | None = None
    account_name: str | None = None
    currency: str | None = None
    pdf_password: str | None = None
    skip_rows: int = 0

    @classmethod
    def of(cls, raw: object) -> Override:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in raw.items() if k in known}) if isinstance(raw, dict) else cls()


def load_override(spark: SparkSession, folder: str) -> Override:
    """The folder's ``statements.yaml``, where there is one."""
    import yaml

    found = spark.read.format("binaryFile").option("pathGlobFilter", "statements.yaml").load(folder).select("content").take(1)
    return Override.of(yaml.safe_load(bytes(found[0]["content"]).decode())) if found else Override()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, source_file, file_hash, content) of a folder's exports, not of its sub-folders, or of one file."""
    return named(spark.read.format("binaryFile").option("pathGlobFilter", SUFFIXES).load(path))


def named(files: DataFrame) -> DataFrame:
    """The same from binary files (path, content)."""
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("source_file"), F.sha2("content", 256).alias("file_hash"), "content")


def read_rows(files: DataFrame, override: Override = Override()) -> DataFrame:  # noqa: B008
    """Cells by role, a row a data row; a file that cannot be read gives one row with ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ROWS.split(", ")]
        for batch in batches:
            for f in batch.itertuples(index=False):
                base = {"path": f.path, "source_file": f.source_file, "file_hash": f.file_hash, "account": override.account_name or account_of(PurePosixPath(f.source_file).stem)}
                try:
                    layout, cells = layout_of(bytes(f.content), override.skip_rows)
                except LayoutError as e:
                    yield pd.DataFrame([base | {"error": str(e)}], columns=names, dtype=object)
                    continue
                roles = layout.roles | {r: c for r in ROLES[:5] if (c := getattr(override, f"{r}_column"))}
                split = {"debit", "credit"} <= roles.keys()
                base["layout"] = json.dumps({"encoding": layout.encoding, "delimiter": layout.delimiter, "header_row": layout.header_row, "roles": roles}, ensure_ascii=False)
                out = [base | {"source_row": layout.header_row + 2 + k, "has_debit_credit": split} | {r: row.get(c, "") for r, c in roles.items()} for k, row in enumerate(data_rows(layout, cells))]
                yield pd.DataFrame(out, columns=names, dtype=object)

    pdf = F.lower("source_file").endswith(".pdf")
    if files.where(pdf).select("source_file").isEmpty():
        return files.mapInPandas(run, ROWS)
    return files.where(~pdf).mapInPandas(run, ROWS).unionByName(_page_rows(files.where(pdf), override))


def _page_rows(files: DataFrame, override: Override) -> DataFrame:
    """The same of PDF files; ``directed`` tells that amounts already have a minus for money out."""
    read = pages.read_pdf

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in (ROWS + LINE).split(", ")]
        for batch in batches:
            for f in batch.itertuples(index=False):
                base = {"path": f.path, "source_file": f.source_file, "file_hash": f.file_hash, "account": override.account_name or account_of(PurePosixPath(f.source_file).stem)}
                try:
                    tables, lines = read(bytes(f.content), override.pdf_password)
                    if not lines and not tables:
                        raise LayoutError("the PDF holds no text; it may be a scan")
                except LayoutError as e:
                    yield pd.DataFrame([base | {"error": str(e)}], columns=names, dtype=object)
                    continue
                base["layout"] = json.dumps({"kind": "pdf", "ruled": bool(tables)})
                if grid := pages.ruled(tables):
                    roles = grid[0] | {r: c for r in ROLES[:5] if (c := getattr(override, f"{r}_column"))}
                    out = [base | {"source_row": 2 + k, "has_debit_credit": {"debit", "credit"} <= roles.keys()} | {r: row.get(c, "") for r, c in roles.items()} for k, row in enumerate(grid[1])]
                else:
                    out = [base | dict(zip(("page", "line_text", "x0", "x1", "top"), x, strict=True)) for x in lines]
                yield pd.DataFrame(out, columns=names, dtype=object)

    parsed = files.mapInPandas(run, ROWS + LINE)
    own = [c.split()[0] for c in ROWS.split(", ")]
    of_file = ["path", "source_file", "file_hash", "account", "layout"]
    lines = parsed.where("page IS NOT NULL")
    printed = lines.select(F.col("path").alias("file"), "page", F.col("line_text").alias("text"), "x0", "x1", "top")
    rows = pages.directed(pages.rows_of(printed))
    totals = pages.reconciled(printed, rows).where("printed IS NOT NULL")
    checks = totals.groupBy(F.col("file").alias("path")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("bucket", F.col("printed").cast("double").alias("printed"), F.col("extracted").cast("double").alias("extracted"), "ok")))).alias("checks"))
    stated = F.max(pages.sign_of(F.col("section")).isNotNull()).over(Window.partitionBy("file"))
    found = rows.withColumn("directed", stated).select(
        F.col("file").alias("path"), (F.col("row") + 1).cast("int").alias("source_row"), "date", "description",
        F.when(F.col("directed"), F.col("signed").cast("string")).otherwise(F.col("amount")).alias("amount"), F.lit(False).alias("has_debit_credit"), "detail", "directed",
    )
    joined = lines.select(of_file).distinct().join(found, "path", "left").join(checks, "path", "left")
    error = F.when(F.col("source_row").isNull(), "no rows that begin with a date and end with an amount were found")
    return parsed.where("page IS NULL").select(own).unionByName(joined.withColumn("error", error), allowMissingColumns=True).select(own)


def _plans(rows: DataFrame, override: Override) -> DataFrame:
    """(path, fmt, day_first, confidence, mode, negative_is_outflow) of the files that were read."""
    good = rows.where("error IS NULL")
    flag = lambda x, kind: F.lit(x).cast(kind)
    votes = good.select(F.col("path").alias("file"), F.col("date").alias("raw"), flag(override.day_first, "boolean").alias("hint"), flag(override.date_format, "string").alias("explicit"))
    signs = good.select(F.col("path").alias("file"), "amount", "type", "has_debit_credit", flag(override.negative_is_outflow, "boolean").alias("override"))
    both = date_plans(votes).join(m.sign_plans(signs).select("file", "mode", "negative_is_outflow"), "file")
    return both.select(F.col("file").alias("path"), "fmt", "day_first", "confidence", "mode", "negative_is_outflow")


def decisions(rows: DataFrame, override: Override = Override()) -> DataFrame:  # noqa: B008
    """(path, layout, date_format, day_first, date_confidence, sign_mode, negative_is_outflow): why a file came out as it did."""
    stated = rows.where("error IS NULL").groupBy("path").agg(F.max("layout").alias("layout"), F.max(F.coalesce("directed", F.lit(False))).alias("stated"))
    plans = _plans(rows, override).select("path", F.col("fmt").alias("date_format"), "day_first", F.col("confidence").alias("date_confidence"), F.col("mode").alias("sign_mode"), "negative_is_outflow")
    by_heading = F.col("stated")
    joined = stated.join(plans, "path", "left").withColumn("sign_mode", F.when(by_heading, "section").otherwise(F.col("sign_mode"))).withColumn("negative_is_outflow", by_heading | F.col("negative_is_outflow"))
    return joined.drop("stated")


def printed_totals(rows: DataFrame) -> dict[str, list[dict]]:
    """Of each statement with printed totals, these against the sums of its rows; a small list a file."""
    found = rows.where("checks IS NOT NULL").groupBy("source_file").agg(F.max("checks").alias("checks")).collect()
    return {r["source_file"]: json.loads(r["checks"]) for r in found}


def normalized(rows: DataFrame, override: Override = Override(), rules: list[categories.CategoryRule] = categories.BUILTIN, foreign_detail: str | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """The ledger rows, and (source_file, source_row, error) of what could not be read.

    A file of which some date fits no format fails as a whole. Rows without date
    or of zero cents are left out without error.
    """
    good = rows.where("error IS NULL")
    plans = _plans(rows, override).select("path", "fmt", "mode", "negative_is_outflow")
    home = override.currency or "USD"
    stated = F.coalesce("directed", F.lit(False))
    with_plans = good.join(plans, "path", "left").withColumn("mode", F.when(stated, "signed").otherwise(F.col("mode"))).withColumn("negative_is_outflow", stated | F.col("negative_is_outflow"))
    dated = with_plans.withColumn("posted_on", read_date(F.col("date"), F.col("fmt"))).withColumn("amount_cents", m.signed_cents(*[F.col(c) for c in ("mode", "negative_is_outflow", "amount", "debit", "credit", "type")]))
    blank = F.coalesce(F.trim("date"), F.lit("")) == ""
    bad = (
        rows.where("error IS NOT NULL").select("source_file", "source_row", "error")
        .unionByName(dated.where("fmt IS NULL").select("source_file", F.lit(None).cast("int").alias("source_row"), F.lit("no known date format reads every value").alias("error")).distinct())
        .unionByName(dated.where(F.col("fmt").isNotNull() & ~blank & F.col("amount_cents").isNull()).select("source_file", "source_row", F.lit("no amount").alias("error")))
    )
    text = F.trim(F.coalesce("description", F.lit("")))
    extra = F.coalesce(F.col(foreign_detail), F.lit("")) if foreign_detail else F.lit("")
    kept = dated.where(F.col("fmt").isNotNull() & ~blank & (F.col("amount_cents") != 0)).withColumn("raw_description", text)
    enriched = (
        kept.withColumn("f", foreign.analysed(F.col("raw_description"), extra, F.col("amount_cents"), home))
        .withColumn("merchant", normalize_merchant(foreign.without_fx(F.col("raw_description"))))
        .withColumn("category", categories.categorize(F.col("merchant"), F.col("raw_description"), rules))
        .withColumn("currency", F.when(F.coalesce(F.trim("currency"), F.lit("")) == "", home).otherwise(F.trim("currency")))
    )
    out = with_id(with_occurrence(enriched))
    return out.select("id", "account", "posted_on", "amount_cents", "currency", "raw_description", "merchant", "category", "source_file", "source_row", "occurrence", "f.original_amount_cents", "f.original_currency", "f.fx_rate", "f.country", "f.is_fee", "file_hash"), bad

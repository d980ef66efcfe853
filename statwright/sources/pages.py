"""Statement pages: positioned text lines to transaction rows, their direction, and a check against printed totals.

Input is a table of lines (file, page, text, x0, x1, top); a PDF extractor is
optional and only makes that table. What a line is, is told by column
expressions; which section and which row it belongs to, by running windows over
the file's lines, so no file is walked in Python.
"""

from __future__ import annotations

import io

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statwright.functions.fixed import CONTINUATIONS, INDENT, LEADING_DATE, METADATA_LINE, MONEY_COLUMN, NOT_A_ROW, PAGE_WIDTH, PRINTED_MONEY, SECTIONS, SKIP_SECTION, YEAR_TOTAL
from statwright.functions.foreign import foreign_amount, fx_rate
from statwright.sources.layout import LayoutError, has_money, roles_of

SIGN_OF = {name: sign for _, sign, name in SECTIONS}


def section_of(text: Column) -> Column:
    """The section that a heading names; null for one to skip or none."""
    return F.when(text.rlike(SKIP_SECTION), None).otherwise(F.coalesce(*[F.when(text.rlike(p), name) for p, _, name in SECTIONS]))


def sign_of(section: Column) -> Column:
    return F.coalesce(*[F.when(section == name, sign) for name, sign in SIGN_OF.items()])


def is_heading(text: Column) -> Column:
    """Short, of few words, without a sentence's end, and not begun by a date."""
    t = F.trim(text)
    return (t != "") & (F.length(t) <= 45) & ~t.rlike(r"[.,;:]$") & (F.size(F.split(t, r"\s+")) <= 5) & ~t.rlike(LEADING_DATE)


def printed_amount(raw: Column) -> Column:
    """The value without its sign."""
    digits = F.regexp_replace(raw, r"[^\d.]", "")
    return F.when(digits.rlike(r"^\d*\.?\d*$") & (digits != ""), digits.try_cast("decimal(20,2)"))


def printed_negative(raw: Column) -> Column:
    t = F.trim(raw)
    return t.startswith("-") | t.endswith("-") | F.upper(t).endswith("CR") | (t.contains("(") & t.contains(")"))


def _marked(lines: DataFrame) -> DataFrame:
    order = Window.partitionBy("file").orderBy("page", "top", "x0")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    text = F.trim("text")
    total = text.rlike(r"(?i)^total\b") & ~text.rlike(YEAR_TOTAL)
    heading = is_heading(text) & ~total
    detail, skip, section = text.rlike(r"(?i)\bdetail\b"), text.rlike(SKIP_SECTION), section_of(text)
    kind = F.when(total, "total").when(heading & detail, "detail").when(heading & skip, "skip").when(heading & section.isNotNull(), "section").when(text.rlike(LEADING_DATE), "dated").otherwise("other")
    money = F.regexp_extract_all(text, F.lit(PRINTED_MONEY), F.lit(1))
    last = F.element_at(F.when(F.size(money) > 0, money), -1)
    width = F.greatest(F.lit(PAGE_WIDTH), F.coalesce(F.max("x1").over(Window.partitionBy("file")), F.lit(0.0)))
    at = (
        lines.where(F.coalesce(F.trim("text"), F.lit("")) != "").withColumn("text", text).withColumn("line", F.row_number().over(order)).withColumn("kind", kind)
        .withColumn("edge", width * MONEY_COLUMN).withColumn("last_money", last)
        .withColumn("section", F.last(F.when(F.col("kind") == "section", section), ignorenulls=True).over(so_far))
        .withColumn("skipping", F.coalesce(F.last(F.when(F.col("kind").isin("detail", "section"), False).when(F.col("kind") == "skip", True), ignorenulls=True).over(so_far), F.lit(False)))
    )
    # the last amount must end the line, in the column of amounts
    ends = (F.col("last_money").isNotNull()) & (F.expr("length(substring_index(text, trim(last_money), -1)) <= 4")) & (F.col("x1") >= F.col("edge"))
    row = (F.col("kind") == "dated") & ~F.col("skipping") & ~F.col("text").rlike(NOT_A_ROW) & ends
    return at.withColumn("is_row", row).withColumn("row", F.sum(F.when(F.col("is_row"), 1).otherwise(0)).over(so_far))


def rows_of(lines: DataFrame) -> DataFrame:
    """(file, row, date, description, amount, section, detail): transactions as printed, with up to two continuation lines.

    A continuation stands under the description and left of the amounts; it goes
    to ``detail`` if it tells a foreign amount or rate, and to the description if
    it is neither money nor metadata.
    """
    at = _marked(lines)
    by_row = Window.partitionBy("file", "row").orderBy("line")
    so_far = by_row.rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(F.when(F.col("is_row"), F.col("x0")), ignorenulls=True).over(by_row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    closed = F.max(F.col("kind").isin("detail", "skip", "section").cast("int")).over(so_far)
    tells = foreign_amount(F.col("text")).isNotNull() | fx_rate(F.col("text")).isNotNull()
    name = ~F.col("text").rlike(METADATA_LINE) & F.col("last_money").isNull()
    under = (F.col("kind") == "other") & ~F.col("skipping") & (F.col("row") > 0) & (F.col("x0") - first >= INDENT) & (F.col("x0") < F.col("edge")) & (closed == 0)
    joined = at.withColumn("use", F.when(under & tells, "detail").when(under & name, "name"))
    joined = joined.withColumn("place", F.sum(F.when(F.col("use").isNotNull(), 1).otherwise(0)).over(so_far)).where(F.col("is_row") | (F.col("use").isNotNull() & (F.col("place") <= CONTINUATIONS)))
    collect = lambda use: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("use") == use, F.struct("line", "text")))), lambda x: x["text"]), " ")
    main = lambda c: F.max(F.when(F.col("is_row"), F.col(c)))
    grouped = joined.groupBy("file", "row").agg(main("text").alias("text"), main("last_money").alias("amount"), main("section").alias("section"), collect("name").alias("more"), collect("detail").alias("detail"))
    body = F.regexp_replace(F.expr("substring(text, 1, length(text) - length(substring_index(text, trim(amount), -1)) - length(trim(amount)))"), LEADING_DATE, "")
    return grouped.select("file", "row", F.regexp_extract("text", LEADING_DATE, 1).alias("date"), F.trim(F.concat_ws(" ", F.trim(body), F.col("more"))).alias("description"), F.trim("amount").alias("amount"), F.coalesce("section", F.lit("unknown")).alias("section"), "detail")


def directed(rows: DataFrame) -> DataFrame:
    """Adds ``signed``: the amount with a minus for money out. A section's usual printing is its heading's direction; rows printed the other way flip."""
    by = Window.partitionBy("file", "section")
    negative = printed_negative(F.col("amount"))
    most = 2 * F.sum(negative.cast("int")).over(by) > F.count("*").over(by)
    sign = sign_of(F.col("section"))
    way = F.when(sign.isNull(), F.when(negative, -1).otherwise(1)).when(negative != most, -sign).otherwise(sign)
    return rows.withColumn("signed", way * printed_amount(F.col("amount")))


def kinds(rows: DataFrame) -> DataFrame:
    """(file, kind): bank, credit_card or unknown, by the sections that its rows stand in."""
    any_of = lambda *names: F.max(F.col("section").isin(*names).cast("int")) == 1
    return rows.groupBy("file").agg(F.when(any_of("deposits", "withdrawals"), "bank").when(any_of("charges", "payments_credits", "payments", "credits", "fees", "interest"), "credit_card").otherwise("unknown").alias("kind"))


def reconciled(lines: DataFrame, rows: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(file, bucket, printed, extracted, ok): the totals that a statement prints against the sums of its rows; ok is null where it prints none."""
    totals = _marked(lines).where((F.col("kind") == "total") & F.col("last_money").isNotNull())
    label = F.lower(F.trim(F.regexp_replace(F.regexp_replace("text", PRINTED_MONEY, ""), r"\s+", " ")))
    named = totals.select("file", label.alias("label"), printed_amount(F.col("last_money")).alias("value")).withColumn("sign", sign_of(section_of(F.col("label")))).where("sign IS NOT NULL").distinct()
    bucket = lambda c: F.when(c > 0, "in").otherwise("out").alias("bucket")
    printed = named.groupBy("file", bucket(F.col("sign"))).agg(F.sum("value").alias("printed"))
    sums = rows.groupBy("file", bucket(F.col("signed"))).agg(F.sum(F.abs("signed")).alias("extracted"))
    both = printed.join(sums, ["file", "bucket"], "full").withColumn("extracted", F.coalesce("extracted", F.lit(0).cast("decimal(20,2)")))
    return both.withColumn("ok", F.abs(F.col("printed") - F.col("extracted")) <= F.lit(tolerance).cast("decimal(4,2)"))


def ruled(tables: list[list[list]]) -> tuple[dict[str, str], list[dict[str, str]]] | None:
    """(roles, rows by header cell) of tables drawn with lines, of which one of the first three rows names a date and money; null for fewer than two rows."""
    header, roles, out = [], {}, []
    for table in tables:
        cells = [[str(c or "").strip() for c in row] for row in table]
        for at, head in enumerate(cells[:3] if len(cells) > 1 else []):
            found = roles_of(head)
            if "date" in found and has_money(found):
                header, roles = (header, roles) if roles else (head, found)
                out += [dict(zip(header, [*row, *[""] * len(header)], strict=False)) for row in cells[at + 1 :] if any(row)]
                break
    return (roles, out) if len(out) > 1 else None


def read_pdf(content: bytes, password: str | None = None) -> tuple[list[list[list]], list[tuple]]:
    """The ruled tables of a PDF and its lines (page, text, x0, x1, top), by an optional library."""
    try:
        import pdfplumber
    except ImportError as e:
        raise LayoutError("reading PDF files needs pdfplumber; a table of lines works without") from e
    try:
        with pdfplumber.open(io.BytesIO(content), password=password or "") as pdf:
            tables = [t for page in pdf.pages for t in page.extract_tables()]
            return tables, [(k, x["text"], float(x["x0"]), float(x["x1"]), float(x["top"])) for k, page in enumerate(pdf.pages) for x in page.extract_text_lines()]
    except Exception as e:
        if b"/Encrypt" in content[:2048] or b"/Encrypt" in content[-4096:]:
            raise LayoutError("the file is locked; a pdf_password in statements.yaml is missing or wrong") from e
        raise LayoutError(f"the file could not be opened as a PDF: {str(e) or type(e).__name__}") from e

"""Quality rules as a bitmask ledger.

Every rule is evaluated once a document: the ledger keeps its measurements and a
bigint with a bit for each failed rule. A policy is a mask of rules; applying
another version, or asking what each rule alone removes, reads only the ledger.

Words are runs outside ``[\\x20\\x09-\\x0D]``. A null text has no words, an empty
table gives an empty ledger, repeated rows are judged alike, and a null id keeps
its row. Other columns of the documents are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statwright.llm.common import SPACE, fresh, let

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper"]

#: Bit, name, and the failing condition over MEASURES in SQL that Spark and DuckDB read alike.
RULES: list[tuple[int, str, str]] = [
    (0, "too_few_words", "n_words < 50"),
    (1, "repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbols", "10 * n_symbols > 2 * n_words"),
    (3, "word_length", "(2 * word_chars < 5 * n_words OR word_chars > 14 * n_words)"),
    (4, "duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    (5, "shouting", "2 * n_upper > word_chars"),
]
BASE = 0b11
#: Versioned policies: the mask of the rules that reject.
POLICIES = {"v1": 0b000011, "v2": 0b111111}
CURRENT = "v2"


def _repeated_words(ws: Column, n: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, counted once each.

    Windows are compared by a 64-bit hash of their words. Only if some window
    repeats are (hash, position) pairs sorted; equal neighbours mark positions,
    and the union of the marked windows is summed from the gaps between them.
    """

    def marked(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        same = lambda a, b: a["h"] == b["h"]
        return F.filter(
            F.transform(pairs, lambda p, i: F.when(((i > 0) & same(F.get(pairs, i - 1), p)) | ((i < last) & same(F.get(pairs, i + 1), p)), p["i"])),
            lambda i: i.isNotNull(),
        )

    def covered(at: Column) -> Column:
        return F.aggregate(
            at, F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("end")),
            lambda a, i: F.struct((a["sum"] + i + 3 - F.greatest(a["end"], i)).alias("sum"), (i + 3).alias("end")),
            lambda a: a["sum"],
        )

    def of(hs: Column) -> Column:
        paired = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(
            let(paired, lambda ps: let(F.sort_array(marked(ps)), covered))
        )

    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
    return F.when(n < 4, F.lit(0)).otherwise(let(hashes, of))


def measured(text: Column) -> Column:
    """A struct of MEASURES, longs."""

    def of(t: Column) -> Column:
        lost = lambda p: F.length(t) - F.length(F.regexp_replace(t, p, ""))

        def with_words(ws: Column) -> Column:
            lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
            return let(lines, lambda ls: F.struct(*[c.cast("long").alias(k) for k, c in {
                "n_words": F.size(ws),
                "word_chars": F.length(F.array_join(ws, "")),
                "n_symbols": lost(r"[#*$%&|<>]+"),
                "n_lines": F.size(ls),
                "n_dup_lines": F.size(ls) - F.size(F.array_distinct(ls)),
                "n_repeat_words": _repeated_words(ws, F.size(ws)),
                "n_upper": lost(r"[A-Z]+"),
            }.items()]))

        return let(F.filter(F.split(t, SPACE), lambda w: w != ""), with_words)

    return let(F.coalesce(text, F.lit("")), of)


def _bits(m: Callable[[str], str]) -> str:
    """The ledger's bits as SQL; ``m`` renames a measure."""
    import re

    rename = lambda sql: re.sub(r"\bn_\w+|\bword_chars\b", lambda x: m(x[0]), sql)
    return " + ".join(f"CASE WHEN {rename(sql)} THEN {1 << bit} ELSE 0 END" for bit, _, sql in RULES)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, MEASURES, fail_bits) a row of ``docs``; no shuffle."""
    return (
        docs.select(F.col(id_col).alias(id_col), measured(F.col(text_col)).alias("m"))
        .select(id_col, *[F.col(f"m.{k}").alias(k) for k in MEASURES])
        .withColumn("fail_bits", F.expr(f"CAST({_bits(str)} AS BIGINT)"))
    )


def apply_policy(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """Adds base_failed and kept under a policy; the base rules are part of every policy."""
    bits = F.col("fail_bits")
    return book.withColumn("base_failed", bits.bitwiseAND(F.lit(BASE)) != 0).withColumn("kept", bits.bitwiseAND(F.lit(POLICIES[version] | BASE)) == 0)


def ablations(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """(rule, failed, only): documents that fail a rule, and those that the policy would keep without it.

    The ledger is first counted by its bits, which have few patterns; rules are read off these.
    """
    mask = POLICIES[version] | BASE
    patterns = book.groupBy("fail_bits").agg(F.count("*").alias("n"))
    bits, of = F.col("fail_bits"), lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    rules = [F.struct(F.lit(name).alias("rule"), of(bits.bitwiseAND(F.lit(1 << bit)) != 0).alias("failed"), of(bits.bitwiseAND(F.lit(mask)) == (1 << bit)).alias("only")) for bit, name, _ in RULES]
    return patterns.agg(F.array(*rules).alias("rules")).select(F.inline("rules"))


def keep(docs: DataFrame, version: str = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows that the policy keeps, with the columns of ``docs``; no join."""
    name = fresh(docs, "measured_text")
    mask = POLICIES[version] | BASE
    return (
        docs.withColumn(name, measured(docs[text_col]))
        .where(F.expr(f"(({_bits(lambda k: f'`{name}`.{k}')}) & {mask}) = 0")).drop(name)
    )

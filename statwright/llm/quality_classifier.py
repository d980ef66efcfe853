"""Quality classifier: a sparse rule ensemble over statistics of a text.

Boosted trees are grown on a bounded labelled sample; every path of them is a
conjunctive rule; an L1 logistic regression keeps few rules; what it keeps is
compiled into one column expression, so scoring is a projection without Python.

Null and empty texts have all statistics 0 and are scored like any other; long
texts are measured whole; a score of one half is predicted 1. Rows are scored one
by one, so repeated rows and ids each keep their row, and so do null ids. In a fit
a repeated id counts once, with the least of its statistics, and a repeated label
with its largest. An empty table gives an empty result; without labels every
score is 0.5. Extra columns are not read, whatever their names; the id column
must not be named like a column of the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statwright.llm.common import SPACE, fresh, labelled_sample, let
from statwright.llm.trees import Rule, fit_boosted, fit_lasso, rule_column, rule_matrix, rules_of

STATISTICS = ["n_words", "mean_word_chars", "symbols_per_word", "exclaims_per_word", "digits_per_word", "upper_share", "distinct_words", "richness", "repeats_last_word", "distinct_lines", "words_per_line"]
#: Labelled rows that the fit uses at most.
SAMPLE = 20_000


def _lost(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def statistics(text: Column) -> Column:
    """A struct of STATISTICS, doubles."""

    def of(t: Column) -> Column:
        lines = F.split(t, "\n")
        ratio = lambda a, b: (a / F.greatest(b, F.lit(1))).cast("double")

        def with_words(ws: Column) -> Column:
            n = F.size(ws)
            chars = F.length(F.array_join(ws, ""))
            return let(lines, lambda ls: F.struct(
                n.cast("double").alias("n_words"),
                ratio(chars, n).alias("mean_word_chars"),
                ratio(_lost(t, r"[#*$%&|<>]+"), n).alias("symbols_per_word"),
                ratio(F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit(""))), n).alias("exclaims_per_word"),
                ratio(_lost(t, r"[0-9]+"), n).alias("digits_per_word"),
                ratio(_lost(t, r"\p{Lu}+"), chars).alias("upper_share"),
                ratio(F.size(F.array_distinct(ws)), n).alias("distinct_words"),
                (F.log1p(F.size(F.array_distinct(ws))) / F.log1p(F.greatest(n, F.lit(1)))).alias("richness"),
                ratio(F.size(F.filter(ws, lambda w, i: (i > 0) & (w == F.get(ws, i - 1)))), n).alias("repeats_last_word"),
                ratio(F.size(F.array_distinct(ls)), F.size(ls)).alias("distinct_lines"),
                ratio(n, F.size(ls)).alias("words_per_line"),
            ))

        return let(F.filter(F.split(t, SPACE), lambda w: w != ""), with_words)

    return let(F.coalesce(text, F.lit("")), of)


@dataclass
class RuleEnsemble:
    """An intercept and weighted rules over STATISTICS."""

    intercept: float
    rules: list[tuple[Rule, float]]

    def column(self, stats: str) -> Column:
        """The probability of label 1, from the struct column ``stats``."""
        names = [f"`{stats}`.{s}" for s in STATISTICS]
        z = F.lit(float(self.intercept))
        for rule, w in self.rules:
            z = z + F.when(rule_column(rule, names), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    def described(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{STATISTICS[f]} {'<=' if low else '>'} {t:.4g}" for f, low, t in rule) for rule, w in self.rules]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", held: int = 1, modulus: int = 3, sample: int = SAMPLE, trees: int = 12, depth: int = 3, lasso: float = 2e-3, id_col: str = "doc_id", text_col: str = "text") -> RuleEnsemble:
    """Fits on at most ``sample`` labelled rows whose crc32 bucket is not ``held``.

    The sampled ids (``sample`` rows of 12 bytes at most) are broadcast, so the
    documents are read once and only those of the sample are measured.
    """
    chosen = F.broadcast(labelled_sample(labels, label, held, modulus, sample, id_col))
    measured = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("id", "y", statistics(F.col("text")).alias("s"))
    # one row an id, so at most ``sample`` rows come to the driver
    rows = measured.groupBy("id", "y").agg(F.min("s").alias("s")).select("id", "y", *[F.col(f"s.{n}").alias(n) for n in STATISTICS]).collect()
    rows = sorted(map(tuple, rows))
    x = np.array([r[2:] for r in rows], dtype=float).reshape(-1, len(STATISTICS))
    y = np.array([r[1] > 0 for r in rows], dtype=float)
    _, grown = fit_boosted(x, y, trees, depth)
    rules = rules_of(grown)
    b, w = fit_lasso(rule_matrix(rules, x), y, lasso)
    return RuleEnsemble(b, [(r, float(v)) for r, v in zip(rules, w, strict=True) if v])


def score(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) a row of ``docs``."""
    s = fresh(docs, "statistics")
    measured = docs.select(F.col(id_col).alias(id_col), statistics(F.col(text_col)).alias(s))
    return measured.select(id_col, model.column(s).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep(docs: DataFrame, model: RuleEnsemble, text_col: str = "text") -> DataFrame:
    """The rows predicted as label 1, with the columns of ``docs``; evaluated in place, without a join."""
    return docs.where(_probability(docs, model, text_col) >= 0.5)


def _probability(docs: DataFrame, model: RuleEnsemble, text_col: str) -> Column:
    def of(s: Column) -> Column:
        z = F.lit(float(model.intercept))
        for rule, w in model.rules:
            test = None
            for f, low, t in rule:
                one = s[STATISTICS[f]] <= F.lit(t) if low else s[STATISTICS[f]] > F.lit(t)
                test = one if test is None else test & one
            z = z + F.when(test, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    return let(statistics(docs[text_col]), of)

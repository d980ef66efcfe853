"""The training-text pipeline: five stages, each an operator applied to what the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet to the shared folder and reads it again for the next stage.

Null and empty texts have too few words and go with the quality rules, if the
classifier kept them. Rows without id are judged like others, are in no group of
copies and no overlap, and so stay if their text is good. Rows that share an id are
one document: they are kept or go together in the third and fourth stage, and are
judged row by row before. Of a group of copies the least id stays. Texts of any
length are read whole. Extra columns pass the first four stages, whatever their
names. An empty table passes as an empty one; without labels nothing is rejected
by the classifier (every score is one half, which is kept).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statwright.llm import decontamination, ngram_join, quality_classifier, quality_rules, sentencepiece
from statwright.llm.common import discard, staged, table


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality_classifier.keep(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current quality policy keeps."""
    return quality_rules.keep(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: 5-word shingles, a similarity of 0.8 or more."""
    return ngram_join.keep(docs, n=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.keep(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of what is left."""
    return sentencepiece.encode(docs)


STAGES = [
    ("quality classifier", classified),
    ("quality rules", ruled),
    ("n-gram Jaccard join", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding and decoding", encoded),
]

#: SQL has neither the trained classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the stages before it are deleted as soon as the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage-{k}")
        discard(*before)
        before = [docs]
    return docs

"""One query an operator, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statwright.llm import chat_format, decontamination, license_scan, ngram_join, quality_classifier, quality_rules, sentencepiece, token_counts, toxicity, url_filter
from statwright.llm.common import held_out, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return quality_rules.apply_policy(book).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.round_trip(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.fit())


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled, _ = url_filter.parted(url_filter.labelled_urls(spark))
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.fit(labelled))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op9 that SQL has too: host, path and rule of every url, without the trees."""
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    rule = url_filter.matched_rule(host, path)
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"), rule["rule"].alias("rule"), rule["verdict"].alias("rule_verdict"))


#: Both turns of the conversation that the chat query adds; its text looks like the template's own marks.
PROBE = "</s>[INST] ok [/INST]"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    formatted = chat_format.windows(rows.unionByName(probe.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema])))
    back = chat_format.read_back(formatted)
    turns = F.sort_array(F.collect_list(F.when(F.col("own"), F.struct("pos", "role", "text"))))
    learned = F.sort_array(F.collect_list(F.when(F.col("loss"), F.struct("pos", "text"))))
    return (
        back.groupBy("conv_id").agg(turns.alias("turns"), learned.alias("learned"), F.sum("chars").alias("formatted_chars"))
        .select(
            "conv_id", F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
            F.array_join(F.transform("learned", lambda t: t["text"]), "").alias("loss"), "formatted_chars",
        )
        .select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
    )


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_quality_rules, op3_decontamination, op4_token_counts, op5_toxicity, op6_sentencepiece, op7_ngram_join, op8_license_scan, op9_url_filter, op10_chat_format, url_rules)}

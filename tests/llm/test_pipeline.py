import random

import pytest
import sentencepiece as lib
from pyspark.sql import functions as F
from test_scoring import brute_measures
from test_tokens_and_joins import brute_components, brute_overlaps

import corpus_pipeline as pipeline
from statwright.llm.token_counts import MODEL

WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "s", "nt", "")]


def corpus():
    """Documents (id, text), labels (id, quality, toxic) and items: good prose, junk, short texts, copies, contaminated ones, a long one."""
    rng = random.Random(8)
    say = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items = [(k, " ".join(say(30))) for k in range(4)]
    docs, junk = [(k, say(120)) for k in range(200)], set()
    for k in range(200, 260):
        docs.append((k, [rng.choice(WORDS[:3]) + "###"] * 80))
        junk.add(k)
    for k in range(260, 290):  # near copies of near copies
        base = list(docs[rng.randrange(40)][1])
        for _ in range(rng.choice([0, 1, 3, 12])):
            base[rng.randrange(len(base))] = "other"
        docs.append((k, base))
    for k in range(290, 310):
        ws = items[k % 4][1].split()
        for p in rng.sample(range(30), rng.choice([0, 2, 4, 25])):
            ws[p] = "other"
        docs.append((k, say(60) + ws + say(40)))
    docs += [(k, say(20)) for k in range(310, 320)] + [(400, say(30_000)), (401, ["aaa"] * 90)]
    rows = [(k, " ".join(ws)) for k, ws in docs] + [(500, None), (501, ""), (None, " ".join(say(120))), (5, " ".join(docs[5][1]))]
    labels = [(k, int(k not in junk), 0) for k, _ in docs if k < 320]
    return rows, labels, items, junk


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows, labels, items):
        spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "id": F.lit(1), "token": F.lit("x")}).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
        return str(tmp_path)

    return write


def test_run_equals_brute_force(spark, folder):
    rows, labels, items, junk = corpus()
    from statwright.llm.quality_rules import RULES

    measure = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), range(5), strict=True))

    def good(text):
        m = brute_measures(text)
        upper = sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text or "")
        values = {k: m[at] for k, at in measure.items()} | {"n_lines": sum(x.strip() != "" for x in (text or "").split("\n")), "n_upper": upper}
        return not any(eval(sql.replace("OR", "or"), {}, values) for _, _, sql in RULES)

    left = [(d, t) for d, t in rows if d not in junk and good(t)]
    group = {d: c for d, _, c in brute_components(left, 5, 80)}
    left = [(d, t) for d, t in left if d is None or group[d] == d]
    leaky = {d for d, _ in brute_overlaps(left, items)}
    left = [(d, t) for d, t in left if d not in leaky]
    assert 150 < len(left) < 230 and (None in {d for d, _ in left}) and 400 in dict(left) and len(leaky) > 5
    reference = lib.SentencePieceProcessor(model_file=MODEL)
    got = pipeline.run(spark, folder(rows, labels, items)).collect()
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], list(r["ids"])) for r in got), key=order) == sorted(((d, reference.encode(t)) for d, t in left), key=order)


def test_an_empty_table_passes(spark, folder):
    assert pipeline.run(spark, folder([], [], [])).count() == 0


def test_stages_keep_columns(spark, folder):
    sf = folder(*corpus()[:3])
    docs = spark.read.parquet(sf + "/documents.parquet")
    for _, stage in pipeline.STAGES[:2]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "id", "token"]

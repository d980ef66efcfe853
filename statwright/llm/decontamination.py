"""Benchmark decontamination by spaced seeds.

Fixed masks over consecutive words leave some positions out, so a hash of the
other positions survives a substitution there. Seeds of the benchmark are joined
with those of the documents; each hit names a diagonal (where in the document an
item would begin), and on each diagonal hit once the item's words are compared
one by one, which tolerates substitutions anywhere.

Everything is column expressions and joins. The diagonals (document, item, place)
are written; the ids of their documents pick these out of the table, so only
documents with a hit are moved. What is broadcast, the benchmark's seeds and words
and those ids, is measured in bytes and within a bound; beyond it both sides are
shuffled by their key.

Words are lower-cased runs of letters and digits. A null text has no words, a long
one is searched whole. Rows that share an id count as one document; a row without
id is not tested and kept. Items of fewer than six words hold no seed and match
nothing. Repeated items are reported under each of their ids; of an item's
diagonals in a document the columns tell the best of each, so ties do not matter.
Empty tables give empty results. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statwright.llm.common import broadcast_bytes, staged

#: 1: the word counts. Five words each, over spans of six and seven.
MASKS = ["110111", "111011", "1100111"]
#: Bytes in memory that are broadcast at most.
BOUND = 32 << 20
#: A leak has this share of an item's words in place, so many of some WINDOW consecutive ones, or so many on end.
SHARE, WINDOW, IN_WINDOW, ON_END = 0.6, 20, 16, 13


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashes(ws: Column, mask: int, last: Column) -> Column:
    """Hashes of mask number ``mask`` at positions 0 to ``last``."""
    at = [k for k, c in enumerate(MASKS[mask]) if c == "1"]
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(mask), *[F.get(ws, i + k) for k in at]))


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """(h, item_id, j) from items (item_id, ws)."""
    parts = None
    for m, mask in enumerate(MASKS):
        one = items.where(F.size("ws") >= len(mask)).select("item_id", F.posexplode(_hashes(F.col("ws"), m, F.size("ws") - len(mask))).alias("j", "h"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def document_seeds(docs: DataFrame) -> DataFrame:
    """(doc_id, h, i) from documents (doc_id, text): all masks at all positions; a word behind the end counts as none."""
    with_words = docs.select("doc_id", F.transform(F.array(tokens(F.col("text"))), lambda ws_: F.struct(F.size(ws_).alias("n"), _every(ws_).alias("hs")))[0].alias("s"))
    return with_words.select("doc_id", F.col("s.n").alias("n"), F.posexplode("s.hs").alias("at", "h")).select("doc_id", "h", (F.col("at") % F.col("n")).alias("i"))


def _every(ws: Column) -> Column:
    return F.when(F.size(ws) >= min(map(len, MASKS)), F.flatten(F.array(*[_hashes(ws, m, F.size(ws) - 1) for m in range(len(MASKS))])))


def overlaps(documents: DataFrame, benchmark: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, item_words, matched, best_window, best_run): the leaks, one row a document and item."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull())
    items = benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text_col)).alias("ws")).where(F.col("item_id").isNotNull())
    seeds = benchmark_seeds(items)
    hits = document_seeds(docs).join(_bounded(seeds), "h").select("doc_id", "item_id", (F.col("i") - F.col("j")).alias("diagonal")).distinct()
    hits = staged(hits, "diagonals")
    hit_docs = docs.join(_bounded(hits.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", tokens(F.col("text")).alias("own"))
    found = hit_docs.join(hits, "doc_id").join(_bounded(items), "item_id")
    in_place = F.transform("ws", lambda w, j: F.when(F.get("own", F.col("diagonal") + j) == w, 1).otherwise(0))
    sums = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size("hit") - WINDOW + 1, F.lit(1))), lambda k: sums(F.slice("hit", k, WINDOW)))
    run = F.aggregate(
        "hit", F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda a, x: F.struct(F.when(x == 1, a["now"] + 1).otherwise(0).alias("now"), F.greatest(a["best"], F.when(x == 1, a["now"] + 1).otherwise(0)).alias("best")), lambda a: a["best"],
    )
    judged = found.select("doc_id", "item_id", F.size("ws").alias("item_words"), in_place.alias("hit")).select("doc_id", "item_id", "item_words", sums(F.col("hit")).alias("matched"), F.array_max(windows).alias("best_window"), run.alias("best_run"))
    leak = (F.col("matched") >= share * F.col("item_words")) | (F.col("best_window") >= IN_WINDOW) | (F.col("best_run") >= ON_END)
    return judged.where(leak).groupBy("doc_id", "item_id").agg(*[F.max(c).cast("long").alias(c) for c in ("item_words", "matched", "best_window", "best_run")])


def _bounded(side: DataFrame) -> DataFrame:
    """A join's side, to be broadcast if its measured size is within the bound."""
    return F.broadcast(side) if broadcast_bytes(side) <= BOUND else side


def keep(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` whose document overlaps no item; all columns stay."""
    leaks = staged(overlaps(documents, benchmark, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias(id_col)).distinct(), "leaks")
    return documents.join(_bounded(leaks), id_col, "left_anti")

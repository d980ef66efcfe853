"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

All of a row's work is column expressions: the host and path, the longest
fitting rule (the few rules are a literal), the features and the trees, compiled
to nested ``when``. The trees are fitted on the driver on a bounded labelled
list of urls; their features of it are computed by the same expressions.

Besides length, depth, digits, entropy, parameters and the suffix's rate of
blocks, two features read the host's letters: the log odds of its runs of four
letters in blocked and other hosts, as a sum and the largest. In a fit a url's
odds come from the half of the list that it is not in.

A null url, or one without ``://``, has empty host and path, no rule, and the
verdict of the trees on the url as text (null: on the empty text). A rule fits a
url whose path begins with the rule's, so none fits an empty path; of equally long
rules the one listed first wins. Urls of any length are read whole; a score of
one half blocks. Repeated rows get equal verdicts; a null id keeps its row; an
empty table gives an empty result; extra columns are not read, whatever their
names. The id column must not be named like a column of the result. An empty
labelled list gives 0.5, which blocks.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statwright.llm.common import bucket_of, fresh, let
from statwright.llm.trees import Tree, apply_tree, fit_boosted, sigmoid, tree_column

#: (verdict, host suffix, path prefix)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
FEATURES = ["url_chars", "host_chars", "depth", "digit_ratio", "entropy", "n_params", "host_labels", "hyphens", "host_digits", "longest_label", "suffix_chars", "suffix_block_rate", "gram_odds", "gram_most"]
#: Labelled urls that a fit uses at most.
SAMPLE = 20_000


def host_of(url: Column) -> Column:
    return _lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def _lower(text: Column) -> Column:
    """A-Z only, as hosts fold; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """A struct (rule, verdict) of the longest rule (host and path together) that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for _, (verdict, h, p) in sorted(enumerate(rules), key=lambda r: (len(r[1][1] + r[1][2]), -r[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


#: Letters of a run, least blocked and other hosts that have it, and the largest weight of one.
GRAM, GRAM_SUPPORT, GRAM_MOST = 4, 6, 3.0


def grams(host: Column) -> Column:
    """The distinct runs of GRAM letters a-z in the labels before the suffix."""
    name = F.regexp_extract(host, r"(?s)^(.*)\.[^.]*$", 1)
    # a look-ahead takes no letters, so runs overlap
    return F.array_distinct(F.regexp_extract_all(name, F.lit(f"(?=([a-z]{{{GRAM}}}))"), 1))


def gram_weights(hosts: list[tuple[list[str], bool]]) -> dict[str, float]:
    """Shrunk log odds of runs with some support, from labelled hosts (their runs, blocked)."""
    bad, good = Counter(g for gs, y in hosts if y for g in gs), Counter(g for gs, y in hosts if not y for g in gs)
    n_bad = max(1, sum(y for _, y in hosts))
    n_good = max(1, len(hosts) - n_bad)
    odds = {g: np.log((bad[g] + 1) / (n_bad + 2)) - np.log((good[g] + 1) / (n_good + 2)) for g in bad.keys() | good.keys() if bad[g] + good[g] >= GRAM_SUPPORT}
    return {g: round(float(np.clip(w, -GRAM_MOST, GRAM_MOST)), 4) for g, w in sorted(odds.items()) if abs(w) >= 0.7}


def features(url: Column, host: Column, path: Column, suffix_rate: dict[str, float], gram_odds: dict[str, float]) -> Column:
    """A struct of FEATURES, doubles."""
    known = F.create_map(*[F.lit(x) for item in gram_odds.items() for x in item]) if gram_odds else F.create_map(F.lit(""), F.lit(0.0))
    weighed = F.transform(grams(host), lambda g: F.coalesce(F.try_element_at(known, g), F.lit(0.0)))
    u = F.coalesce(url, F.lit(""))
    lost = lambda t, p: F.length(t) - F.length(F.regexp_replace(t, p, ""))
    n = F.greatest(F.length(u), F.lit(1))
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffix = F.coalesce(F.element_at(F.split(host, r"\."), -1), F.lit(""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    rate = F.lit(0.5)
    for s, r in sorted(suffix_rate.items()):
        rate = F.when(suffix == s, F.lit(float(r))).otherwise(rate)

    def entropy(chars: Column) -> Column:
        part = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.greatest(F.size(chars), F.lit(1))
        return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - let(part(c), lambda p: p * F.log2(p)))

    values = {
        "url_chars": F.length(u), "host_chars": F.length(host),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
        "digit_ratio": lost(u, r"[0-9]+") / n,
        "entropy": let(F.filter(F.split(host, ""), lambda x: x != ""), entropy),
        "n_params": F.size(F.filter(F.split(query, "&"), lambda x: x != "")),
        "host_labels": F.size(labels), "hyphens": lost(host, r"-+"), "host_digits": lost(host, r"[0-9]+"),
        "longest_label": F.coalesce(F.array_max(F.transform(labels, lambda x: F.length(x))), F.lit(0)),
        "suffix_chars": F.length(suffix), "suffix_block_rate": rate,
        "gram_odds": F.aggregate(weighed, F.lit(0.0), lambda a, w: a + w), "gram_most": F.coalesce(F.array_max(weighed), F.lit(0.0)),
    }
    return F.struct(*[values[k].cast("double").alias(k) for k in FEATURES])


@dataclass
class UrlModel:
    prior: float
    trees: list[Tree]
    suffix_rate: dict[str, float]
    gram_odds: dict[str, float] = field(default_factory=dict)

    def column(self, feats: str) -> Column:
        """The probability of a block, from the struct column ``feats``."""
        names = [f"`{feats}`.{f}" for f in FEATURES]
        z = F.lit(self.prior)
        for t in self.trees:
            z = z + tree_column(t, names)
        return 1 / (1 + F.exp(-z))


#: The words from which the default labelled list makes hosts; both kinds of site use those of BOTH.
UNWANTED = """casino poker slots betting bets jackpot roulette bingo gamble lottery pills pharma viagra cialis replica adult xxx porn sexy
cams escort dating spam ads adserver popup banner track tracker clicks loans payday credit forex bitcoin warez crack keygen torrent proxy phish
hack cheat diet weightloss miracle winner prize bonus""".split()
ORDINARY = """library weather garden museum recipes school history science travel music forum wiki journal city river market theatre nature sports
photo health report studio village software foundation university college church hospital council parish society institute archive gazette herald
observatory bakery bicycle railway harbour mountain cooking painting poetry language chess football orchestra academy charity""".split()
BOTH = "free best my the online shop world club news blog home win cheap hot deal now top club24 get store live play game".split()
SYLLABLES = "th er on an re ti ble sh ing or ea nt ta mo li ka ve do su pe ra ni lo ge".split()
#: Suffixes with their shares among 20 ordinary and 20 unwanted sites.
SUFFIXES = {"com": (7, 7), "org": (4, 2), "net": (3, 3), "de": (2, 1), "edu": (2, 0), "info": (1, 2), "top": (0, 2), "xyz": (1, 2), "click": (0, 1)}


def labelled_urls(spark: SparkSession, rows: int = 8000) -> DataFrame:
    """(url, blocked): a labelled list built by rule, used where the caller brings none.

    Half of it are unwanted sites: names with words of UNWANTED, alone or with
    others, joined by hyphens or not, or strings of random letters and digits. The
    others have words of ORDINARY, alone or with others, or invented names. Each
    further trait (hyphens, digits, depth, parameters, suffix, sub-domains) occurs in
    both kinds, at rates of their own, so none of them parts the list.
    """
    def draw(k: int, n: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n))

    one_of = lambda k, words: F.element_at(F.array(*map(F.lit, words)), (draw(k, len(words)) + 1).cast("int"))
    chance = lambda k, bad, good: draw(k, 100) < F.when(F.col("bad"), bad).otherwise(good)
    own = F.when(F.col("bad"), one_of(1, UNWANTED)).otherwise(one_of(2, ORDINARY))
    again = F.when(F.col("bad"), one_of(3, UNWANTED)).otherwise(one_of(4, ORDINARY))
    glue = F.when(chance(5, 50, 35), "-").otherwise("")
    invented = F.concat(*[one_of(10 + i, SYLLABLES) for i in range(2)], *[F.when(draw(15 + i, 2) == 0, one_of(20 + i, SYLLABLES)).otherwise("") for i in range(4)])
    random = F.substring(F.md5(F.col("id").cast("string")), F.lit(1), (draw(30, 9) + 6).cast("int"))
    kind = draw(31, 100)
    words = (
        F.when(kind < 25, own).when(kind < 45, F.concat(one_of(32, BOTH), glue, own)).when(kind < 60, F.concat(own, glue, again))
        .when(kind < 70, F.concat(one_of(33, BOTH), glue, own, glue, again)).when(kind < 78, F.concat(own, glue, one_of(34, BOTH)))
    )
    other = F.when(F.col("bad"), F.when(draw(35, 3) > 0, random).otherwise(invented)).otherwise(F.when(draw(35, 12) > 0, invented).otherwise(random))
    digits = F.when(chance(36, 25, 8), draw(37, 900).cast("string")).otherwise("")
    host = F.concat(
        F.when(chance(38, 20, 35), one_of(39, ["www.", "m.", "blog.", "en."])).otherwise(""), F.when(chance(40, 12, 4), F.concat(one_of(41, SYLLABLES), one_of(42, SYLLABLES), F.lit("."))).otherwise(""),
        F.coalesce(words, other), digits, F.when(draw(43, 3) == 0, ".example").otherwise(""), F.lit("."),
        F.when(F.col("bad"), one_of(44, [s for s, (_, n) in SUFFIXES.items() for _ in range(n)])).otherwise(one_of(44, [s for s, (n, _) in SUFFIXES.items() for _ in range(n)])),
    )
    depth = F.when(chance(45, 35, 20), 0).otherwise(draw(46, 4) + F.when(F.col("bad"), 0).otherwise(1))
    path = F.array_join(F.transform(F.sequence(F.lit(0), depth), lambda i: F.when(i == 0, F.lit("")).when(i == 1, one_of(47, ["en", "de", "fr", "es", "a", "item", "news", "go"])).when(i == 2, draw(48, 50_000).cast("string")).otherwise(one_of(49, [*ORDINARY, *BOTH]))), "/")
    end = F.when(depth > 0, one_of(50, ["", "/", ".html", "#top"])).otherwise(one_of(51, ["", "/"]))
    names = ["utm_source=feed", "page=2", "ref=x", "id=77", "aff=1290", "cid=9f2", "q=word", "lang=en"]
    params = F.when(chance(52, 45, 25), draw(53, 3) + 1 + F.when(F.col("bad"), draw(54, 2)).otherwise(0)).otherwise(0)
    query = F.when(params > 0, F.concat(F.lit("?"), F.array_join(F.transform(F.sequence(F.lit(1).cast("bigint"), params), lambda i: F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.xxhash64("id", i), F.lit(len(names))) + 1).cast("int"))), "&"))).otherwise("")
    made = spark.range(rows).withColumn("bad", F.col("id") % 2 == 1)
    return made.select(F.concat(F.when(chance(55, 45, 35), "http://").otherwise("https://"), host, path, F.when(end.startswith("#"), F.concat(query, end)).otherwise(F.concat(end, query))).alias("url"), F.col("bad").cast("int").alias("blocked"))


def _rows(labelled: DataFrame, sample: int, url_col: str, label_col: str) -> list[tuple]:
    """(url, y, runs of the host, suffix, FEATURES) of at most ``sample`` labelled urls, by hash order; nulls are left out, repeated rows count once."""
    chosen = (
        labelled.select(F.col(url_col).alias("url"), F.col(label_col).cast("int").alias("y")).where("url IS NOT NULL AND y IS NOT NULL").distinct()
        .orderBy(F.xxhash64("url"), "url", "y").limit(sample)
    )
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    got = chosen.select("url", "y", F.array_sort(grams(host)).alias("g"), F.element_at(F.split(host, r"\."), -1).alias("suffix"), features(F.col("url"), host, path, {}, {}).alias("f")).select("url", "y", "g", "suffix", "f.*").collect()
    return sorted(map(tuple, got))


def _matrix(rows: list[tuple], rate: dict[str, float], odds: list[dict[str, float]]) -> np.ndarray:
    """FEATURES of ``_rows``; row k's runs are weighed by ``odds[k % len(odds)]``."""
    out = []
    for k, r in enumerate(rows):
        ws = [odds[k % len(odds)].get(g, 0.0) for g in r[2]]
        out.append([*r[4:-3], rate.get(r[3], 0.5), sum(ws), max(ws, default=0.0)])
    return np.array(out, dtype=float).reshape(-1, len(FEATURES))


def fit(labelled: DataFrame, sample: int = SAMPLE, trees: int = 40, depth: int = 3, url_col: str = "url", label_col: str = "blocked") -> UrlModel:
    """Fits on at most ``sample`` labelled urls, by hash order; nulls are left out."""
    rows = _rows(labelled, sample, url_col, label_col)
    tally: dict[str, list[int]] = {}
    for r in rows:
        t = tally.setdefault(r[3], [0, 0])
        t[0] += r[1] > 0
        t[1] += 1
    # the rate is shrunk to one half, and kept for suffixes with some support only
    rate = {s: (b + 10) / (n + 20) for s, (b, n) in tally.items() if n >= 20}
    hosts = [(r[2], r[1] > 0) for r in rows]
    x = _matrix(rows, rate, [gram_weights(hosts[1::2]), gram_weights(hosts[::2])])
    prior, grown = fit_boosted(x, np.array([r[1] > 0 for r in rows], dtype=float), trees, depth)
    return UrlModel(prior, grown, rate, gram_weights(hosts))


def parted(labelled: DataFrame, url_col: str = "url") -> tuple[DataFrame, DataFrame]:
    """The part of a labelled list to fit on, and the fifth of it (by crc32 of the url) held out."""
    held = bucket_of(url_col, 5) == 0
    return labelled.where(~held), labelled.where(held)


def held_out_errors(labelled: DataFrame, model: UrlModel, url_col: str = "url", label_col: str = "blocked") -> dict[str, float]:
    """Shares of blocked urls that a model allows and of others that it blocks, and the best that one feature alone would do (both errors together)."""
    rows = _rows(labelled, SAMPLE, url_col, label_col)
    y = np.array([r[1] > 0 for r in rows])
    x = _matrix(rows, model.suffix_rate, [model.gram_odds])
    z = model.prior + sum(apply_tree(t, x) for t in model.trees)
    alone = min(min(np.mean((c > t) != y), np.mean((c <= t) != y)) for c in x.T for t in np.unique(c))
    wrong = (sigmoid(z) >= 0.5) != y
    return {"rows": len(rows), "blocked_allowed": float(wrong[y].mean()), "others_blocked": float(wrong[~y].mean()), "errors": float(wrong.mean()), "best_single_feature": float(alone)}


def judge(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, block_score) a row of ``pages``."""
    u, r, f, p = (fresh(pages, n) for n in ("url_read", "rule_found", "features_read", "parts_read"))
    parts = F.struct(host_of(F.col(u)).alias("host"), path_of(F.col(u)).alias("path"))
    known = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias(u)).withColumn(p, parts)
    host, path = F.col(f"`{p}`.host"), F.col(f"`{p}`.path")
    judged = known.withColumns({r: matched_rule(host, path, rules), f: features(F.col(u), host, path, model.suffix_rate, model.gram_odds)})
    score = model.column(f)
    return judged.select(id_col, host.alias("host"), path.alias("path"), F.col(f"`{r}`.rule").alias("rule"), F.col(f"`{r}`.verdict").alias("verdict"), score.alias("block_score")).withColumn("verdict", F.coalesce("verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")))

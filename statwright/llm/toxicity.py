"""Toxicity: a weighted finite-state grammar over clauses.

A lexicon maps words to classes: insults, whose stems and weights are learned
from a bounded labelled sample, and fixed lists of threats, targets, negations
and verbs of reported speech. Four small transducers read the classes of a
clause from left to right and pass them on, each scaling the weights that pass:
a target near an insult raises it, a threat counts only with a target before it,
a negation and a reporting verb lower what follows them. They are composed into
one machine, which runs over the clauses that hold an insult or a threat; an
Aho-Corasick automaton finds these in the whole text. A threat that stands
before the clause's first target waits for it, as scaled by the last two
transducers, and counts if the target comes within a few words. A document's score is a
logistic function of its clause scores, fitted on the same sample.

A null or empty text has no clauses. Texts of any length are read whole. Rows
are scored one by one, so repeated rows and ids, and null ids, keep their rows; a
score of one half is predicted 1. Of a word's stems the heaviest counts, and a
word of a fixed list is no insult. In a fit a repeated id counts once, with its most toxic text. An empty table gives an
empty result; with no labels nothing is learned and scores are low. Extra
columns are not read, whatever their names; the id column must not be named like
a column of the result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statwright.llm.common import fresh, labelled_sample, let, staged
from statwright.llm.trees import sigmoid

#: Labelled rows that the fit uses at most.
SAMPLE = 12_000
#: A stem is a word's beginning of this many letters at least and at most (of a longer word, its first LONGEST letters
#: tell); least share of the toxic documents (and three at least) that have it, least ratio of its rates in toxic and
#: other documents, and least log-likelihood ratio, which keeps chance and copies out.
SHORTEST, LONGEST, SUPPORT, LIFT, EVIDENCE = 4, 24, 0.01, 6.0, 22.0

#: The closed classes of the grammar, in English, German, French and Spanish. Threats in their inflections.
THREATS = """kill kills killed killing hurt hurts hurting destroy destroys destroyed destroying beat beats beaten beating burn burns burned
burnt burning shoot shoots shot shooting stab stabs stabbed stabbing strangle strangled strangling murder murdered murdering töten töte tötet
getötet schlagen schlage schlägt geschlagen vernichten vernichte vernichtet umbringen umgebracht tuer tue tué frapper frappe frappé détruire
détruit matar mato matas mata matado golpear golpeo golpea golpeado destruir destruyo destruye destruido""".split()
TARGETS = ["you", "your", "you're", "he", "she", "they", "them", "du", "dich", "dir", "ihr", "sie", "tu", "toi", "vous", "ils", "tú", "usted", "ustedes", "ellos"]
NEGATIONS = ["not", "never", "isn't", "aren't", "don't", "won't", "nicht", "kein", "keine", "niemals", "jamais", "nunca", "jamás"]
REPORTS = ["said", "says", "wrote", "called", "claimed", "quoted", "sagte", "schrieb", "nannte", "dit", "écrit", "dijo", "escribió", "llamó"]

#: Words after a threat within which its target may come.
AFTER = 4

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "ITGNRO"
CLAUSE_END = re.compile(r"[.!?;:\n]")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


@dataclass
class Transducer:
    """Deterministic: arcs[(state, class)] = (class passed on, scale, next state); no arc: the class passes, and the state becomes ``rest``'s."""

    arcs: dict[tuple[int, str], tuple[str, float, int]]
    rest: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, cls: str) -> tuple[str, float, int]:
        return self.arcs.get((state, cls), (cls, 1.0, self.rest.get(state, state)))


def within(trigger: str, reach: int, acts: dict[str, tuple[str, float]]) -> Transducer:
    """After ``trigger``, for ``reach`` words, the classes in ``acts`` are passed on and scaled as it says."""
    arcs: dict[tuple[int, str], tuple[str, float, int]] = {(0, trigger): (trigger, 1.0, reach)}
    for left in range(1, reach + 1):
        arcs[left, trigger] = (trigger, 1.0, reach)
        for cls, (out, scale) in acts.items():
            arcs[left, cls] = (out, scale, left - 1)
    return Transducer(arcs, {left: left - 1 for left in range(1, reach + 1)})


def unless(trigger: str, cls: str, scale: float) -> Transducer:
    """``cls`` is scaled where no ``trigger`` came before it in the clause."""
    return Transducer({(0, cls): (cls, scale, 0), (0, trigger): (trigger, 1.0, 1)})


def compose(first: Transducer, second: Transducer) -> Transducer:
    """One machine that does what ``second`` does with what ``first`` passes on; states are numbered pairs."""
    ids, queue, arcs = {(0, 0): 0}, [(0, 0)], {}
    while queue:
        a, b = pair = queue.pop()
        for cls in (INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER):
            mid, s1, a2 = first.step(a, cls)
            out, s2, b2 = second.step(b, mid)
            if (a2, b2) not in ids:
                ids[a2, b2] = len(ids)
                queue.append((a2, b2))
            arcs[ids[pair], cls] = (out, s1 * s2, ids[a2, b2])
    return Transducer(arcs)


def grammar() -> Transducer:
    aimed = within(TARGET, 4, {INSULT: (INSULT, 1.5)})
    threat = unless(TARGET, THREAT, 0.0)
    return compose(compose(aimed, threat), lowered())


def lowered() -> Transducer:
    negated = within(NEGATION, 3, {INSULT: (INSULT, 0.3), THREAT: (THREAT, 0.3)})
    reported = within(REPORT, 12, {INSULT: (INSULT, 0.5), THREAT: (THREAT, 0.5)})
    return compose(negated, reported)


@dataclass
class ToxicityModel:
    stems: dict[str, float]
    intercept: float = -3.0
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)


class Matcher:
    """Clause scores of texts under a lexicon."""

    THREAT_WEIGHT = 2.0

    def __init__(self, stems: dict[str, float]):
        import ahocorasick

        self.stems, self.machine, self.lowered = stems, grammar(), lowered()
        self.closed = {w: c for ws, c in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)) for w in ws}
        self.automaton = ahocorasick.Automaton()
        for w in [*stems, *THREATS]:
            self.automaton.add_word(w, len(w))
        self.automaton.make_automaton()

    def insult(self, word: str) -> float:
        """The weight of the word's heaviest stem; 0 for none."""
        return max((self.stems.get(word[:k], 0.0) for k in range(SHORTEST, min(len(word), LONGEST) + 1)), default=0.0)

    def clause(self, text: str) -> float:
        """The score of one pass from left to right; threats whose target comes later are left to ``late``."""
        state, total = 0, 0.0
        for word in WORD.findall(text):
            weight = self.insult(word)
            cls = self.closed.get(word) or (INSULT if weight else OTHER)
            out, scale, state = self.machine.step(state, cls)
            total += scale * (weight if out == INSULT else self.THREAT_WEIGHT if out == THREAT else 0.0)
        return total

    def late(self, text: str) -> float:
        """What the threats before the clause's first target add, if it comes within AFTER words."""
        state, waiting = 0, []
        for at, word in enumerate(WORD.findall(text)):
            cls = self.closed.get(word, OTHER)
            if cls == TARGET:
                return self.THREAT_WEIGHT * sum(scale for begun, scale in waiting if at - begun <= AFTER)
            _, scale, state = self.lowered.step(state, cls)
            if cls == THREAT:
                waiting.append((at, scale))
        return 0.0

    def features(self, text: str | None) -> tuple[float, float, float]:
        """log(1 + sum), the largest, and the share of 100 words of the clause scores."""
        text = (text or "").lower()
        total = most = 0.0
        done = 0
        for last, k in self.automaton.iter(text):
            start = last + 1 - k
            if last < done or (start and (text[start - 1].isalpha() or text[start - 1] == "'")):
                continue
            begin = done
            for m in CLAUSE_END.finditer(text, done, start):
                begin = m.end()
            stop = CLAUSE_END.search(text, last)
            done = stop.end() if stop else len(text)
            score = self.clause(text[begin:done]) + self.late(text[begin:done])
            total, most = total + score, max(most, score)
        return math.log1p(total), most, 100 * total / (1 + text.count(" ")) if total else 0.0


def learn_stems(docs: DataFrame, sample: DataFrame) -> dict[str, float]:
    """Stems (beginnings of words) with their log odds, from the documents of ``sample`` (columns id, y; bounded).

    Their number is bounded by the sample's: each has its share of the toxic documents.
    Each document counts once for each stem, and near copies, told by the least
    hash of their long words, as one document. A stem gives way to longer ones
    that hold most of its toxic documents at a much higher ratio.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}']+"), lambda w: F.length(w) >= SHORTEST))
    stems = let(F.col("words"), lambda ws: F.array_distinct(F.flatten(F.transform(ws, lambda w: F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length(w), F.lit(LONGEST))), lambda k: F.substring(w, F.lit(1), k))))))
    longs = F.filter("words", lambda w: F.length(w) >= 10)
    family = F.coalesce(F.array_min(F.transform(longs, lambda w: F.xxhash64(w))), F.xxhash64("id"))
    chosen = staged(docs.join(F.broadcast(sample), "id").select("id", "y", words.alias("words")).withColumn("family", family).dropDuplicates(["y", "family"]), "sampled")
    sizes = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, other = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    lift = (F.col("t") / toxic) / ((F.col("c") - F.col("t") + 0.5) / other)
    t, o = F.col("t").cast("double"), (F.col("c") - F.col("t")).cast("double")
    both = toxic + other
    term = lambda n, of: F.when(n > 0, n * F.log(n / (F.col("c") * of / both))).otherwise(0.0)
    rest = lambda n, of: F.when(of - n > 0, (of - n) * F.log((of - n) / ((both - F.col("c")) * of / both))).otherwise(0.0)
    evidence = 2 * (term(t, toxic) + term(o, other) + rest(t, toxic) + rest(o, other))
    rows = (
        chosen.select("y", F.explode(stems).alias("stem")).groupBy("stem").agg(F.sum("y").cast("long").alias("t"), F.count("*").alias("c"))
        .where((F.col("t") >= max(3, SUPPORT * toxic)) & (lift >= LIFT) & (evidence >= EVIDENCE)).collect()
    )
    found = {r["stem"]: (r["t"], (r["t"] / toxic) / ((r["c"] - r["t"] + 0.5) / other)) for r in rows}
    children: dict[str, list[str]] = {}
    for s in found:
        children.setdefault(s[:-1], []).append(s)
    kept: dict[str, float] = {}
    for s in sorted(found, key=len):
        t, ratio = found[s]
        if sum(found[c][0] for c in children.get(s, []) if found[c][1] >= 3 * ratio) >= 0.8 * t:
            continue
        shorter = [kept[s[:k]] for k in range(SHORTEST, len(s)) if s[:k] in kept]
        if not shorter or math.log(ratio) > max(shorter) + math.log(2):
            kept[s] = math.log(ratio)
    return {s: round(kept[s], 6) for s in sorted(kept)}


FEATURES = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType()), T.StructField("c", T.DoubleType())])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", held: int = 0, modulus: int = 5, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fits on at most ``sample`` labelled rows whose crc32 bucket is not ``held``; their ids are broadcast."""
    chosen = labelled_sample(labels, label, held, modulus, sample, id_col)
    spark = docs.sparkSession
    rows = [(r["id"], int(r["y"] > 0)) for r in chosen.collect()]
    kind = labels.schema[id_col].dataType.simpleString()
    chosen = spark.createDataFrame(sorted(rows), f"id {kind}, y int")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    stems = learn_stems(texts, chosen)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(stems)
        for batch in batches:
            out = pd.DataFrame([m.features(t) for t in batch["text"]], columns=["a", "b", "c"], dtype=float)
            yield pd.concat([batch[["id", "y"]].reset_index(drop=True), out], axis=1)

    got = texts.join(F.broadcast(chosen), "id").select("id", "y", "text").mapInPandas(run, f"id {kind}, y int, a double, b double, c double")
    # one row an id, so at most ``sample`` rows come to the driver
    data = sorted(map(tuple, got.groupBy("id", "y").agg(F.max(F.struct("a", "b", "c")).alias("f")).select("id", "y", "f.*").collect()))
    if not data:
        return ToxicityModel(stems)
    x, y = np.array([r[2:] for r in data], dtype=float), np.array([r[1] for r in data], dtype=float)
    b, w = _logistic(x, y)
    return ToxicityModel(stems, b, tuple(float(v) for v in w))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> tuple[float, np.ndarray]:
    """Ridge logistic regression by Newton steps on scaled features; weights below 0 are not allowed, as more toxic clauses never lower a score."""
    scale = np.maximum(x.max(axis=0), 1e-9)
    z = np.column_stack([x / scale, np.ones(len(y))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = sigmoid(z @ w)
        g = z.T @ (p - y) / len(y) + l2 * w
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + (l2 + 1e-9) * np.eye(len(w))
        new = w - np.linalg.solve(h, g)
        new[:-1] = np.maximum(new[:-1], 0)
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return float(w[-1]), w[:-1] / scale


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) a row of ``docs``."""
    schema, read = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]), fresh(docs, "text_read")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(model.stems)
        w = np.array(model.weights)
        for batch in batches:
            x = np.array([m.features(t) for t in batch[read]], dtype=float).reshape(-1, 3)
            p = sigmoid(x @ w + model.intercept)
            yield pd.DataFrame({id_col: batch[id_col].array, "score": p, "predicted": (p >= 0.5).astype("int32")})

    return docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(read)).mapInPandas(run, schema)

"""Token counts without tokens: a count-only Viterbi pass.

An Aho-Corasick automaton of the vocabulary enumerates the matches that end at
each character; the forward pass keeps the best score and the number of pieces
of the best path, and no back pointers are followed. Each distinct unit of a
task is counted once and remembered (up to a bound, then anew).

Two counts come from the same matches: ``n_tokens`` under the model's own kind,
and ``n_unigram`` reading the pieces and scores as a unigram vocabulary. For a
unigram model they are equal.

A null or empty text has no tokens; texts of any length are counted whole, unit
by unit; rows are counted one by one, so repeated rows and ids keep their rows, and
so do null ids. An empty table gives an empty result. Extra columns are not read,
whatever their names; the id column must not be named like a column of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statwright.llm.vocabulary import BPE, MARK, MEMORY, Vocabulary

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


#: Two counts in one integer, so that a text's counts are one sum.
HIGH = 1 << 40


class Counter:
    """Both counts of a text, from one pass of the automaton over each distinct unit."""

    def __init__(self, data: bytes):
        import ahocorasick

        self.v = Vocabulary(data)
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.v.ids.items():
            self.automaton.add_word(piece, (piece, len(piece), self.v.scores[i]))
        self.automaton.make_automaton()
        self.kept: dict[str, int] = {}

    def of(self, unit: str) -> int:
        """HIGH times the model's own count, plus the unigram count.

        The automaton reports the matches that end at a character longest first,
        so earlier starts are tried first and a later one must be strictly better.
        """
        v, n = self.v, len(unit)
        merging = v.kind == BPE
        by_place = merging and MARK * 2 in unit  # runs of marks have pieces of equal scores, which merge by place
        unpaired, unknown = v.unpaired, v.unknown_score
        last, own = [""] * (n + 1), [0] * (n + 1)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        best, single, paired, at = None, False, not merging or by_place, 0

        def close(end: int, best: float | None, single: bool, paired: bool) -> None:
            """Ends a cell: a character without a piece of its own may be spelled."""
            if not single:
                spelled = len(unit[end].encode("utf-8", "surrogatepass")) if v.bytes else 1
                if best is None or score[end] + unknown > best:
                    best, count[end + 1] = score[end] + unknown, count[end] + spelled
                if not paired:
                    own[end + 1] = own[end] + spelled
            score[end + 1] = best

        for end, (piece, k, s) in self.automaton.iter(unit):
            while at < end:
                close(at, best, single, paired)
                best, single, paired, at = None, False, not merging or by_place, at + 1
            start = end + 1 - k
            if k == 1:
                single = True
            if not paired and unpaired(last[start], piece):
                paired, last[end + 1], own[end + 1] = True, piece, own[start] + 1
            s += score[start]
            if best is None or s > best:
                best, count[end + 1] = s, count[start] + 1
        while at < n:
            close(at, best, single, paired)
            best, single, paired, at = None, False, not merging or by_place, at + 1
        if not merging:
            own = count
        return (len(v.ids_of(v.merged(unit))) if by_place else own[n]) * HIGH + count[n]

    def count(self, text: str) -> tuple[int, int]:
        kept, v = self.kept, self.v
        keys = v.keys(text)
        name = v.named
        if keys is None:
            keys, name = v.units(text), None
            kept = {}
        try:
            total = sum(map(kept.__getitem__, keys))
        except KeyError:
            for k in set(keys).difference(kept):
                kept[k] = sum(map(self.of, name(k))) if name else self.of(k)
            total = sum(map(kept.__getitem__, keys))
        if len(self.kept) > MEMORY:
            self.kept.clear()
        return divmod(total, HIGH)


def token_counts(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_unigram) a row of ``docs``. The model file (half a megabyte) is read on the driver and sent along."""
    with open(model, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("n_unigram", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(sent.value)
        for batch in batches:
            out = pd.DataFrame([counter.count(text or "") for text in batch["text"]], columns=["n_tokens", "n_unigram"], dtype="int64")
            out.insert(0, id_col, batch[id_col].array)
            yield out

    return docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text")).mapInPandas(run, schema)

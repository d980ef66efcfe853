"""SentencePiece encoding and decoding by a forward pass that shares prefixes.

The distinct units of a batch that are not known yet are sorted, which lays them
out as a trie in depth-first order: going from one to the next, the forward
cells and automaton states of their common prefix stay and only the rest is computed anew. The ids of
a text are those of its units, joined; decoding gives the text back exactly.

The model's own kind decides what the forward cells hold (see ``vocabulary``):
the shipped file is a BPE model, of which a plain unigram Viterbi would not give
the tokenizer's ids, so its cells hold the last piece under the pairs that
merging allows.

A null text is encoded like an empty one, to no ids, and decodes to the empty
text; a null list of ids decodes to null. Long texts are encoded whole, unit by
unit; a unit without spaces takes time in proportion to its length. Rows are
encoded one by one, so repeated rows and null ids keep theirs, in order within a
partition; of arcs that tie (unigram) the earliest start wins, as in the library.
An empty table gives an empty result. Extra columns are not read, whatever their
names; the id column must not be named like a column of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statwright.llm.common import released
from statwright.llm.token_counts import MODEL
from statwright.llm.vocabulary import MARK, UNIGRAM, Forward, Vocabulary

#: Distinct units (some 200 bytes each) of a generation, of which a worker remembers two, and pairs of pieces (some 350) that it remembers.
KEPT, PAIRS = 400_000, 250_000


class Encoder:
    """Ids of units are kept as little-endian 32-bit integers, so that a text's ids are one join."""

    def __init__(self, data: bytes, kind: int | None = None):
        self.v = Vocabulary(data, kind, PAIRS)
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learned(self, units: set[str]) -> dict[str, bytes]:
        """Segments units in the order of their trie."""
        cells, last, out = Forward(self.v), "", {}
        run, ids = cells.run, cells.ids
        for unit in sorted(units):
            if self.v.kind != UNIGRAM and MARK * 2 in unit:
                out[unit] = self.v.coded(self.v.ids_of(self.v.merged(unit)))  # equal scores merge by place
                continue
            same = 0
            for a, b in zip(last, unit):  # noqa: B905
                if a != b:
                    break
                same += 1
            run(unit, same)
            last, out[unit] = unit, ids()
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        v = self.v
        if len(self.kept) > KEPT:
            self.old, self.kept = self.kept, {}
        keys = [v.keys(t) for t in texts]
        units = [v.units(t) if k is None else None for k, t in zip(keys, texts, strict=True)]
        needed = set(chain.from_iterable(k for k in keys if k)).difference(self.kept)
        again = needed.intersection(self.old)
        self.kept.update((k, self.old[k]) for k in again)
        new = {k: v.named(k) for k in needed.difference(again)}
        odd = set(chain.from_iterable(u for u in units if u))
        found = self.learned(odd.union(chain.from_iterable(new.values())))
        self.kept.update((k, b"".join(map(found.__getitem__, us))) for k, us in new.items())
        of, found_of = self.kept.__getitem__, found.__getitem__
        return [b"".join(map(found_of, u) if k is None else map(of, k)) for k, u in zip(keys, units, strict=True)]


@lru_cache(maxsize=1)
def _encoder(data: bytes, kind: int | None) -> Encoder:
    """One encoder a worker process, so that its tasks share what it remembers and none leaves a vocabulary behind."""
    return Encoder(data, kind)


def _sent(docs: DataFrame, model: str):
    with open(model, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model: str = MODEL, kind: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) a row of ``docs``."""
    sent = _sent(docs, model)
    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value, kind)
        for batch in batches:
            for part in _parts(batch):
                ids = encoder.encode_all([t or "" for t in part.column("text").to_pylist()])
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [id_col, "ids"])

    return docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text")).mapInArrow(released(run), schema)


def decode(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) a row of ``encoded``."""
    sent = _sent(encoded, model)
    schema = T.StructType([encoded.schema[id_col], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = _encoder(sent.value, None).v
        for batch in batches:
            yield pd.DataFrame({id_col: batch[id_col].array, "text": [None if x is None else v.decoded(list(x)) for x in batch["ids"]]})

    return encoded.select(F.col(id_col).alias(id_col), F.col(ids_col).alias("ids")).mapInPandas(released(run), schema)


def round_trip(docs: DataFrame, model: str = MODEL, kind: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, exact): encodes and decodes in one pass, without moving the ids.

    ids_sha256 is the digest of the ids as little-endian 32-bit integers. A text with
    U+2581 decodes to spaces there, as with the library, and is not exact.
    """
    sent = _sent(docs, model)
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("exact", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value, kind)
        for batch in batches:
            for part in _parts(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                rows = []
                for text, ids in zip(texts, encoder.encode_all(texts), strict=True):
                    back = encoder.v.decoded(np.frombuffer(ids, dtype="<i4").tolist())
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text))
                n, ids_sha, back_sha, exact = zip(*rows, strict=True)
                columns = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string()), pa.array(exact, pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "exact"])

    return docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text")).mapInArrow(released(run), schema)


def _parts(batch: pa.RecordBatch, size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about so many bytes of text, or one longer text. Only a range's texts become Python strings."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // size
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    for lo, hi in zip(edges, edges[1:]):  # noqa: B905
        if hi > lo:
            yield batch.slice(lo, hi - lo)

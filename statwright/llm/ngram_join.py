"""Similarity self-join on word n-gram sets, by T-occurrence search.

A document's set is its distinct n-word shingles (64-bit hashes); two documents
link if ``100 * intersection >= percent * union``. What comes back is each
document's component, so links inside a component need not all be listed, but
none between components may be missed.

1. Documents with equal sets are one class, kept as its smallest id.
2. Of each set the smallest hashes are kept, so many that two linked sets must
   share T of these. T-occurrence search asks for the sets that share T tokens
   with a query's. As in DivideSkip, a query's longest inverted lists are not merged
   but probed: half of T are set aside (lists are long by their counts over all
   classes, so these are the tokens of passages that many documents hold), the
   short ones are merged, and a pair must occur in T less the lists set aside. The
   merge is the sort of a shuffle by token; the occurrences of a pair are summed.
3. A pair that meets in a list is bounded before it counts: each shingle flips one
   bit of a 512-bit parity sketch, so the bits that differ never exceed the shingles
   that differ. What has the occurrences is verified by probing: the smaller set's
   tokens, those of the long lists among them, are searched in the larger one by
   binary search until the required overlap is reached or out of reach. (That a
   document is in a token's list and that the token is in the document's set are one
   question; the set is the side that need not be moved for each token.)
4. To keep large groups of near copies from listing all their pairs, a first,
   linear pass links documents with neighbours in the lists of their smallest
   hashes; its components are found, and the complete search in 2 and 3 then only
   looks for pairs of different components. ``links`` leaves this pass out and gives
   all pairs of different sets.

Lists are of any length: the linear pass is dealt by ranges of (token, place), so a
list goes over as many tasks as it needs; in the search a list of more than BLOCK
rows is cut into blocks, and each two blocks meet in a task of their own. A task
holds two blocks, or the last rows of a list, at a time.

Nothing is capped. A null text or one without words has the empty set and links
with nothing; a long one is hashed piece by piece. Rows with one id are one
document, linked by all their texts, and each gives a row; a null id has no
component. A pair on the threshold links. An empty table gives an empty result.
Extra columns are not read, whatever their names; the id column must not be named
like a column of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statwright.llm.common import broadcast_bytes, discard, released, staged

#: Bits of a parity sketch, in longs of 64.
SKETCH = 8
#: Rows of an inverted list that are searched in one task, with as many others.
BLOCK = 1024
#: Inverted lists beyond this length are long, in levels by powers of four.
LONG = 64
#: Smallest hashes by whose lists the linear pass looks for neighbours; each list has an order of its own.
KEYS = 4
#: Endpoint ids that are broadcast at most.
ID_BOUND = 500_000
#: Bytes in memory of the classes that are broadcast at most.
BOUND = 32 << 20
#: Edges that one task joins at most (some 150 bytes each in memory).
EDGE_BOUND = 500_000
#: Bytes of text that are hashed at once.
SEGMENT = 1 << 20
#: Texts, or pairs of whole sets, that are handed to Python at once (a set of 300 shingles has 2.4 KB).
ROWS = 1000

U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, size=256, dtype=np.int64).astype(U) * U(2) + U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class _Powers:
    up = np.ones(1, U)
    down = np.ones(1, U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = max(n, 1 << 16)
            cls.up = np.concatenate([np.ones(1, U), np.cumprod(np.full(size, _BASE, U))])
            cls.down = np.concatenate([np.ones(1, U), np.cumprod(np.full(size, _INVERSE, U))])
        return cls.up[:n], cls.down[:n]


def _words(data: bytes) -> np.ndarray:
    """Hashes of the words of a piece of text: a polynomial over its bytes, from prefix sums."""
    b = np.frombuffer(data, np.uint8)
    space = np.empty(len(b) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = _SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, U)
    up, down = _Powers.of(len(b) + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(_BYTE[b] * up[: len(b)])])
    return _mixed((sums[end] - sums[start]) * down[start])


def word_hashes(text: str) -> np.ndarray:
    """Of words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; long texts go piece by piece, cut at white space."""
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= SEGMENT:
        return _words(data)
    out, at = [], 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        out.append(_words(data[at:end]))
        at = end
    return np.concatenate(out)


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of n-word shingles; fewer words: of the whole sequence."""
    h = word_hashes(text or "")
    if not len(h):
        return h
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, U)
    for i in range(k):
        out = _mixed(out * U(_BASE) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def least_overlap(n: int, percent: int) -> int:
    """Of a set of ``n`` with any set that it links with."""
    return -(-percent * n // 100)


def threshold(n: int, percent: int) -> int:
    """T: tokens of their smallest hashes that a set of ``n`` shares with any that it links with, if both keep so many more."""
    p = n - least_overlap(n, percent) + 1
    return max(1, min(p, 3 * n // 10 - p + 1))


@lru_cache(maxsize=100_000)
def sizes(n: int, percent: int) -> tuple[int, int, int]:
    """Of a set of ``n``: the smallest hashes kept, the lists merged, and the occurrences asked for in these.

    It keeps p - 1 + T hashes (p = n - least_overlap + 1), of which a linked set
    shares T; of these under any order T - 1 may be left aside, so that at least
    one occurrence is in the rest, or T - k for k occurrences. T is the least of
    all sizes that can link, and k half of it.
    """
    least = least_overlap(n, percent)
    t = min(threshold(m, percent) for m in range(least, 100 * n // percent + 1))
    kept = n - least + threshold(n, percent)
    k = max(1, t // 2)
    return kept, min(kept, kept - t + k), k


def sketch(s: np.ndarray) -> np.ndarray:
    bits = np.bincount((_mixed(s ^ U(0xD6E8FEB86659FD93)) >> U(55)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _row(text: str | None, n: int, percent: int) -> tuple:
    s = shingles(text, n)
    if not len(s):
        return 0, 0, 0, 0, 0, [], []
    at = np.arange(1, len(s) + 1, dtype=U)
    with np.errstate(over="ignore"):
        f1, f2 = _mixed(s * at).sum(dtype=U), _mixed(s ^ (at * U(_INVERSE))).sum(dtype=U)
    kept, merged, k = sizes(len(s), percent)
    return len(s), int(f1.view(np.int64)), int(f2.view(np.int64)), merged, k, sketch(s), s[:kept].view(np.int64)


def features(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(id, n, f1, f2, merged, k, sketch, least) from documents (id, text)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([_row(t, n, percent) for t in batch["text"]], columns=["n", "f1", "f2", "merged", "k", "sketch", "least"])
            out.insert(0, "id", batch["id"].array)
            yield out

    return docs.mapInPandas(released(run), f"id {kind}, n bigint, f1 bigint, f2 bigint, merged int, k int, sketch array<bigint>, least array<bigint>")


class Run:
    """Columns of rows sorted by token, as arrays: token, id, n, and (in the second pass) k, comp and block (-1: met with all, else with other blocks only)."""

    COLUMNS = ("token", "id", "n", "k", "comp", "block")

    def __init__(self, batch: pd.DataFrame | None = None):
        self.of = {} if batch is None else {c: batch[c].to_numpy() for c in self.COLUMNS if c in batch}
        self.sketch = np.empty((0, SKETCH), U) if batch is None else np.stack(batch["sketch"].to_numpy()).view(U)

    def __len__(self) -> int:
        return len(self.sketch)

    def cut(self, lo: int, hi: int) -> Run:
        out = Run()
        out.of, out.sketch = {c: v[lo:hi] for c, v in self.of.items()}, self.sketch[lo:hi]
        return out

    def joined(self, other: Run) -> Run:
        if not len(self):
            return other
        out = Run()
        out.of = {c: np.concatenate([v, other.of[c]]) for c, v in self.of.items()}
        out.sketch = np.concatenate([self.sketch, other.sketch])
        return out


def _whole_runs(batches: Iterator[pd.DataFrame]) -> Iterator[Run]:
    """The rows again, in portions that end where a token ends."""
    held = Run()
    for batch in batches:
        if not len(batch):
            continue
        held = held.joined(Run(batch))
        token = held.of["token"]
        end = int(np.searchsorted(token, token[-1], side="left"))
        if end:
            yield held.cut(0, end)
            held = held.cut(end, len(held))
    if len(held):
        yield held


def _with_tails(batches: Iterator[pd.DataFrame], reach: int) -> Iterator[tuple[Run, int]]:
    """The rows again, each portion after the last ``reach`` rows before it, and how many these are."""
    tail = Run()
    for batch in batches:
        if len(batch):
            both = tail.joined(Run(batch))
            yield both, len(tail)
            tail = both.cut(max(0, len(both) - reach), len(both))


def most_different(total: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of two linked sets whose sizes sum to ``total``."""
    return total - 2 * -(-percent * total // (100 + percent))


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _may_link(run: Run, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Of row pairs, whether their sizes and sketches leave a link possible."""
    n = run.of["n"]
    total = n[i] + n[j]
    ok = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
    at = np.flatnonzero(ok)
    ok[at] = _differ(run.sketch[i[at]], run.sketch[j[at]]) <= most_different(total[at], percent)
    return ok


#: Rows of a list before a row among which the linear pass looks.
REACH = 64


def neighbours(run: Run, begin: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs: each row from ``begin`` on with the nearest one of the REACH before it, in its token's list, that it may link with. Linear; need not be complete."""
    token, open_rows = run.of["token"], np.arange(begin, len(run))
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for d in range(1, REACH + 1):
        open_rows = open_rows[open_rows >= d]
        rows = open_rows[token[open_rows] == token[open_rows - d]]
        ok = _may_link(run, rows - d, rows, percent)
        left.append(rows[ok] - d)
        right.append(rows[ok])
        open_rows = rows[~ok]
    return np.concatenate(left), np.concatenate(right)


def meeting(run: Run, percent: int, short: int = 64, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All row pairs of a token's list with different components that may link.

    Lists up to ``short`` are compared together, by the distance of their rows;
    longer ones in portions of rows sorted by size.
    """
    token, comp, part = run.of["token"], run.of["comp"], run.of["block"]
    strangers = lambda i, j: (comp[i] != comp[j]) & ((part[i] < 0) | (part[i] != part[j]))
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    sizes_of = np.diff(np.r_[starts, len(token)])
    rows = np.flatnonzero(np.repeat((sizes_of > 1) & (sizes_of <= short), sizes_of))
    for d in range(1, short):
        rows = rows[rows + d < len(token)]
        rows = rows[token[rows] == token[rows + d]]
        if not len(rows):
            break
        apart = rows[strangers(rows, rows + d)]
        ok = apart[_may_link(run, apart, apart + d, percent)]
        if len(ok):
            yield ok, ok + d
    for start, size in zip(starts[sizes_of > short].tolist(), sizes_of[sizes_of > short].tolist(), strict=True):
        one = comp[start : start + size]
        if (one == one[0]).all():
            continue
        order = start + np.argsort(run.of["n"][start : start + size], kind="stable")
        n = run.of["n"][order]
        sk, comps, parts = run.sketch[order], comp[order], part[order]
        for lo in range(0, size, block):
            hi = min(lo + block, size)
            last = int(np.searchsorted(n, 100 * n[hi - 1] // percent, side="right"))
            for at in range(lo, last, 4096):
                to = min(at + 4096, last)
                d = np.zeros((hi - lo, to - at), np.int64)
                for k in range(SKETCH):
                    d += np.bitwise_count(sk[lo:hi, None, k] ^ sk[None, at:to, k])
                ok = (d <= most_different(n[lo:hi, None] + n[None, at:to], percent)) & (comps[lo:hi, None] != comps[None, at:to])
                ok &= (parts[lo:hi, None] < 0) | (parts[lo:hi, None] != parts[None, at:to])
                i, j = np.nonzero(ok)
                up = i + lo < j + at
                if up.any():
                    yield order[i[up] + lo], order[j[up] + at]


def reaches(small: np.ndarray, large: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link: the smaller's hashes are probed into the larger by binary search, in growing portions, until the outcome is certain."""
    if len(small) > len(large):
        small, large = large, small
    need = -(-percent * (len(small) + len(large)) // (100 + percent))
    found, done, step = 0, 0, 64
    while done < len(small):
        if found + len(small) - done < need:
            return False
        part = small[done : done + step]
        at = np.searchsorted(large, part)
        at[at == len(large)] = 0
        found += int((large[at] == part).sum())
        done, step = done + len(part), 2 * step
    return found >= need


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, written. Only the endpoints' texts are read into sets; these are written once, joined to both sides, and deleted."""
    kind = docs.schema["id"].dataType.simpleString()
    ends = staged(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ends")
    few = F.broadcast(ends) if ends.count() <= ID_BOUND else ends

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"].array, "s": [shingles(t, n).view(np.int64) for t in batch["text"]]})

    of = staged(docs.join(few, "id").mapInPandas(released(sets), f"id {kind}, s array<bigint>"), "sets", ROWS)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = [len(x) > 0 and len(y) > 0 and reaches(np.asarray(x).view(U), np.asarray(y).view(U), percent) for x, y in zip(batch["sa"], batch["sb"], strict=True)]
            yield batch.loc[np.array(ok, bool), ["a", "b"]]

    joined = pairs.join(of.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(of.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    out = staged(joined.select("a", "b", "sa", "sb").mapInPandas(released(probe), f"a {kind}, b {kind}"), "links", ROWS)
    discard(ends, of)
    return out


def _joined(edges: DataFrame) -> DataFrame:
    """(id, comp) in one task, by union-find; for a counted, bounded number of edges."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least: dict = {}

        def root(x):
            while (up := least.setdefault(x, x)) != x:
                least[x] = x = least[up]
            return x

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
                a, b = sorted((root(a), root(b)))
                least[b] = a
        ids = list(least)
        yield pd.DataFrame({"id": ids, "comp": [root(x) for x in ids]}, dtype=object)

    return edges.coalesce(1).mapInPandas(released(run), f"id {kind}, comp {kind}")


def connected(edges: DataFrame) -> DataFrame:
    """(id, comp) of the ids on edges (a, b): the least id that each reaches.

    Up to EDGE_BOUND edges are joined in one task. More are not: labels travel
    along edges and jump, and each round is written.
    """
    if edges.count() <= EDGE_BOUND:
        return staged(_joined(edges), "labels")
    both = staged(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")), "labels")
    before = None
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy(both["a"].alias("id")).agg(F.min("comp").alias("m"))
        lower = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        roots = labels.select(F.col("id").alias("r"), F.col("comp").alias("root"))
        new = staged(lower.join(roots, F.col("comp") == F.col("r"), "left").select("id", "old", F.least("comp", F.coalesce("root", "comp")).alias("comp")), "labels")
        discard(labels if before is None else before)
        labels, before = new.select("id", "comp"), new
        if new.where(F.col("old") != F.col("comp")).isEmpty():
            return labels


#: Parts into which the members of a class are dealt where the classes are not broadcast.
SALTS = 16


def _with_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with the rep of their class, if they share it with others. A class may hold a third of all rows, so these are salted where a broadcast is too large."""
    key = ["f1", "f2", "n"]
    if broadcast_bytes(classes) <= BOUND:
        return rows.join(F.broadcast(classes), key, "left")
    salted = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, [*key, "salt"], "left")


def _features(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of documents (id, text): members (id, n, rep), the features of the representatives of equal sets, and the links (a, b) between an id's own texts."""
    feats = staged(features(docs, n, percent), "features", ROWS)
    some = feats.where("n > 0 AND id IS NOT NULL")
    classes = staged(some.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"), "classes")
    own = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("id"))
    members = staged(_with_classes(feats.select("id", "n", "f1", "f2"), classes).select("id", "n", F.when(own.isNotNull(), F.coalesce("rep", own)).alias("rep")), "members")
    discard(classes)
    # an id with several texts is one document, and stands for all of them
    named = members.where("rep IS NOT NULL").groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.bool_or(F.col("rep") == F.col("id")).alias("stands"))
    copies = staged(named.where("NOT stands").select("id"), "copies")
    reps = some.join(F.broadcast(copies) if copies.count() <= ID_BOUND else copies, "id", "left_anti")
    same = members.join(named.where("lo <> hi").select("id"), "id").where("rep <> id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    return members, reps, same


def _ordered() -> list:
    return [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]


def _near(reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the linear pass, written."""
    kind = reps.schema["id"].dataType.simpleString()

    def led(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run, begin in _with_tails(batches, REACH):
            i, j = neighbours(run, begin, percent)
            yield pd.DataFrame({"a": run.of["id"][i], "b": run.of["id"][j]})

    # each list has an order of its own; ranges split a list where one task would hold too much of it
    lists = reps.select(F.explode(F.slice("least", 1, KEYS)).alias("token"), "id", "n", "sketch").withColumn("place", F.xxhash64("id", "token"))
    first = lists.repartitionByRange("token", "place").sortWithinPartitions("token", "place").mapInPandas(released(led), f"a {kind}, b {kind}")
    return staged(first.where("a <> b").select(*_ordered()).distinct(), "led")


def _search(reps: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components (``labels``: id, comp; others are their own) that have the occurrences, written."""
    kind = reps.schema["id"].dataType.simpleString()
    tokens = reps.select("id", F.posexplode("least").alias("pos", "token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    shared = tokens.join(counts, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "c"))).alias("shared"))
    # the kept hashes in order, but for long lists, which go last, the longer the later; a place in this order needs the shared ones only
    is_long = lambda x: x["c"] > LONG
    level = lambda x: F.ceil(F.log2(x["c"] / LONG) / 2)
    longs = F.sort_array(F.transform(F.filter("shared", is_long), lambda x: F.struct(level(x).alias("level"), x["pos"].alias("pos"), x["token"].alias("token"), x["c"].alias("c"))))
    short = F.filter("shared", lambda x: ~is_long(x))
    before = lambda x: F.size(F.filter("longs", lambda y: y["pos"] < x["pos"]))
    short_merged = F.filter(short, lambda x: x["pos"] - before(x) < F.col("merged"))
    room = F.greatest(F.col("merged") - (F.col("kept") - F.size("longs")), F.lit(0))
    listed = lambda x: F.struct(x["token"].alias("token"), F.ceil(x["c"] / BLOCK).cast("int").alias("blocks"))
    lists = F.concat(F.transform(short_merged, listed), F.transform(F.slice("longs", F.lit(1), room), listed))
    sketches = reps.select("id", "n", "k", "merged", F.size("least").alias("kept"), "sketch")
    posted = (
        shared.withColumn("longs", longs).join(sketches, "id").join(labels, "id", "left")
        .select(F.inline(lists), "id", "n", "k", "sketch", F.coalesce("comp", "id").alias("comp"))
    )
    # a row of a list of several blocks goes to the cells of its own block with each block
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.xxhash64("token", F.least(x, F.col("own")), F.greatest(x, F.col("own"))).alias("token"), F.when(x == F.col("own"), -1).otherwise(F.col("own")).alias("block")))
    one = F.array(F.struct(F.col("token"), F.lit(-1).alias("block")))
    dealt = posted.withColumn("own", own).select(F.inline(F.when(F.col("blocks") > 1, cells).otherwise(one)).alias("token", "block"), "id", "n", "k", "sketch", "comp")

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in _whole_runs(batches):
            for i, j in meeting(run, percent):
                yield pd.DataFrame({"a": run.of["id"][i], "b": run.of["id"][j], "k": np.minimum(run.of["k"][i], run.of["k"][j])})

    found = dealt.repartition("token").sortWithinPartitions("token").mapInPandas(released(met), f"a {kind}, b {kind}, k int")
    found = found.where("a <> b").select(*_ordered(), "k").groupBy("a", "b").agg(F.count("*").alias("c"), F.min("k").alias("k")).where("c >= k")
    return staged(found.select("a", "b"), "met")


def components(documents: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) a row of ``documents``."""
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = docs.where("id IS NOT NULL")
    members, reps, same = _features(docs, n, percent)
    near = _near(reps, percent)
    sure = verified(near, known, n, percent)
    edges = staged(sure.union(same), "edges")
    labels = connected(edges)
    met = _search(reps, labels, percent)
    rest = verified(met, known, n, percent)
    whole = staged(edges.union(rest), "edges")
    labels = connected(whole)
    discard(near, sure, edges, met, rest, whole)
    labels = labels.select(F.col("id").alias("rep"), "comp")
    out = members.join(labels, "rep", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("comp", "rep", "id")).alias("component_id"))


def links(documents: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links: membership (doc_id, rep), and pairs (a, b) of representatives of different sets that link.

    Copies are not expanded. Work and result are in proportion to the links, of which
    a group of N near copies has up to N * N / 2; where only the groups are asked
    for, ``components`` does with N. Rows that share an id need ``components``, too.
    """
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    members, reps, _ = _features(docs, n, percent)
    alone = reps.select("id", F.col("id").alias("comp"))
    return members.select(F.col("id").alias(id_col), "rep"), verified(_search(reps, alone, percent), docs.where("id IS NOT NULL"), n, percent)


def keep(documents: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the least id; rows without words, and rows without id, all stay."""
    gone = staged(components(documents, n, percent, id_col, text_col).where(F.col("component_id") != F.col(id_col)).select(id_col).distinct(), "copies")
    gone = F.broadcast(gone) if gone.count() <= ID_BOUND else gone
    return documents.join(gone, id_col, "left_anti")

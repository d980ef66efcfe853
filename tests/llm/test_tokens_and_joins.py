import random

import numpy as np
import pytest

from statwright.llm import decontamination, ngram_join, sentencepiece, token_counts, vocabulary
from statwright.llm.vocabulary import UNIGRAM, Vocabulary, _varint

TEXTS = ["", " ", "  a   b  ", "a\n\n b\n", "\n", "Hello world, hello", "日本語 テキスト 🙂x", "\t\x00z", "def f(x):\n    return  x\n", "é́ ﬁ x　y", "a" * 200, "x\u2581y", " lead", "trail ", "a \nb"]


@pytest.fixture(scope="module")
def data():
    with open(token_counts.MODEL, "rb") as f:
        return f.read()


def more(n=400):
    rng = random.Random(1)
    return TEXTS + ["".join(rng.choice("abcdehit  \n.,é🙂") for _ in range(rng.randrange(50))) for _ in range(n)]


def test_bpe_ids_are_the_library_s(data):
    import sentencepiece as lib

    own, reference = sentencepiece.Encoder(data), lib.SentencePieceProcessor(model_file=token_counts.MODEL)
    texts = more()
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        ids = np.frombuffer(ids, "<i4").tolist()
        assert ids == reference.encode(text)
        assert own.v.decoded(ids) == reference.decode(ids)
        assert "\u2581" in text or own.v.decoded(ids) == text


def test_allowed_pairs_are_those_that_merging_leaves_alone(data):
    v, rng = Vocabulary(data), random.Random(4)
    pieces = list(v.ids)
    pairs = [(rng.choice(pieces), rng.choice(pieces)) for _ in range(5000)] + [(p[:k], p[k:]) for p in rng.sample(pieces, 3000) for k in range(1, len(p))]
    for left, right in pairs:
        if {left, right} <= v.ids.keys():
            assert v.unpaired(left, right) == (v.merged(left + right) == [left, right]), (left, right)


@pytest.mark.parametrize("kind", [None, UNIGRAM])
def test_forgotten_moves_change_nothing(data, kind, monkeypatch):
    texts = more(100)
    want = sentencepiece.Encoder(data, kind).encode_all(texts)
    monkeypatch.setattr(vocabulary, "MOVES", 7)
    assert sentencepiece.Encoder(data, kind).encode_all(texts) == want


def test_a_long_unit_takes_linear_time(data):
    import time

    own, unit = sentencepiece.Encoder(data), "".join(random.Random(3).choice("abcdehit9é🙂") for _ in range(400_000))
    began = time.process_time()
    ids = np.frombuffer(own.encode_all([unit])[0], "<i4").tolist()
    assert time.process_time() - began < 20 and own.v.decoded(ids) == unit


def brute_unigram(v: Vocabulary, unit: str) -> set[int]:
    """Numbers of pieces of all best segmentations, by trying every one."""
    best, counts = None, set()

    def walk(at, score, n):
        nonlocal best, counts
        if at == len(unit):
            if best is None or score > best:
                best, counts = score, {n}
            elif score == best:
                counts.add(n)
            return
        for end in range(at + 1, len(unit) + 1):
            if unit[at:end] in v.ids:
                walk(end, score + v.scores[v.ids[unit[at:end]]], n + 1)
        if unit[at] not in v.ids:
            walk(at + 1, score + v.unknown_score, n + len(unit[at].encode()))

    walk(0, 0.0, 0)
    return counts


def test_unigram_counts_are_best(data):
    v, counter = Vocabulary(data, UNIGRAM), token_counts.Counter(data)
    rng = random.Random(2)
    for _ in range(300):
        unit = "\u2581" + "".join(rng.choice("aehinrstéß🙂") for _ in range(rng.randrange(1, 9)))
        assert counter.of(unit) % token_counts.HIGH in brute_unigram(v, unit)


def test_counts_agree_with_ids(data):
    own, counter = sentencepiece.Encoder(data), token_counts.Counter(data)
    one = sentencepiece.Encoder(data, UNIGRAM)
    texts = more()
    for text, ids, uni in zip(texts, own.encode_all(texts), one.encode_all(texts), strict=True):
        assert counter.count(text) == (len(ids) // 4, len(uni) // 4)


def test_token_operators_on_tables(table):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (3, None), (3, "again")]
    df = table(rows)
    assert token_counts.token_counts(df).count() == len(rows)
    trips = sentencepiece.round_trip(df).collect()
    assert len(trips) == len(rows) and all(r["exact"] for r in trips if r["doc_id"] != TEXTS.index("x\u2581y"))
    back = sentencepiece.decode(sentencepiece.encode(df)).collect()
    assert sorted(r["text"] for r in back) == sorted((t or "").replace("\u2581", " ") for _, t in rows)
    assert sentencepiece.encode(df.where("false")).count() == 0


def test_varint():
    assert _varint(bytes([0xAC, 2]), 0) == (300, 2)


# --- joins -----------------------------------------------------------------------------------------

VOCABULARY = [f"w{i}" for i in range(60)]


def changed(rng, ws, k):
    ws = list(ws)
    for _ in range(k):
        p, r = rng.randrange(len(ws)), rng.random()
        if r < 0.5:
            ws[p] = rng.choice(VOCABULARY)
        elif r < 0.8:
            ws.insert(p, rng.choice(VOCABULARY))
        elif len(ws) > 1:
            del ws[p]
    return ws


def families(seed=3):
    rng, docs = random.Random(seed), []
    for _ in range(14):
        base = [rng.choice(VOCABULARY) for _ in range(rng.choice([3, 8, 20, 60, 200]))]
        for _ in range(rng.randrange(1, 9)):
            docs.append((len(docs), " ".join(changed(rng, base, rng.choice([0, 0, 1, 2, 4])))))
    n = len(docs)
    return docs + [(n, None), (n + 1, ""), (n + 2, "a"), (n + 3, "A"), (n + 4, "a b"), (5, "a b c d"), (5, docs[30][1]), (None, "a b"), (n + 5, docs[3][1].upper()), (n + 6, docs[3][1])]


def brute_components(docs, n, percent):
    sets = []
    for _, t in docs:
        ws = (t or "").encode().lower().split()
        sets.append({tuple(ws[k : k + n]) for k in range(max(1, len(ws) - n + 1))} if ws else set())
    least = {d: d for d, _ in docs if d is not None}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if None not in (docs[a][0], docs[b][0]) and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(docs[a][0]), root(docs[b][0])))
                least[y] = x
    return sorted((d if d is not None else -1, len(s), root(d) if d is not None else -1) for (d, _), s in zip(docs, sets, strict=True))


@pytest.mark.parametrize(("n", "percent", "block", "long"), [(3, 90, 1024, 64), (5, 80, 2, 2)])  # the second forces long lists, blocks and label rounds
def test_components(table, monkeypatch, n, percent, block, long):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "LONG", long)
    monkeypatch.setattr(ngram_join, "EDGE_BOUND", 0 if long < 64 else 1000)
    if long < 64:
        monkeypatch.setattr(ngram_join, "REACH", 1)  # leaves most to the search
        monkeypatch.setattr(ngram_join, "BOUND", -1)
    docs = families()
    got = ngram_join.components(table(docs).repartition(3), n, percent).collect()
    minus = lambda x: -1 if x is None else x
    assert sorted((minus(r["doc_id"]), r["n_shingles"], minus(r["component_id"])) for r in got) == brute_components(docs, n, percent)


@pytest.mark.parametrize("block", [1024, 3])
def test_links_are_complete(table, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(6)
    base = [[rng.choice(VOCABULARY) for _ in range(n)] for n in (30, 80, 150)]
    docs = [(k, " ".join(changed(rng, rng.choice(base), rng.choice([0, 1, 1, 2, 3])))) for k in range(90)] + [(200, None), (201, "a")]
    members, pairs = ngram_join.links(table(docs).repartition(4), 3, 90)
    rep = {r["doc_id"]: r["rep"] for r in members.collect()}
    got = sorted((r["a"], r["b"]) for r in pairs.collect())
    sets = {d: {tuple(ws[k : k + 3]) for k in range(len(ws) - 2)} for d, t in docs[:90] for ws in [t.split()]}
    firsts = {frozenset(s): d for d, s in sorted(sets.items(), reverse=True)}
    assert all(rep[d] == firsts[frozenset(s)] for d, s in sets.items()) and rep[200] is None and rep[201] == 201
    ids = sorted(firsts.values())
    assert got == [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])] and len(got) > 50


def test_components_of_nothing(table):
    assert ngram_join.components(table([], "doc_id bigint, text string")).count() == 0


def test_keep_leaves_one_of_each_component(table):
    docs = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "A B C D E F G H"), (4, "x"), (5, None), (None, "a b c d e f g h")]
    kept = ngram_join.keep(table(docs))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "5", "None"] and "ids" in kept.columns


def test_least_overlaps_bound_every_link():
    """T-occurrence never loses a pair: exhaustive over sizes and overlaps that link."""
    for percent in (80, 90):
        for a in range(1, 120):
            for b in range(-(-percent * a // 100), a + 1):
                need = -(-percent * (a + b) // (100 + percent))
                (ka, ma, oa), (kb, mb, ob) = ngram_join.sizes(a, percent), ngram_join.sizes(b, percent)
                share = need - (a - ka) - (b - kb)  # of kept ones at the very least, by counting
                t = min(ngram_join.threshold(a, percent), ngram_join.threshold(b, percent))
                assert ka >= a - need + t and kb >= b - need + t
                assert ma >= ka - t + min(oa, ob) and mb >= kb - t + min(oa, ob)
                assert share <= min(ka, kb)


def test_sketch_never_overstates():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
        b = np.unique(np.r_[a[: rng.integers(0, 200)], rng.integers(0, 2**63, 40).astype(np.uint64)])
        d = int(ngram_join._differ(ngram_join.sketch(a).view(np.uint64), ngram_join.sketch(b).view(np.uint64)))
        assert d <= len(np.setxor1d(a, b))


def test_long_texts_hash_piecewise(monkeypatch):
    text = " ".join(random.Random(1).choice(VOCABULARY) for _ in range(5000))
    whole = ngram_join.shingles(text, 3)
    monkeypatch.setattr(ngram_join, "SEGMENT", 1000)
    assert (ngram_join.shingles(text, 3) == whole).all()


def test_decontamination(table, spark):
    rng = random.Random(9)
    items = [(k, " ".join(rng.choice(VOCABULARY) + str(rng.randrange(9)) for _ in range(n))) for k, n in enumerate((6, 7, 14, 30, 59))] + [(10, None), (11, "too short"), (None, "a b c d e f g h")]
    noise = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    docs, want = [(0, None), (1, ""), (2, noise(3000)), (None, items[3][1])], set()
    for k, text in items[:5]:
        for subs in (0, 1) if k < 3 else (0, 2, 4):
            ws = text.split()
            for p in rng.sample(range(1, len(ws) - 1), subs if k > 1 else 0):
                ws[p] = "other"
            i = len(docs)
            docs.append((i, noise(30) + " " + " ".join(ws).upper() + ". " + noise(20)))
            want.add((i, k))
    docs.append((2, "same id again"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.overlaps(table(docs), bench).collect()}
    assert got == want
    kept = decontamination.keep(table(docs), bench)
    assert {r["doc_id"] for r in kept.collect()} == {0, 1, 2, None}
    assert decontamination.overlaps(table(docs), bench.where("false")).count() == 0
    assert decontamination.overlaps(table(docs).where("false"), bench).count() == 0


def brute_overlaps(docs, items):
    """{(doc, item): (item words, matched, best window, best run)} of all leaks, by comparing every diagonal that a mask hits."""
    import re

    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    best: dict = {}
    for d, text in docs:
        own = words(text)
        for i, item in items:
            ws = words(item)
            for diagonal in range(-len(ws), len(own)) if d is not None and i is not None else ():
                hit = [int(0 <= diagonal + j < len(own) and own[diagonal + j] == w) for j, w in enumerate(ws)]
                seeds = any(all(hit[j + k] for k, c in enumerate(mask) if c == "1") for mask in decontamination.MASKS for j in range(len(ws) - len(mask) + 1) if diagonal + j >= 0)
                window = max(sum(hit[k : k + 20]) for k in range(max(1, len(ws) - 19)))
                run = max(map(len, "".join(map(str, hit)).split("0")))
                if seeds and (sum(hit) >= 0.6 * len(ws) or window >= 16 or run >= 13):
                    best[d, i] = tuple(map(max, best.get((d, i), (0, 0, 0, 0)), (len(ws), sum(hit), window, run)))
    return best


@pytest.mark.parametrize("bound", [32 << 20, -1])
def test_overlaps_equal_brute_force(table, spark, monkeypatch, bound):
    monkeypatch.setattr(decontamination, "BOUND", bound)
    rng = random.Random(12)
    say = lambda n: [rng.choice(VOCABULARY[:30]) for _ in range(n)]
    items = [(k, say(n)) for k, n in enumerate((5, 6, 7, 9, 20, 31, 40, 40))] + [(20, []), (None, say(9))]
    docs = [(0, None), (1, ""), (None, " ".join(items[4][1])), (2, " ".join(say(2500)))]
    for k in range(40):
        ws = list(rng.choice(items)[1])
        for _ in range(rng.randrange(6)):
            if ws:
                p = rng.randrange(len(ws))
                ws[p : p + rng.choice([1, 1, 1, 0, 2])] = [rng.choice(VOCABULARY)]
        cut = rng.randrange(len(ws) + 1)
        docs.append((3 + k // 2, " ".join(say(rng.randrange(9)) + ws[cut * (k % 3 == 0) :] + say(5)).title()))  # two rows an id
    items = [(i, " ".join(ws)) for i, ws in items]
    items.append((21, items[5][1]))
    df, bench = table(docs).withColumnsRenamed({"ids": "diagonal", "score": "own"}), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): (r["item_words"], r["matched"], r["best_window"], r["best_run"]) for r in decontamination.overlaps(df, bench).collect()}
    want = brute_overlaps(docs, items)
    assert got == want and len(want) > 15
    leaky = {d for d, _ in want}
    assert sorted(str(r["doc_id"]) for r in decontamination.keep(df, bench).collect()) == sorted(str(d) for d, _ in docs if d not in leaky)


def test_seeds_are_joined_alike_without_broadcast(table, spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BOUND", -1)
    bench = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id bigint, text string")
    df = table([(1, "so one two three four nine six seven eight so"), (2, "nothing of it")])
    assert [r["doc_id"] for r in decontamination.overlaps(df, bench).collect()] == [1]
    assert [r["doc_id"] for r in decontamination.keep(df, bench).collect()] == [2]

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from statwright.llm import chat_format, license_scan, quality_classifier, quality_rules, toxicity, trees, url_filter

WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "s", "nt", "")]
EDGES = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "one"), (None, "two words"), (9004, "one"), (9005, "a b c a b c a b c\n\na b c")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        text = " ".join([rng.choice(WORDS[:3]) + "###"] * 80) if bad else prose(rng, 120)
        if toxic:
            text += ". you zorgon" + rng.choice(["ish", "ed", "al"]) + " " + prose(rng, 5)
        docs.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def test_quality_classifier(spark, table):
    docs, labels = corpus()
    long = prose(random.Random(2), 30_000)
    df, lb = table(docs + EDGES + [(9010, long)]), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = quality_classifier.fit(df, lb)
    assert model.rules and model.described()
    got = quality_classifier.score(df, model).collect()
    assert len(got) == len(docs) + len(EDGES) + 1 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    truth = {i: y for i, y, _ in labels}
    held = [r for r in got if r["doc_id"] in truth and __import__("zlib").crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 50 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.98
    kept = quality_classifier.keep(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] for r in got)
    empty = df.where("false")
    assert quality_classifier.score(empty, quality_classifier.fit(empty, lb)).count() == 0
    assert quality_classifier.score(df, quality_classifier.fit(df, lb.where("false"))).first()["score"] == 0.5


def test_lasso_is_sparse_and_trees_split():
    rng = np.random.default_rng(0)
    x = rng.random((400, 5))
    y = (x[:, 2] > 0.6).astype(float)
    prior, grown = trees.fit_boosted(x, y, 8, 2)
    z = prior + sum(trees.apply_tree(t, x) for t in grown)
    assert ((z > 0) == (y > 0)).mean() > 0.99
    rules = trees.rules_of(grown)
    b, w = trees.fit_lasso(trees.rule_matrix(rules, x), y, 5e-3)
    assert 0 < (w != 0).sum() < len(rules)


def brute_measures(text):
    import re

    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, table):
    rng = random.Random(5)
    docs = EDGES + [(i, "".join(rng.choice(["a ", "b ", "c\n", "d# ", "é\t", "a b c "]) for _ in range(rng.randrange(40)))) for i in range(120)] + [(500, "x " * 5), (501, "x x x x"), (502, "a b a b a b")]
    book = quality_rules.ledger(table(docs))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in book.collect())
    assert got == sorted((d if d is not None else -1, *brute_measures(t)) for d, t in docs)
    both = quality_rules.apply_policy(book)
    assert both.where("base_failed AND kept").count() == 0
    parts = {r["rule"]: (r["failed"], r["only"]) for r in quality_rules.ablations(book).collect()}
    assert parts["too_few_words"][0] == book.where("n_words < 50").count()
    assert parts["too_few_words"][1] == book.where(f"(fail_bits & {quality_rules.POLICIES['v2']}) = 1").count()
    clash = table(docs).withColumn("measured_text", F.lit(1))
    assert quality_rules.keep(clash).columns == clash.columns
    assert quality_rules.keep(clash).count() == both.where("kept").count()
    assert {r["failed"] for r in quality_rules.ablations(book.where("false")).collect()} == {0}


def test_grammar():
    m = toxicity.Matcher({"zorgon": 4.0})
    plain, aimed = m.clause("a zorgonish thing"), m.clause("you are a zorgonish thing")
    assert aimed == 1.5 * plain and m.clause("not zorgonish") == 0.3 * plain and m.clause("they said a zorgonish thing") < aimed
    assert m.clause("kill the process") == 0 and m.clause("i kill you") == 0 and m.clause("you i kill") > 0
    assert m.features("clean. Words\nonly") == (0.0, 0.0, 0.0) == m.features(None)
    text = "fine words. You zorgoned! prezorgon? zorgonal zorgonal\nrest"
    total = sum(m.clause(c) for c in ("you zorgoned", "zorgonal zorgonal"))
    assert abs(m.features(text)[0] - np.log1p(total)) < 1e-12


def test_threats_before_their_target():
    m = toxicity.Matcher({"zorgon": 4.0})
    for text in ("I will burn them", "kill you", "shoot them!", "i kill you"):
        assert m.features(text)[1] == m.THREAT_WEIGHT, text
    assert m.features("i will not kill you")[1] == 0.3 * m.THREAT_WEIGHT and m.features("they said. we kill you")[1] == m.THREAT_WEIGHT
    assert m.features("one said we kill you")[1] == 0.5 * m.THREAT_WEIGHT and m.features("we beat and burn them")[1] == 2 * m.THREAT_WEIGHT
    assert m.features("you i kill them")[1] == m.THREAT_WEIGHT  # once, though targets stand on both sides
    for text in ("kill the process", "kill the process. you", "burn the wood that was left for them"):
        assert m.features(text) == (0.0, 0.0, 0.0), text


def test_threats_are_inflected():
    m = toxicity.Matcher({"zorgon": 4.0})
    for text in ("they were killing you", "you will be beaten", "sie haben dich getötet"):
        assert m.features(text)[1] > 0, text


def test_toxicity(spark, table):
    docs, labels = corpus(3, 400)
    df, lb = table(docs + EDGES), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(df, lb)
    assert "zorg" in model.stems
    got = toxicity.score(df, model).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r["doc_id"] in truth and __import__("zlib").crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 40 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert len(got) == len(docs) + len(EDGES)
    assert toxicity.score(df.where("false"), model).count() == 0
    assert toxicity.fit(df, lb.where("false")).stems == {}


def test_license_scan(table):
    model = license_scan.fit()
    docs = [(1, "x y\nLicensed under the Apache License, Version 2.0.\nz"), (2, "Released under the MIT License.\nReleased under the MIT License."), (3, "the license of the driver was in the library"), (4, "This work is licensed under the GNU General Public License, version 3."), (5, "Licensed under CC BY-NC 4.0."), *EDGES]
    got = sorted((r["doc_id"], r["line"], r["family"]) for r in license_scan.scan(table(docs), model).collect())
    assert got == [(1, 1, "Apache-2.0"), (2, 0, "MIT"), (2, 1, "MIT"), (4, 0, "GPL"), (5, 0, "CC-BY-NC")]
    assert license_scan.scan(table(docs).where("false"), model).count() == 0


#: Notices as files have them; none is a template or a row of the training.
NOTICES = {
"MIT":'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:',
"BSD":'Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n1. Redistributions of source code must retain the above copyright\n   notice, this list of conditions and the following disclaimer.',
"ISC":'Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.',
"GPL":'This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License\nas published by the Free Software Foundation; either version 2\nof the License, or (at your option) any later version.',
"LGPL":'You should know this library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.',
"Apache-2.0":' * Licensed under the Apache License, Version 2.0 (the "License");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0',
"MPL-2.0":'This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.',
"AGPL":'modify it under the terms of the GNU Affero General Public License as\npublished by the Free Software Foundation, either version 3 of the License',
 "spdx":'// SPDX-License-Identifier: MIT\n\n# SPDX-License-Identifier: BSD-3-Clause\n\n/* SPDX-License-Identifier: GPL-2.0-or-later */',
 "none":"The general public was invited. You need a license to drive, version 2.0 of the rules is free software talk.\nDer Mann mit dem Hund kam mit."}


def test_license_families_are_told_on_held_out_texts():
    import re

    model = license_scan.fit()
    assert len(set(model.threshold)) > 6
    families, seen = list(license_scan.TEMPLATES), {t for t, _ in license_scan._made(license_scan.MADE)}
    held = [(t, families[f] if f >= 0 else "unknown") for t, f in license_scan._made(2000, seed=99) if t not in seen]

    def named(text):
        family, _ = model.predict(text)
        return family if family != "unknown" and license_scan.confirmed(text, family)[0] >= license_scan.CONFIRM else "unknown"

    told = [(named(t), f) for t, f in held]
    assert np.mean([a == b for a, b in told]) > 0.97
    for f in families:
        assert sum(a == b == f for a, b in told) / sum(b == f for _, b in told) > 0.85, f
        assert sum(a == b == f for a, b in told) / sum(a == f for a, _ in told) > 0.95, f
    anchored = re.compile(r"(?i)(?<![^\W_])(?:" + "|".join(re.escape(a) for a in model.anchors()) + r")(?![^\W_])")
    for family, text in NOTICES.items():
        found = {f for _, f, *_ in license_scan.text_rows(text, model, anchored) if f != "unknown"}
        assert found == ({"MIT", "BSD", "GPL"} if family == "spdx" else set() if family == "none" else {family}), family
    long = "plain words of the river\n" * 100_000 + NOTICES["MIT"] + "\nmore words" * 50_000
    assert [(k, f) for k, f, *_ in license_scan.text_rows(long, model, anchored)] == [(100_000, "MIT")]


def test_license_statements_over_lines(table):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or"
    docs = [(1, "a title\n\n" + mit), (2, gpl), (3, "Licensed under the MIT License or the Apache License, Version 2.0."), (4, "x\nThis library is licensed under the GNU Lesser\nGeneral Public License, version 2.1."), (5, "Released under the MIT License.\n\nplain words")]
    got = sorted((r["doc_id"], r["line"], r["family"]) for r in license_scan.scan(table(docs), license_scan.fit()).collect())
    assert got == [(1, 2, "MIT"), (2, 0, "GPL"), (3, 0, "Apache-2.0"), (3, 0, "MIT"), (4, 1, "LGPL"), (5, 0, "MIT")]


URLS = [
    "https://A.Example.NET/en/1?x=1", "http://x.net/en/", "https://example.com/de/1", "https://sub.example.com/de", "https://x.org/fr/2", "https://x.org/en", "ftp://h?p://x", "no scheme", "", None, "http://x.net",
    "https://library.org/", "https://cheap-pills.com/", "https://m.casino-win.com/en/1299/", "https://casino.com/", "https://xxx.com/", "https://bad-adult-site.com/", "https://my-city-library.org/",
    "https://free-software-foundation.org/about", "https://en.wikipedia.org/wiki/Url", "a\nb://C.net/\n/x?#", "https://" + "a1-" * 60_000 + ".org/fr/" + "x/" * 40_000, "x" * 300_000, "https://x.org/fr/2", "://", "https://x.org?a&b&&c=1#?d&e",
]


def brute_url(url, model, rules):
    """(host, path, rule, verdict) of a url in plain Python."""
    import math
    import re

    u = url or ""
    rest = u.split("://", 1)[1] if "://" in u else ""
    host = re.match(r"[^/?#]*", rest)[0].translate({k: k + 32 for k in range(65, 91)})
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(len(h + p), -k, h + p, v) for k, (v, h, p) in enumerate(rules) if ("." + host).endswith("." + h) and path.startswith(p)]
    if fits:
        return host, path, *max(fits)[2:]
    labels = [x for x in host.split(".") if x]
    name = host.rsplit(".", 1)[0] if "." in host else ""
    gs = {name[k : k + 4] for k in range(len(name) - 3) if re.fullmatch("[a-z]{4}", name[k : k + 4])}
    ws = [model.gram_odds.get(g, 0.0) for g in sorted(gs)]
    query = re.search(r"\?([^#]*)", u)
    x = {
        "url_chars": len(u), "host_chars": len(host), "depth": sum(p != "" for p in path.split("/")), "digit_ratio": len(re.findall("[0-9]", u)) / max(1, len(u)),
        "entropy": -sum((n := host.count(c) / len(host)) * math.log2(n) for c in set(host)), "n_params": sum(p != "" for p in query[1].split("&")) if query else 0,
        "host_labels": len(labels), "hyphens": host.count("-"), "host_digits": len(re.findall("[0-9]", host)), "longest_label": max(map(len, labels), default=0),
        "suffix_chars": len(host.split(".")[-1]), "suffix_block_rate": model.suffix_rate.get(host.split(".")[-1], 0.5), "gram_odds": sum(ws), "gram_most": max(ws, default=0.0),
    }
    row = np.array([[x[f] for f in url_filter.FEATURES]])
    z = model.prior + sum(trees.apply_tree(t, row)[0] for t in model.trees)
    return host, path, None, "block" if z >= 0 else "allow"


def test_url_filter_equals_brute_force(spark):
    labelled = url_filter.labelled_urls(spark).cache()
    train, held = url_filter.parted(labelled)
    model = url_filter.fit(train)
    errors = url_filter.held_out_errors(held, model)
    assert errors["rows"] > 1000 and errors["errors"] < 0.06 and errors["errors"] < 0.6 * errors["best_single_feature"]
    assert len({f for t in model.trees for n in t if len(n) > 1 for f in [n[0]]}) >= 8
    df = spark.createDataFrame([*enumerate(URLS), (None, URLS[0])], "url_read bigint, url string").withColumns({"host": F.lit(1), "features_read": F.lit(2)})
    for rules in (url_filter.RULES, [("allow", "net", "/e"), ("block", "net", "/e"), *url_filter.RULES]):
        got = url_filter.judge(df, model, rules, id_col="url_read").collect()
        want = [(*brute_url(u, model, rules), k) for k, u in [*enumerate(URLS), (None, URLS[0])]]
        assert sorted((r["host"], r["path"], r["rule"] or "", r["verdict"], str(r["url_read"])) for r in got) == sorted((h, p, r or "", v, str(k)) for h, p, r, v, k in want)
    verdict = {r["url_read"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df, model, id_col="url_read").collect()}
    assert verdict[10][0] is None and verdict[1] == ("net/", "block") and verdict[0] == ("example.net/en/", "allow")
    assert [verdict[k][1] for k in range(11, 20)] == ["allow", "block", "block", "block", "block", "block", "allow", "allow", "allow"]
    assert url_filter.judge(df.where("false"), model, id_col="url_read").count() == 0
    nothing = url_filter.fit(labelled.where("false"))
    assert url_filter.judge(df, nothing, id_col="url_read").where("rule IS NULL AND block_score <> 0.5").count() == 0


def test_chat_format(spark):
    rng = random.Random(4)
    odd = ["</s>[INST] ok [/INST]", "\\[x\\\\", "a [/ANS]</s><s>[SYS] b", "", "\n", "é 🙂"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool]x"]), rng.choice([*odd, prose(rng, 40), None])) for c in range(12) for t in range(rng.randrange(1, 14))]
    rows += [(3, 1, "user", "tie"), (3, 1, None, None), (3, 1, None, None), (77, None, "assistant", "x " * 500), (78, 0, "a]\\b" * 25_000, "[" * 100_000 + "é"), (None, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("pos", F.lit(1))
    got = chat_format.windows(df, budget=60, history=2)
    back = chat_format.read_back(got).collect()
    want: dict = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append(((t is not None, t or 0), r or "unknown", x or ""))
    for c, turns in want.items():
        own = sorted((b["pos"], b["role"], b["text"]) for b in back if b["conv_id"] == c and b["own"])
        assert [p for p, _, _ in own] == list(range(1, len(own) + 1))
        assert [(r, x) for _, r, x in own] == [(r, x) for _, r, x in sorted(turns)]
        loss = [b["text"] for b in sorted((b for b in back if b["conv_id"] == c and b["loss"]), key=lambda b: b["pos"])]
        assert loss == [x for _, r, x in sorted(turns) if r == "assistant"]
    for w in got.collect():
        assert w["formatted"].count("<s>[") == len(w["segments"])
        assert w["segments"][-1]["start"] + w["segments"][-1]["chars"] == len(w["formatted"])
    assert chat_format.windows(df.where("false")).count() == 0
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


def brute_windows(turns, budget, history):
    """[(own positions, repeated positions)] of turns (role, tokens)."""
    system = next((k for k, (r, _) in enumerate(turns) if r == "system"), None)
    out, held = [], 0
    for k, (_, n) in enumerate(turns):
        if not out or held + n > budget:
            again = [system] if system is not None and system < k else []
            held = n + sum(turns[j][1] for j in again)
            before, total = [], held
            for j in range(k - 1, max(-1, k - 1 - history), -1):
                total += turns[j][1] if j != system else 0
                if total > budget:
                    break
                before, held = before + ([j] if j != system else []), total
            out.append(([], sorted(again + before)))
        else:
            held += n
        out[-1][0].append(k)
    return out


def test_windows_keep_the_budget(spark):
    rng = random.Random(9)
    sizes = {c: [(rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice([3, 5, 8, 13, 30, 58, 61, 90])) for _ in range(rng.randrange(1, 25))] for c in [*range(25), None]}
    rows = [(c, t, r, "x " * (n - 3) + "x") for c, turns in sizes.items() for t, (r, n) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got: dict = {}
    for w in chat_format.windows(df, budget=60, history=2).collect():
        own, again = [s["pos"] - 1 for s in w["segments"] if s["own"]], [s["pos"] - 1 for s in w["segments"] if not s["own"]]
        got.setdefault(w["conv_id"], []).append((w["window"], own, again))
        turns = sizes[w["conv_id"]]
        over = sum(turns[k][1] for k in own + again) > 60
        assert not over or (len(own) == 1 and all(turns[k][0] == "system" for k in again))
    for c, turns in sizes.items():
        assert [x[1:] for x in sorted(got[c])] == brute_windows(turns, 60, 2), c
        assert [x[0] for x in sorted(got[c])] == list(range(len(got[c])))

"""License scans: a trained classifier of paragraphs, confirmed against templates.

Lines are looked at one by one, and then paragraphs, runs of lines that are not
blank, for statements that go over several lines or share a line. A sparse logistic regression on word 1- to 3-grams, one
against all for each licence family, is trained on paragraphs that are made by
rule from the templates below and from ordinary prose. A family's weights are
kept for n-grams that speak for it; a paragraph without any has just the bias.
The threshold of each family is calibrated on held-out made paragraphs of all
families and none, between what nearly all others and nearly none of its own
stay below, so that what stays below all is ``unknown``. A prediction counts if the paragraph shares
enough word bigrams with a template of the family. In a paragraph these must stand
within a window of words, whose text is predicted; each family over its threshold
counts, unless another's matches hold all of its own. A statement is reported at
the line in which it begins.

Every line of a whole text is looked at: a regular expression of the words that
all kept n-grams need finds lines that could have a prediction at all; others
are unknown by construction. A null or empty text has no lines, a long text is
looked at whole, a repeated line is reported at each place and so is a repeated
row; documents without licence lines give no row, and an empty table none at all.
Of families with equal excess the first one counts. A null id keeps its rows.
Extra columns are not read, whatever their names; the id column must not be named
like a column of the result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statwright.llm.common import fresh
from statwright.llm.trees import sigmoid

#: Statements of licence families, a paragraph each: what notices in documents and heads of files say, with usual variants.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is distributed under the terms of the Apache License 2.0.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "MIT": [
        "Released under the MIT License.", "This software is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "Released under the GNU GPL, version 2 or later.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.", "Distributed under the terms of the GNU LGPL, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.", "Released under the GNU AGPL, version 3.",
    ],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Released under CC BY-NC-SA 4.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Text is available under CC BY-SA 3.0."],
    "CC0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD 3-Clause License.", "Licensed under the BSD License.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Proprietary": ["All rights reserved.", "All rights reserved. No part of this publication may be reproduced without prior written permission.", "Copyright by the author. All rights reserved."],
}
#: SPDX names of the families.
SPDX = {
    "Apache-2.0": ["Apache-2.0"], "MIT": ["MIT"], "ISC": ["ISC"], "GPL": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"], "LGPL": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "AGPL": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "CC-BY-NC": ["CC-BY-NC-4.0", "CC-BY-NC-SA-4.0"], "CC-BY": ["CC-BY-4.0", "CC-BY-SA-4.0"], "CC0": ["CC0-1.0"], "BSD": ["BSD-2-Clause", "BSD-3-Clause"], "MPL-2.0": ["MPL-2.0"],
}
for _family, _names in SPDX.items():
    TEMPLATES[_family] += [f"SPDX-License-Identifier: {n}" for n in _names]
#: Sentences that talk of the same words without granting anything, for the unknown class.
ORDINARY = ["The driver showed her license to the officer at the gate.", "You need a fishing license in this state.", "The software is free of charge for students this week.", "Please read the terms and conditions of sale before you order.", "The general public was invited to the open day.", "This version of the story was published in 2004.", "He was permitted to use the file in the library.", "The commons lies north of the village.", "They released the second version of the record in spring.", "The apache helicopter landed near the river.", "A public foundation paid for the work on the bridge.", "The source of the river is subject to flooding."]
FILLER = "the of a in and to was that it as on with his for at by which from had not but were all their one out so up her more when about what into them".split()
#: Words that are common in any text: an n-gram of these alone is no feature, and none of them anchors one.
COMMON = set(FILLER) | set("is are be been may can any no or if this that you your these those such use part work works text order state near met later prior before following under without person persons deal free public source general file files form forms version author authors".split())
WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")
#: Least share of the bigrams of the nearest template that a paragraph must have.
CONFIRM = 0.5
#: Made paragraphs that a training has, and their longest number of words.
MADE = 6000
#: Shares of held-out paragraphs that a threshold lets pass: of others at most, of its own at least.
OTHERS, OWN_KEPT = 0.002, 0.98


def grams(text: str) -> list[str]:
    ws = WORD.findall(text.lower())
    return [" ".join(ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1)]


OWN = {w for ts in TEMPLATES.values() for t in ts for w in WORD.findall(t.lower()) if len(w) > 1 and any(map(str.isalpha, w))} - COMMON - {w for t in ORDINARY for w in WORD.findall(t.lower()) if w not in ("license", "apache")}


def tells(word: str) -> bool:
    """Whether a word is a template's own: not common, and not among the ordinary sentences."""
    return word in OWN


@dataclass
class LicenseModel:
    families: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    threshold: list[float]

    def anchors(self) -> list[str]:
        """Words such that each kept n-gram has one of them, the most telling first."""
        need = [{w for w in g.split() if tells(w)} for g in self.weights]
        tally = Counter(w for ws in need for w in ws)
        out: list[str] = []
        for ws in sorted(need, key=lambda x: (len(x), sorted(x))):
            if not ws & set(out):
                out.append(min(ws, key=lambda w: (-tally[w], w)))
        return sorted(out)

    def predict(self, text: str) -> tuple[str, float]:
        """The family with the largest excess over its threshold and its probability; unknown if none is over."""
        z = np.array(self.bias)
        for g in set(grams(text)):
            if g in self.weights:
                z = z + self.weights[g]
        p = sigmoid(z)
        k = int(np.argmax(p - np.array(self.threshold)))
        return (self.families[k], float(p[k])) if p[k] >= self.threshold[k] else ("unknown", float(p[k]))

    def over(self, text: str) -> dict[str, float]:
        """All families over their thresholds, with their probabilities."""
        z = np.array(self.bias)
        for g in set(grams(text)):
            if g in self.weights:
                z = z + self.weights[g]
        return {f: float(p) for f, p, t in zip(self.families, sigmoid(z), self.threshold, strict=True) if p >= t}


def _made(rows: int, seed: int = 7) -> list[tuple[str, int]]:
    """Paragraphs by rule: templates with words lost, replaced and put around them, the long ones also in part, and ordinary ones (class -1), in turns."""
    rng = np.random.default_rng(seed)
    families = list(TEMPLATES)
    vocabulary = [w for t in ORDINARY for w in WORD.findall(t.lower())] + FILLER
    out = []
    for k in range(rows):
        some = lambda n: [vocabulary[i] for i in rng.integers(len(vocabulary), size=n)]
        if k % 2:
            f = int(rng.integers(len(families)))
            ws = TEMPLATES[families[f]][int(rng.integers(len(TEMPLATES[families[f]])))].split()
            if len(ws) > 14 and rng.random() < 0.5:
                n = int(rng.integers(len(ws) * 3 // 5, len(ws) + 1))
                at = int(rng.integers(len(ws) - n + 1))
                ws = ws[at : at + n]
            ws = [w if rng.random() > 0.03 or len(ws) < 4 else some(1)[0] for w in ws]
            out.append((" ".join(some(int(rng.integers(4))) + ws + some(int(rng.integers(4)))), f))
        else:
            base = ORDINARY[int(rng.integers(len(ORDINARY)))].split() if rng.random() < 0.5 else []
            out.append((" ".join(some(int(rng.integers(12))) + base + some(int(rng.integers(12)))), -1))
    return out


def fit(rows: int = MADE, least: int = 8, lasso: float = 3e-4, steps: int = 150) -> LicenseModel:
    """Trains on the driver; three quarters fit the weights, the rest calibrates the thresholds."""
    made = _made(rows)
    # rows come in turns, one of a family and one ordinary; every fourth pair of rows calibrates
    train, rest = [m for i, m in enumerate(made) if i // 2 % 4], [m for i, m in enumerate(made) if i // 2 % 4 == 0]
    df = Counter(g for t, _ in train for g in set(grams(t)))
    names = sorted(g for g, n in df.items() if n >= least and any(map(tells, g.split())))
    at = {g: i for i, g in enumerate(names)}

    def matrix(ms: list[tuple[str, int]]) -> np.ndarray:
        x = np.zeros((len(ms), len(names)))
        for i, (t, _) in enumerate(ms):
            for g in set(grams(t)):
                if g in at:
                    x[i, at[g]] = 1
        return x

    x, y = matrix(train), np.array([f for _, f in train])
    hx, hy = matrix(rest), np.array([f for _, f in rest])
    step = 4 / (np.linalg.norm(x, 2) ** 2 / len(x) + 1)
    w, b = np.zeros((len(names), len(TEMPLATES))), np.full(len(TEMPLATES), -3.0)
    goal = (y[:, None] == np.arange(len(TEMPLATES))).astype(float)
    for _ in range(steps):
        e = (sigmoid(x @ w + b) - goal) / len(x)
        w = np.maximum(w - step * (x.T @ e) - step * lasso, 0)  # only n-grams that speak for a family
        b = np.minimum(b - step * e.sum(axis=0), -2.0)
    p = sigmoid(hx @ w + b)
    threshold = []
    for k in range(len(TEMPLATES)):
        own, others = p[hy == k, k], p[hy != k, k]
        low = float(np.quantile(others, 1 - OTHERS)) if len(others) else 0.5
        high = float(np.quantile(own, 1 - OWN_KEPT)) if len(own) else 1.0
        threshold.append(round(min(0.9, max(0.05, (low + high) / 2 if low < high else low)), 4))
    kept = {g: [round(float(v), 6) for v in w[i]] for g, i in at.items() if w[i].max() > 1e-3}
    return LicenseModel(list(TEMPLATES), kept, [float(v) for v in b], threshold)


def confirmed(text: str, family: str) -> tuple[float, int]:
    """The largest share of a template's word bigrams that the text has, and that template's number."""
    bigrams = lambda t: set(zip(ws := WORD.findall(t.lower()), ws[1:], strict=False))
    own = bigrams(text)
    shares = [len(own & (b := bigrams(t))) / max(1, len(b)) for t in TEMPLATES[family]]
    best = max(range(len(shares)), key=lambda k: (shares[k], -k))
    return shares[best], best


def _windows() -> tuple[dict[tuple[str, str], list[int]], list[tuple[str, int, int]]]:
    """The templates (by number) that have a bigram; each one's family, distinct bigrams and longest window in words."""
    having: dict[tuple[str, str], list[int]] = {}
    about = []
    for family, templates in TEMPLATES.items():
        for t in templates:
            ws = WORD.findall(t.lower())
            own = set(zip(ws, ws[1:], strict=False))
            for b in own:
                having.setdefault(b, []).append(len(about))
            about.append((family, len(own), len(ws) + len(ws) // 2 + 2))
    return having, about


HAVING, ABOUT = _windows()


def statements(lines: list[str], model: LicenseModel, confirm: float = CONFIRM) -> list[tuple[int, int, str, float, float]]:
    """(first line, last line, family, probability, template_share) of what a paragraph's lines state."""
    words = [(w.lower(), k) for k, line in enumerate(lines) for w in WORD.findall(line)]
    hits: dict[int, list[tuple[int, tuple[str, str]]]] = {}
    for at in range(len(words) - 1):
        b = (words[at][0], words[at + 1][0])
        for t in HAVING.get(b, ()):
            hits.setdefault(t, []).append((at, b))
    found = []
    for t, places in hits.items():
        family, size, reach = ABOUT[t]
        i = 0
        while i < len(places):
            best: list[tuple[int, tuple[str, str]]] = []
            stop = i + 1
            for j in range(i, len(places)):
                if j > i and (j >= stop or not best):
                    break
                own: set = set()
                last = j
                for k in range(j, len(places)):
                    if places[k][0] >= places[j][0] + reach:
                        break
                    if places[k][1] not in own:
                        own.add(places[k][1])
                        last = k
                if len(own) >= confirm * size and len(own) > len({b for _, b in best}):
                    best = places[j : last + 1]
                    stop = max(stop, last + 1)
            if not best:
                i += 1
                continue
            while best[0][1] in {b for _, b in best[1:]}:
                best = best[1:]
            i = next((k for k in range(i, len(places)) if places[k][0] > best[-1][0]), len(places))
            first, end = best[0][0], best[-1][0] + 1
            p = model.over(" ".join(w for w, _ in words[first : end + 1])).get(family)
            if p is not None:
                found.append(({at for at, _ in best}, len({b for _, b in best}) / size, family, p, words[first][1], words[end][1]))
    holding: dict[int, list[int]] = {}
    for m, o in enumerate(found):
        for at in o[0]:
            holding.setdefault(at, []).append(m)
    out, told = [], set()
    for n, (at, share, family, p, first, last) in enumerate(found):
        hidden = any(m != n and at <= found[m][0] and (len(found[m][0]), found[m][1], -m) > (len(at), share, -n) for m in holding[min(at)])
        own = {(family, k) for k in range(first, last + 1)}
        if not hidden and not own & told:
            told |= own
            out.append((first, last, family, p, share))
    return sorted(out)


def text_rows(text: str, model: LicenseModel, anchored: re.Pattern, confirm: float = CONFIRM) -> list[tuple[int, str, float, float]]:
    """(line, family, probability, template_share) of a text."""
    lines = text.split("\n")
    rows = []
    at = 0
    while at < len(lines):
        end = at
        while end < len(lines) and lines[end].strip():
            end += 1
        part = lines[at:end]
        with_anchor = [k for k, line in enumerate(part) if anchored.search(line)]
        if with_anchor:
            single: list[tuple[int, str, float, float]] = []
            for k in with_anchor:
                family, p = model.predict(part[k])
                if family != "unknown":
                    share = confirmed(part[k], family)[0]
                    single.append((k, family if share >= confirm else "unknown", p, share))
            whole = statements(part, model, confirm)
            covered, named = {k for a, b, *_ in whole for k in range(a, b + 1)}, {(f, k) for k, f, *_ in single}
            rows += [(at + k, f, p, s) for k, f, p, s in single if f != "unknown" or k not in covered]
            rows += [(at + a, f, p, s) for a, b, f, p, s in whole if not any((f, k) in named for k in range(a, b + 1))]
        at = end + 1
    return sorted(rows)


def scan(docs: DataFrame, model: LicenseModel, confirm: float = CONFIRM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, family, probability, template_share): a row for each licence statement, at its first line, and for each line predicted as one and not confirmed (family ``unknown``)."""
    anchored = r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(re.escape(a) for a in model.anchors()) + r")(?![\p{L}\p{N}])"
    python = re.compile(r"(?i)(?<![^\W_])(?:" + "|".join(re.escape(a) for a in model.anchors()) + r")(?![^\W_])")
    read = fresh(docs, "text_read")
    texts = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(read)).where(F.col(read).rlike(anchored))
    schema = T.StructType([docs.schema[id_col], T.StructField("line", T.IntegerType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("template_share", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *r) for i, text in enumerate(batch[read]) for r in text_rows(text, model, python, confirm)]
            out = pd.DataFrame(rows, columns=["row_number_", "line", "family", "probability", "template_share"])
            ids = batch[id_col].iloc[out.pop("row_number_").astype(int)] if rows else batch[id_col].iloc[:0]
            out.insert(0, id_col, ids.array)
            yield out.astype({"line": "int32", "probability": float, "template_share": float})

    return texts.mapInPandas(run, schema)

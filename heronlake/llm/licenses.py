"""Licence scans with DataFrame functions only.

A text is a row of words with the numbers of their lines; blank lines end paragraphs. What is judged is each short line, and
windows of the text that overlap so far that any notice as long as the longest template lies in one of them, however it is
wrapped. A paragraph is described by its hashed words and word pairs (none across a blank line), and a sparse logistic
regression gives the probability of each licence family and of none. The probabilities are calibrated by a temperature, and
a threshold makes what is uncertain unknown; both are set on templates that the model hadn't seen. A prediction stands only
if the paragraph holds half of the word pairs of a template of that family, and of predictions that share words the one that
agrees best stands. The model is trained in numpy on the driver, from templates alone, so its size and its training don't
depend on the data; scoring is one projection of the scan.

Paragraphs without a telling word or pair (:data:`TELLING`) aren't judged, which loses nothing: in every template fewer than
half of the pairs do without one, so none of those paragraphs could be confirmed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

#: Short notices and telling sentences of public licences, by family.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "Apache License Version 2.0, January 2004",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GPL, version 2.",
        "Released under the GPLv3 license.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Released under the LGPL license.",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "Released under the AGPL license.",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "mpl": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the MPL 2.0 license.",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-nd": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "Released into the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Released under the Unlicense.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright 2024 Example Corporation. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the copyright holder.",
    ),
}
#: Sentences with the same cue words that are no licences.
OTHERS = (
    "He lost his driving license and had to renew the licence at the office.",
    "The software license manager was down all day.",
    "She asked for permission to leave the room.",
    "The restaurant applied for a liquor license last year.",
    "The court discussed copyright law and the rights of authors.",
    "Apache helicopters were seen over the city.",
    "He studied at MIT and moved to Boston.",
    "The warranty of the car ends after three years.",
    "A wild gnu crossed the river in the morning.",
    "The public was invited and all seats were reserved.",
    "License plates must be visible at all times.",
    "They discussed the redistribution of wealth in the region.",
    "The copyright dispute went on for several years.",
    "Licensed professionals may apply for the position.",
    "The domain of the function is public knowledge.",
    "What license should we choose for the new project?",
)
BUCKETS, NONE = 1 << 16, "none"
FAMILIES = (NONE, *TEMPLATES)
SPLIT = "[^a-z0-9]+"
#: Words too common to tell anything.
COMMON = frozenset(
    "a above all an and any are as at be by can do either for from has have hereby if in including is it its may no not of on or other "
    "out shall should that the these this to under use used was will with without work you your".split()
)
#: Words by which windows follow each other.
STEP = 24


def words_of(text: str) -> list[str]:
    return [x for x in re.split(SPLIT, text.lower()) if x]


def pairs_of(text: str) -> list[str]:
    w = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))  # noqa: B905


def grams(text: str) -> list[str]:
    """Words and pairs of neighbouring words, distinct, in lower case."""
    return list(dict.fromkeys([*words_of(text), *pairs_of(text)]))


_ALL = [t for ts in TEMPLATES.values() for t in ts]
#: Words of the longest template, and of a window.
LONGEST = max(len(words_of(t)) for t in _ALL)
SPAN = LONGEST + STEP
#: The share of a template's pairs that confirms a prediction.
AGREEMENT = 0.5


def _enough(grams: set[str]) -> bool:
    """Whether in every template fewer than that share of the pairs do without any of the words and pairs."""
    return all(sum(not grams.intersection([p, *p.split()]) for p in pairs_of(t)) < AGREEMENT * len(pairs_of(t)) for t in _ALL)


def _telling() -> frozenset[str]:
    """Uncommon words of the templates, and pairs of their short words and numbers, as few as are enough."""
    short = {w for t in _ALL for w in words_of(t) if len(w) < 3 or w.isdigit()}
    grams = {w for t in _ALL for w in words_of(t)} - COMMON - short | {p for t in _ALL for p in pairs_of(t) if short.issuperset(p.split())}
    assert _enough(grams)
    for w in sorted(grams, key=lambda w: (any(map(str.isdigit, w)), len(w), w)):
        if _enough(grams - {w}):
            grams.remove(w)
    return frozenset(grams)


TELLING = _telling()


def _any_of(words: frozenset[str]) -> str:
    """A pattern that finds any of some words and pairs: a tree of their letters, so that each place is tried once."""

    def tree(rest: list[str]) -> str:
        heads = sorted({w[0] for w in rest if w})
        parts = [("[^a-z0-9]+" if h == " " else h) + tree([w[1:] for w in rest if w and w[0] == h]) for h in heads]
        return ("(?:" + "|".join(parts) + ")" + ("?" if "" in rest else "")) if parts else ""

    return f"(?<![a-z0-9]){tree(sorted(words))}(?![a-z0-9])"


def bucket(gram: str) -> int:
    h = xxh64_intdigest(gram, seed=42)  # as the SQL function has it
    return (h - (1 << 64) if h >> 63 else h) % BUCKETS


@dataclass
class Model:
    weights: np.ndarray  # families by buckets, most of them zero
    bias: np.ndarray
    temperature: float
    threshold: float
    agreement: float = AGREEMENT


def examples(copies: int, rng: np.random.Generator) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
    """Altered copies of the templates and other sentences among filling: their buckets, families and numbers of sources."""
    letters = np.array(list("aeioustrnl"))
    common = sorted({w for t in OTHERS for w in words_of(t)} | COMMON)

    def fill(n: int) -> list[str]:
        known = rng.random(n) < rng.random()  # the rest are words that no template has
        unknown = rng.choice(letters, (n, 8))
        return [common[i] if k else "".join(w[:m]) for k, i, w, m in zip(known, rng.integers(0, len(common), n), unknown, rng.integers(3, 9, n), strict=True)]

    rows, labels, sources = [], [], []
    for y, family in enumerate(FAMILIES):
        for i, text in enumerate(OTHERS if family == NONE else TEMPLATES[family]):
            for k in range(copies):
                words = text.split()
                if k:
                    words = [w for w, c in zip(words, rng.random(len(words)) > rng.choice([0.0, 0.1]), strict=True) if c]
                    around = rng.integers(0, max(2, SPAN - len(words)))
                    before = rng.integers(0, around + 1)
                    words = [*fill(before), *words, *fill(around - before)]
                rows.append([bucket(g) for g in grams(" ".join(words))])
                labels.append(y)
                sources.append(i)
    for i in range(20 * copies):  # filling alone is no licence
        rows.append([bucket(g) for g in grams(" ".join(fill(rng.integers(1, SPAN))))])
        labels.append(0)
        sources.append(i)
    return rows, np.array(labels), np.array(sources)


def trained(x: np.ndarray, y: np.ndarray, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by proximal gradient: the penalty on absolute weights makes them sparse."""
    t = np.eye(len(FAMILIES), dtype=np.float32)[y]
    w, bias, rate = np.zeros((x.shape[1], len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32), 2.0
    for _ in range(epochs):
        z = x @ w + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - t) / len(x)
        w -= rate * (x.T @ g)
        bias -= rate * g.sum(0)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * 2e-5, 0)
    return w, bias


@cache
def fit(seed: int = 5, copies: int = 24, epochs: int = 200, folds: int = 3) -> Model:
    """Train on altered copies of all templates; calibrate on models that had not seen a third of the templates each."""
    rows, y, source = examples(copies, np.random.default_rng(seed))
    used = np.unique([bucket(g) for t in (*_ALL, *OTHERS, *COMMON) for g in grams(t)])
    x = np.zeros((len(rows), len(used)), np.float32)
    for i, r in enumerate(rows):
        x[i, np.flatnonzero(np.isin(used, r))] = 1
    unseen = np.zeros((len(rows), len(FAMILIES)))
    for k in range(folds):
        held = source % folds == k
        w, bias = trained(x[~held], y[~held], epochs)
        unseen[held] = x[held] @ w + bias

    def probabilities(temperature: float) -> np.ndarray:
        q = unseen / temperature
        p = np.exp(q - q.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    temperature = min(np.linspace(0.3, 3, 28), key=lambda t: -float(np.log(probabilities(t)[np.arange(len(y)), y]).mean()))
    others = probabilities(temperature)[y == 0][:, 1:].max(1)
    w, bias = trained(x, y, epochs)
    weights = np.zeros((len(FAMILIES), BUCKETS))
    weights[:, used] = np.round(w.T, 5)
    return Model(weights, np.round(bias.astype(float), 5), float(temperature), float(np.quantile(others, 0.99)))


def _numbers(values, kind: str = "double") -> Column:
    """An array literal that the optimizer folds, of any length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _strings(values) -> Column:
    return F.split(F.lit("\n".join(values)), "\n")


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _hashed(s: Column) -> Column:
    return F.pmod(F.xxhash64(s), F.lit(BUCKETS)).cast("int")


def _words(text: Column, model: Model, used: np.ndarray) -> Column:
    """The words of a text: (line, next, pair, u, v, tells); next is the line of the next word, u and v number the weights of
    the word and its pair from 1 on. A line without a word gives one row without any."""
    numbers = np.zeros(BUCKETS, int)
    numbers[used] = 1 + np.arange(len(used))
    tells = np.zeros(BUCKETS, int)
    tells[[bucket(w) for w in TELLING]] = 1
    number, tell = _numbers(numbers, "int"), _numbers(tells, "int")

    def line(t: Column, i: Column) -> Column:
        found = F.filter(F.split(F.lower(t), SPLIT), lambda w: w != "")
        return _with(found, lambda ws: F.transform(F.when(F.size(ws) > 0, ws).otherwise(F.array(F.lit(""))), lambda w: F.struct(w.alias("w"), i.alias("line"))))

    def joined(x: Column, y: Column) -> Column:
        pair = F.when((x["w"] != "") & (y["w"] != ""), F.concat(x["w"], F.lit(" "), y["w"]))  # null after the last word
        word = F.when(x["w"] != "", x["w"])
        return _with(
            F.struct(word.alias("w"), pair.alias("p")),
            lambda g: F.struct(
                x["line"].alias("line"),
                F.coalesce(y["line"], x["line"]).alias("next"),
                g["p"].alias("pair"),
                F.when(g["w"].isNotNull(), number[_hashed(g["w"])]).otherwise(0).alias("u"),
                F.when(g["p"].isNotNull(), number[_hashed(g["p"])]).otherwise(0).alias("v"),
                F.coalesce(tell[_hashed(g["w"])] + F.coalesce(tell[_hashed(g["p"])], F.lit(0)) > 0, F.lit(False)).alias("tells"),
            ),
        )

    flat = F.flatten(F.transform(F.split(text, "\n"), line))
    return _with(flat, lambda ws: F.zip_with(ws, F.slice(ws, 2, F.greatest(F.size(ws), F.lit(1))), joined))


def _judged(x: Column, at: Column, alone: Column, model: Model, used: np.ndarray) -> Column:
    """(line, last, family, probability, agreement, confirmed, start, words, alone) of a run of words from place ``at`` on."""
    k = len(used)
    flat, bias = _numbers(np.concatenate([np.zeros((len(FAMILIES), 1)), model.weights[:, used]], 1).ravel()), _numbers(model.bias)
    classes = _numbers(range(len(FAMILIES)), "int")
    ids = F.array_distinct(F.filter(F.concat(F.transform(x, lambda w: w["u"]), F.transform(x, lambda w: w["v"])), lambda i: i > 0))
    scores = _with(
        ids, lambda a: F.transform(classes, lambda c: F.aggregate(a, bias[c], lambda t, f: t + flat[c * (k + 1) + f]) / model.temperature)
    )

    def agreeing(best: Column) -> Column:
        """The best (share, pairs) of the family's templates."""
        pairs = F.array_distinct(F.filter(F.transform(x, lambda w: w["pair"]), lambda p: p.isNotNull()))

        def of(i: int) -> Column:
            own = [pairs_of(t) for t in TEMPLATES[FAMILIES[i]]]
            return _with(pairs, lambda held: F.array_max(F.array(*(F.struct((F.size(F.array_intersect(held, _strings(o))) / F.lit(float(len(o)))).alias("share"), _strings(o).alias("pairs")) for o in own))))

        found = F.when(best == 1, of(1))
        for i in range(2, len(FAMILIES)):
            found = found.when(best == i, of(i))
        return found

    def decided(z: Column) -> Column:
        best = F.array_position(z, F.array_max(z)).cast("int") - 1
        total = F.aggregate(z, F.lit(0.0), lambda t, v: t + F.exp(v - F.array_max(z)))
        return _with(F.struct(best.alias("best"), (1 / total).alias("p"), agreeing(best).alias("a")), placed)

    def placed(d: Column) -> Column:
        sure = F.coalesce((d["best"] > 0) & (d["p"] >= model.threshold) & (d["a"]["share"] >= model.agreement), F.lit(False))
        own = F.when(sure, F.filter(F.transform(x, lambda w, i: F.struct(w["line"].alias("line"), w["next"].alias("last"), i.alias("i"), w["pair"].alias("p"))), lambda w: F.array_contains(d["a"]["pairs"], w["p"])))

        def row(own: Column) -> Column:
            return F.struct(
                F.coalesce(F.array_min(F.transform(own, lambda w: w["line"])), x[0]["line"]).alias("line"),
                F.coalesce(F.array_max(F.transform(own, lambda w: w["last"])), F.element_at(x, -1)["line"]).alias("last"),
                F.element_at(_strings(FAMILIES), d["best"] + 1).alias("family"),
                d["p"].alias("probability"),
                F.coalesce(d["a"]["share"], F.lit(0.0)).alias("agreement"),
                sure.alias("confirmed"),
                (at + F.coalesce(F.array_min(F.transform(own, lambda w: w["i"])), F.lit(0))).alias("start"),
                (at + F.coalesce(F.array_max(F.transform(own, lambda w: w["i"])), F.size(x) - 1)).alias("end"),
                alone.alias("alone"),
            )

        return _with(own, row)

    return _with(scores, decided)


def _standing(judged: Column) -> Column:
    """Of confirmed paragraphs that share words the one that agrees best, or else the shortest; and the other lines."""
    order = F.array_sort(
        F.transform(
            F.filter(judged, lambda x: x["confirmed"]),
            lambda x: F.struct((-x["agreement"]).alias("less"), (x["end"] - x["start"]).alias("more"), x["start"].alias("start"), x["end"].alias("end"), x.alias("x")),
        )
    )
    kind = "line:int,last:int,family:string,probability:double,agreement:double,confirmed:boolean,start:int,end:int,alone:boolean"
    taken = F.aggregate(
        order,
        F.expr(f"cast(array() as array<struct<{kind}>>)"),
        lambda done, x: F.when(F.exists(done, lambda y: (y["start"] <= x["end"]) & (x["start"] <= y["end"])), done).otherwise(F.concat(done, F.array(x["x"]))),
    )
    rest = F.filter(judged, lambda x: ~x["confirmed"] & x["alone"])
    fields = ("line", "last", "family", "probability", "agreement", "confirmed")
    return _with(taken, lambda t: F.transform(F.array_sort(F.concat(t, rest)), lambda x: F.struct(*(x[f].alias(f) for f in fields))))


def scan(docs: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, families, paragraphs): one row for each input row, over its whole text.

    ``paragraphs`` has the confirmed notices, and the other lines of up to a window's words that hold a telling word: the
    numbers of the first and last line from 0, the family (none for no licence), the calibrated probability, the share of a
    template's word pairs that it holds, and whether the prediction is confirmed. Of confirmed paragraphs that share words
    the one that agrees best stands, or else the shortest. ``families`` holds the confirmed families, sorted. Null and empty
    texts have no paragraphs, the key may be null, repeated rows stay, other columns are ignored. No shuffle and no Python.
    """
    model = model or fit()
    used = np.flatnonzero(model.weights.any(0))
    telling = F.lower(text).rlike(_any_of(TELLING))
    none = F.expr("cast(array() as array<struct<line:int,last:int,family:string,probability:double,agreement:double,confirmed:boolean>>)")

    def units(ws: Column) -> Column:
        """(at, n, alone): the places of lines of up to a window's words, and of windows."""
        n = F.size(ws)
        starts = F.filter(F.transform(ws, lambda x, i: F.when((i == 0) | (ws[F.greatest(i - 1, F.lit(0))]["line"] != x["line"]), i).otherwise(-1)), lambda i: i >= 0)
        lines = _with(starts, lambda s: F.zip_with(s, F.concat(F.slice(s, 2, F.size(s)), F.array(n)), lambda a, b: F.struct(a.alias("at"), (b - a).alias("n"), F.lit(True).alias("alone"))))
        spans = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(STEP)), lambda a: F.struct(a.alias("at"), F.lit(SPAN).alias("n"), F.lit(False).alias("alone")))
        return F.concat(F.filter(lines, lambda u: u["n"] <= SPAN), spans)

    def judge(ws: Column) -> Column:
        cut = F.transform(units(ws), lambda u: F.struct(u["at"].alias("at"), u["alone"].alias("alone"), F.slice(ws, u["at"] + 1, u["n"]).alias("x")))
        cut = F.filter(cut, lambda u: F.exists(u["x"], lambda w: w["tells"]))
        return _with(F.transform(cut, lambda u: _judged(u["x"], u["at"], u["alone"], model, used)), _standing)

    found = docs.select(F.col(key), F.when(F.coalesce(telling, F.lit(False)), _with(_words(F.col(text), model, used), judge)).otherwise(none).alias("paragraphs"))
    families = F.array_sort(F.array_distinct(F.transform(F.filter("paragraphs", lambda p: p["confirmed"]), lambda p: p["family"])))
    return found.select(key, families.alias("families"), "paragraphs")

"""Licence families of paragraphs by a sparse word n-gram logistic regression.

A multinomial model over word and word-pair presence, with the unknown class as reference, is fitted
with an L1 penalty on notices of each family, altered copies of them, and paragraphs of the
corpus; its temperature is calibrated on notices and paragraphs held out as a whole. A prediction is confirmed by
comparing the paragraph with the notices of the family.

A paragraph ends at a blank line, or at a line that ends a sentence; its lines are joined, so notices may be
wrapped. All paragraphs of all documents are judged with DataFrame functions. The unknown class has weight 0, so a
paragraph without any n-gram that speaks for a family is unknown; only paragraphs with a word of such
an n-gram are scored, each distinct one once.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.arrays import running
from barloom.llm.samples import smallest
from barloom.session import settle

#: Bounds of the fit: paragraphs taken from the corpus (one of a document), altered copies of a notice.
FIT_PARAGRAPHS, COPIES = 2000, 16
UNKNOWN = "unknown"
#: Lines with a visible character that follow one another, up to one that ends a sentence (with at most 16 blanks after its last sign).
LINE = r"[^\S\n]*+\S[^\n]*+"
PARAGRAPH = rf"(?:{LINE}(?<![.!?])(?<![.!?][^\S\n]{{1,16}})\n)++(?:{LINE})?+|{LINE}"


#: Short public notices of each family: fixed values.
NOTICES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license.",
        "You may obtain a copy of the License at http www apache org licenses LICENSE-2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004, terms and conditions for use, reproduction, and distribution."),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "This project is licensed under the MIT License.",
        "Released under the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "This software is licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007."),
    "lgpl": (
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
        "Licensed under the LGPL version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library."),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Affero General Public License along with this program."),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http mozilla org MPL 2.0."),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This article is distributed under the terms of the Creative Commons Attribution License.",
        "This is an open access article distributed under the Creative Commons Attribution License, which permits unrestricted use, distribution, and reproduction in any medium, provided the original work is properly cited.",
        "This work is licensed under CC BY 4.0; to view a copy of this license, visit http creativecommons org licenses by 4.0."),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "To view a copy of this license, visit http creativecommons org licenses by-sa 4.0."),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "To view a copy of this license, visit http creativecommons org licenses by-nc 4.0.",
        "This is an open access article under the CC BY-NC license, for noncommercial use only."),
    "cc0": (
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "This work is dedicated to the public domain under CC0.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law."),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission.",
        "This content is confidential and proprietary; redistribution is prohibited.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited; proprietary and confidential."),
}
#: Words that alone tell nothing about licences.
COMMON = frozenset("a an and any are as at be by can do for from has in is it its may no not of on or shall that the their these this those to under was were when which who will "
                   "with without you your".split())


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def ngrams(text: str) -> set[str]:
    w = words(text)
    return {g for g in [*w, *map(" ".join, zip(w, w[1:]))] if not COMMON.issuperset(g.split(" "))}


def pairs(text: str) -> set[str]:
    w = words(text)
    return set(map(" ".join, zip(w, w[1:])))


@dataclass(frozen=True)
class LicenseModel:
    """``weights[ngram]`` has a number for each family; the unknown class has none and no bias."""

    families: tuple[str, ...]
    bias: np.ndarray
    weights: dict[str, np.ndarray]
    temperature: float

    def cues(self) -> list[str]:
        """A word of every n-gram that speaks for some family: a paragraph without them is unknown."""
        return sorted({max((w for w in g.split(" ") if w not in COMMON), key=len) for g, w in self.weights.items() if w.max() > 0})


def altered(notice: str, telling: set[str], spare: list[str], rng: random.Random) -> str:
    """A copy with words dropped, but for those that only its family has, and words of other paragraphs around it."""
    kept = [w for w in notice.split() if telling.intersection(words(w)) or rng.random() > 0.08]
    other = rng.choice(spare).split() if spare else []
    cut = rng.randint(0, min(12, len(other)))
    return " ".join(rng.choice(([*kept], [*other[:cut], *kept], [*kept, *other[:cut]], [*other[:cut], *kept, *other[cut:2 * cut]])))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def regression(x: np.ndarray, y: np.ndarray, weigh: np.ndarray, rounds: int, penalty: float) -> np.ndarray:
    """Adam steps with soft thresholds on the penalised likelihood; the last column of ``x`` is the bias, the last of ``y`` the class without weights."""
    w = np.zeros((x.shape[1], y.shape[1] - 1))
    m, v, rate, s = np.zeros_like(w), np.zeros_like(w), 0.1, weigh / weigh.sum()
    for t in range(1, rounds + 1):
        p = softmax(np.hstack([x @ w, np.zeros((len(x), 1))]))
        g = x.T @ ((p - y)[:, :-1] * s[:, None])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        scale = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w -= scale * m / (1 - 0.9**t)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - np.minimum(scale[:-1], 10) * penalty, 0)
    return w


def fit(paragraphs: list[str], notices: dict[str, tuple[str, ...]] = NOTICES, copies: int = COPIES, rounds: int = 150, penalty: float = 2e-4, seed: int = 5) -> LicenseModel:
    """Weights from all rows, under the temperature that suits a fit without every fourth notice (with all its copies) and paragraph.

    ``paragraphs`` are of the unknown class but for those that hold most of a notice, which are left out.
    """
    rng = random.Random(seed)
    known = [pairs(n) for ns in notices.values() for n in ns]
    plain = [p for p in paragraphs if not any(len(pairs(p) & k) >= 0.6 * len(k) for k in known)]
    families = tuple(notices)
    rows = [(p, len(families), i % 4 == 0) for i, p in enumerate(plain)]
    # near misses: licence words out of place are not a licence
    vocabulary = sorted({w for ns in notices.values() for n in ns for w in words(n)})
    rows += [(" ".join([*rng.sample(vocabulary, 2), *(rng.choice(plain).split()[:20] if plain else [])]), len(families), i % 4 == 0) for i in range(20 * len(families))]
    used = {f: {w for n in ns for w in words(n)} for f, ns in notices.items()}
    for f, family in enumerate(families):
        telling = used[family].difference(*(w for g, w in used.items() if g != family))
        for i, n in enumerate(notices[family]):
            rows += [(t, f, i % 4 == 3) for t in [n, *(altered(n, telling, plain, rng) for _ in range(copies))]]
    rng.shuffle(rows)
    grams = [ngrams(t) for t, *_ in rows]
    place = {g: i for i, g in enumerate(sorted({g for ns in notices.values() for n in ns for g in ngrams(n)}))}
    x = np.zeros((len(rows), len(place) + 1))
    x[:, -1] = 1
    for i, g in enumerate(grams):
        x[i, [place[k] for k in g if k in place]] = 1
    y = np.eye(len(families) + 1)[[c for _, c, _ in rows]]
    weigh = (y / np.maximum(y.sum(axis=0), 1)).sum(axis=1)
    weigh[y[:, -1] == 1] *= 12
    held = np.array([h for *_, h in rows])
    part = regression(x[~held], y[~held], weigh[~held], rounds, penalty)
    logits = np.hstack([x[held] @ part, np.zeros((int(held.sum()), 1))])
    likely = [(-(np.log(softmax(logits / t)[y[held] == 1] + 1e-12)).mean(), t) for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)]
    w = regression(x, y, weigh, rounds, penalty)
    return LicenseModel(families, np.minimum(w[-1], -1e-6), {g: w[i] for g, i in place.items() if np.abs(w[i]).max() > 0}, min(likely)[1])


def paragraphs_of(text: Column) -> Column:
    """All paragraphs of a text."""
    return F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))


def trained(docs: DataFrame, text: str = "text", key: str = "doc_id", fit_paragraphs: int = FIT_PARAGRAPHS) -> LicenseModel:
    """Model with at most ``fit_paragraphs`` corpus paragraphs, one, picked by hash, of each document with the smallest hashes of the key."""
    some = smallest(docs.filter(F.col(text).isNotNull()).select(key, text), F.col(key), fit_paragraphs).select(key, paragraphs_of(F.col(text)).alias("all"))
    picked = some.filter(F.size("all") > 0).select(F.col("all")[F.expr(f"pmod(xxhash64({key}, 3), size(all))").cast("int")].alias("p"))
    return fit(sorted(r["p"] for r in picked.collect()))


def sql_words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda w: w != "")


def sql_pairs(w: Column) -> Column:
    return F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def cut(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, paragraph (from 0), first_line, last_line (from 0) and line (the paragraph, its lines not yet joined) of all paragraphs."""
    def breaks(part: Column) -> Column:
        return (F.length(part) - F.length(F.replace(part, F.lit("\n"), F.lit("")))).cast("long")

    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).filter(F.col("text").isNotNull())
    docs = docs.select("doc_id", paragraphs_of(F.col("text")).alias("all"), F.split("text", PARAGRAPH, -1).alias("between"))
    docs = docs.withColumn("steps", F.transform("all", lambda p, i: breaks(p) + breaks(F.col("between")[i]))).withColumn("before", running(F.col("steps")))
    spans = F.transform("all", lambda p, i: F.struct((F.col("before")[i] + breaks(F.col("between")[i])).alias("first_line"), p.alias("line")))
    rows = docs.select("doc_id", F.posexplode(spans).alias("paragraph", "s")).select("doc_id", "paragraph", "s.first_line", "s.line")
    return rows.withColumn("last_line", F.col("first_line") + breaks(F.rtrim(F.col("line"), F.lit(" \t\r\n\f\x0b"))))


def scanned(docs: DataFrame, model: LicenseModel, key: str = "doc_id", text: str = "text", least: float = 0.5, alike: float = 0.6) -> DataFrame:
    """A row for every paragraph with a licence word: doc_id, paragraph, first_line and last_line (all from 0), family, probability, similarity, confirmed.

    ``family`` is 'unknown' where no family has a calibrated probability of ``least`` or more. ``similarity``
    is the largest share of word pairs in common with a notice of the family, of the shorter one
    of both; from ``alike`` on the prediction is confirmed. Null texts have no paragraphs; repeated rows repeat their rows.
    """
    spark = docs.sparkSession
    cues = F.array(*[F.lit(c) for c in model.cues()])
    # words do not span lines, so only documents with a cue have a paragraph with one
    some = docs.filter(F.arrays_overlap(sql_words(F.col(text).cast("string")), cues))
    lines = cut(some, key, text).filter(F.arrays_overlap(sql_words(F.col("line")), cues)).withColumn("digest", F.unhex(F.md5("line")))
    # scores and the result both start from these paragraphs
    lines = settle(lines, "paragraphs")
    # model and notices are constants of a few hundred rows, whatever the corpus
    table = F.broadcast(spark.createDataFrame([(g, [float(v) for v in w]) for g, w in model.weights.items()], "ngram string, w array<double>"))
    notices = F.broadcast(spark.createDataFrame([(f, sorted(pairs(n))) for f, ns in NOTICES.items() for n in ns], "family string, pairs array<string>"))
    # each different paragraph is scored once, under its digest
    distinct = lines.groupBy("digest").agg(F.first("line").alias("line")).select("digest", sql_words(F.col("line")).alias("words"))
    grams = distinct.select("digest", F.explode(F.array_distinct(F.concat("words", sql_pairs(F.col("words"))))).alias("ngram")).join(table, "ngram")
    logits = [(F.sum(F.col("w")[i]) + float(b)) / model.temperature for i, b in enumerate(model.bias)]
    scored = grams.groupBy("digest").agg(F.array(*logits).alias("z"))
    chance = scored.withColumn("all", F.aggregate("z", F.lit(1.0), lambda t, z: t + F.exp(F.least(z, F.lit(500.0))))).withColumn("top", F.array_max("z"))
    named = F.element_at(F.array(*[F.lit(f) for f in model.families]), F.array_position("z", F.col("top")).cast("int"))
    judged = chance.withColumn("probability", F.exp(F.least("top", F.lit(500.0))) / F.col("all")).withColumn("likely", named).withColumn(
        "family", F.when(F.col("probability") >= least, F.col("likely")).otherwise(UNKNOWN))
    own = sql_pairs(F.col("words"))
    share = F.size(F.array_intersect("pairs", "own")) / F.greatest(F.lit(1), F.least(F.size("pairs"), F.size(F.array_distinct("own"))))
    near = judged.filter(F.col("family") != UNKNOWN).select("digest", "family").join(distinct, "digest").withColumn("own", own).join(notices, "family").groupBy("digest").agg(F.max(share).alias("similarity"))
    verdict = judged.join(near, "digest", "left").select("digest", "family", "probability", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
    return lines.drop("line").join(verdict, "digest", "left").select(
        "doc_id", "paragraph", "first_line", "last_line", F.coalesce("family", F.lit(UNKNOWN)).alias("family"), F.coalesce("probability", F.lit(0.0)).alias("probability"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"), (F.coalesce("similarity", F.lit(0.0)) >= alike).alias("confirmed"))

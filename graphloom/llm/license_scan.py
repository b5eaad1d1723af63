"""Licence scan by a trained paragraph classifier, in DataFrame operations alone.

A sparse logistic regression over word 1- and 2-grams is trained on licence texts and on ordinary prose, both fixed
and short, when first asked for; its weights are a small table.  A paragraph is a run of lines without a blank one
(or one without words, such as a bare comment mark).  Paragraphs may mix prose and notices, so a paragraph is cut into
pieces (lines, and sentences in them), and each run of pieces that look like licence text is classed as a whole; a
piece that is one of the one-line notices is classed by itself.  A class for unknown text, calibrated on texts left
out of the training, takes what is no licence.  A prediction counts as confirmed when the run holds most of the n-grams
of one of the family's templates, or nearly all of its own n-grams are those of one template.
"""
from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN, RESERVED = "unknown", "Proprietary"
#: Least share of a template's n-grams for confirmation, and least probability of a family.
CONFIRM, LEAST = 0.6, 0.5
#: Least share of a run's own n-grams in one template, where the run is but a part of it, and least number of them.
INSIDE, INSIDE_GRAMS = 0.8, 15
#: Templates of at most so many words are one-line notices.
ONE_LINE = 14
#: Pieces of at most so many words that are all licence words may stand in a run; a run has so many words at least.
FEW = 3
#: A reservation of rights at most so many pieces before a notice is part of it (a copyright line, a blank line).
APART = 4

# Licence notices by family, and prose that is none.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("GPL", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("LGPL", "You should have received a copy of the GNU Lesser General Public License along with this library; if not, see https://www.gnu.org/licenses/."),
    ("LGPL", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("BSD", "Released under the BSD 3-Clause License."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC", "Licensed under CC BY-NC 4.0."),
    ("CC", "Licensed under CC BY-SA 4.0."),
    ("CC", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related rights. CC0 1.0 Universal."),
    (RESERVED, "All rights reserved."),
    (RESERVED, "All rights reserved. Unauthorized copying of this file is strictly prohibited."),
    (RESERVED, "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
]
PROSE = [
    "The author was granted a licence to drive in the city.", "He is a licensed doctor under the new law.", "The work is free and open to the public.",
    "The version of the story in this book is the first.", "You may use this road at your own risk.", "The license plate of the car was new.",
    "General terms of trade changed over the years.", "A copy of the letter was found in the file.", "Public works were released in the spring.",
    "Das Werk ist in der Stadt und die Lizenz fehlt.", "Le permis de conduire est valable dans le pays.", "La licencia de la obra no es pública.",
    "It is the first of the two and it was in the house.", "She had to go to the source of the river with the others.",
    "Conditions are met when the work is done by noon.", "All the rights and the wrongs of the case.", "MIT is a university in Cambridge.", "Apache helicopters flew over the field.",
    "The following day they met in binary code class.", "Creative work is common among writers.", "version 3 of the map", "under the bridge", "the general public", "in compliance with the plan",
    "The software of the bank was provided by a firm in the north.", "Any person in the house may use the garden and the road.", "They were liable for the damages to the house and the car.",
    "The notice on the door was in all the papers.", "He was in no event to be found at the office of the firm.", "The names of the contributors to the journal were not known.",
    "The law of the land and the terms of the treaty were kept by all.", "See the map for more details of the way.", "If not, he can obtain one at the market in the town.",
]
#: Prose that takes no part in the training; it calibrates.
OTHER_PROSE = [
    "The free software movement grew in the years that followed.", "The court granted permission to use the land for any purpose.", "Copies of the book were sold without a fee.",
    "The state provided a copy of the law to any person who asked.", "Each of the following conditions was named in the contract.", "The authors were liable for none of the claims in the action.",
    "The public had the right to use and copy the work.", "It was distributed in the hope that it would be read.", "The license was required by the law of the state.",
    "With or without the others, they went on to the source.", "The source and the binary stars are in this list.", "In this file the names of the holders are kept.",
]


def words_of(text: str) -> list[str]:
    """The words of the SQL side: lower case, runs of ASCII letters, digits and letters beyond ASCII."""
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isascii() and c.isalnum() or not c.isascii():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def grams_of(words: list[str]) -> list[str]:
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))})


class Classifier:
    """Weights per n-gram and class, and the temperature that calibrates them."""

    def __init__(self, steps: int = 400):
        rows = [(f, words_of(t)) for f, t in TEMPLATES] + [(UNKNOWN, words_of(t)) for t in PROSE]
        # a notice may stand inside other words, or be cut short: parts of each template count for its family
        more = []
        for f, t in TEMPLATES:
            w = words_of(t)
            for cut in (2, 3):
                if len(w) > 3 * cut:
                    more += [(f, w[cut:]), (f, w[:-cut])]
            more += [(f, w[k : k + 24]) for k in range(0, len(w) - 24, 12)]
        rows += [r for i, r in enumerate(more) if i % 4]
        self.left_out = [(f, grams_of(w)) for f, w in [*(r for i, r in enumerate(more) if i % 4 == 0), *((UNKNOWN, words_of(t)) for t in OTHER_PROSE)]]
        self.classes = [UNKNOWN, *sorted({f for f, _ in TEMPLATES})]
        self.vocabulary = sorted({g for f, w in rows if f != UNKNOWN for g in grams_of(w)})
        number = {c: i for i, c in enumerate(self.classes)}
        place = {g: i for i, g in enumerate(self.vocabulary)}
        x = np.zeros((len(rows), len(place)))
        for i, (_, w) in enumerate(rows):
            x[i, [place[g] for g in grams_of(w) if g in place]] = 1.0
        scale = 1.0 / np.sqrt(np.maximum(1.0, x.sum(axis=1, keepdims=True)))
        truth = np.eye(len(number))[[number[f] for f, _ in rows]]
        each = 1.0 / truth.sum(axis=0)[truth.argmax(axis=1)][:, None]  # every family weighs the same
        weights, bias = np.zeros((len(place), len(number))), np.zeros(len(number))
        bias[0] = 1.0
        for step in range(steps):
            z = x @ weights + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            error = (truth - p / p.sum(axis=1, keepdims=True)) * each * len(number)
            rate = 0.5 / (1 + step / 100)
            weights += rate * (x.T @ (error * scale)) / 4
            weights = np.sign(weights) * np.maximum(0.0, np.abs(weights) - 1e-4 * rate)  # sparse: small weights fall to 0
            bias += 0.02 * rate * error.sum(axis=0) / 4
        self.weights = {g: [round(float(v), 6) for v in weights[i]] for g, i in place.items() if np.abs(weights[i]).max() >= 0.02}
        self.bias = [round(float(v), 6) for v in bias]
        self.temperature = min((t / 4 for t in range(1, 33)), key=self._loss)

    @staticmethod
    def _softmax(z: list[float], temperature: float) -> list[float]:
        top = max(z)
        e = [math.exp((v - top) / temperature) for v in z]
        return [v / sum(e) for v in e]

    def _loss(self, temperature: float) -> float:
        number = {c: i for i, c in enumerate(self.classes)}
        return -sum(math.log(max(1e-12, self.probabilities(grams, temperature)[number[f]])) for f, grams in self.left_out)

    def probabilities(self, grams: list[str], temperature: float | None = None) -> list[float]:
        known = [self.weights[g] for g in grams if g in self.weights]
        return self._softmax([b + sum(w[c] for w in known) for c, b in enumerate(self.bias)], temperature or self.temperature)


@lru_cache(1)
def classifier() -> Classifier:
    return Classifier()


#: Line ends with the blanks before them, and blanks between sentences.
PIECES = r"[ \t\r]*\n|(?<=[.!?])[ \t]+(?=\p{Lu})"


def _once(df: DataFrame, **parts: Column) -> DataFrame:
    """Adds columns that are evaluated once per row and not copied into the expressions that use them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in parts.items()]))))


def _pairs(words: str) -> Column:
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def _grams(words: str) -> Column:
    return F.array_distinct(F.concat(F.col(words), F.filter(_pairs(words), lambda x: x.isNotNull())))


def _literal(grams: list[str]) -> Column:
    return F.array(*map(F.lit, grams))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, paragraph, last, words): the runs of licence-like pieces of each text, from piece ``paragraph`` to ``last``;
    with null words the first piece of each row, and a run of fewer than ``FEW`` words.

    ``row`` tells repeated rows and ids apart.
    """
    every = {g for f, t in TEMPLATES for g in grams_of(words_of(t))}
    pairs, singles = sorted(g for g in every if " " in g), sorted(g for g in every if " " not in g)
    short = [grams_of(words_of(t)) for _, t in TEMPLATES if len(words_of(t)) <= ONE_LINE]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = rows.select("row", "id", F.posexplode(F.split(F.coalesce("text", F.lit("")), PIECES)).alias("pos", "piece"))
    pieces = _once(pieces, w=F.filter(F.split(F.lower("piece"), r"[^a-z0-9\x80-\x{10FFFF}]+"), lambda w: w != ""))
    pieces = _once(pieces, two=F.filter(_pairs("w"), lambda x: x.isNotNull()))
    pieces = _once(pieces, known=F.size(F.filter("two", lambda x: x.isin(pairs))))
    few = F.size("w").between(1, FEW) & (F.col("known") == F.size("two")) & F.forall("w", lambda x: x.isin(singles))
    pieces = pieces.where((F.col("known") >= 2) | (F.col("pos") == 0) | few)
    pieces = _once(pieces, grams=F.when(F.col("known") >= 2, _grams("w")))
    held = [F.size(F.array_intersect("grams", _literal(t))) for t in short]
    one = F.greatest(*[h / F.lit(float(len(t))) for h, t in zip(held, short)])
    alike = F.greatest(*[h / (F.size("grams") + len(t) - h) for h, t in zip(held, short)])
    pieces = _once(pieces, one=F.coalesce(one, F.lit(0.0)), alike=F.coalesce(alike, F.lit(0.0)))
    strong = (F.col("known") >= 2) & ((2 * F.col("known") >= F.size("two")) | (F.col("one") >= CONFIRM))
    pieces = pieces.select("row", "id", "pos", "w", (strong | few).alias("like"),
                           ((F.col("alike") >= CONFIRM) & F.col("piece").rlike(r"[.!?]\W*$|SPDX-")).alias("alone"))
    pieces = pieces.where(F.col("like") | (F.col("pos") == 0))
    order = Window.partitionBy("row").orderBy("pos")
    goes_on = F.col("like") & F.lag("like").over(order) & (F.lag("pos").over(order) == F.col("pos") - 1) & ~F.col("alone") & ~F.lag("alone").over(order)
    pieces = pieces.withColumn("new", F.coalesce(~goes_on, F.lit(True)).cast("int"))
    pieces = pieces.withColumn("run", F.sum("new").over(order))
    found = pieces.groupBy("row", "run").agg(F.first("id").alias("id"), F.min("pos").alias("paragraph"), F.max("pos").alias("last"),
                                             F.array_sort(F.collect_list(F.when(F.col("like"), F.struct("pos", "w")))).alias("parts"))
    found = _once(found, held=F.flatten(F.col("parts.w")))
    return found.select("row", "id", "paragraph", "last", F.when(F.size("held") >= FEW, F.col("held")).alias("words"))


def _scored(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, paragraph, last, family, probability, similarity, confirmed): each run, family null for what is no licence."""
    model = classifier()
    spark = docs.sparkSession
    values = ", ".join(f"('{g}', {', '.join(f'{x!r}D' for x in w)})" for g, w in model.weights.items())
    names = [f"w{i}" for i in range(len(model.classes))]
    weights = spark.sql(f"SELECT * FROM VALUES {values} AS t(gram, {', '.join(names)})")
    held = runs(docs, id_col, text_col)
    held = held.select("row", "id", "paragraph", "last", F.inline(F.array(F.struct(F.when(F.col("words").isNotNull(), _grams("words")).alias("grams")))))
    each = held.select("row", "id", "paragraph", "last", F.size("grams").alias("size"), F.explode_outer("grams").alias("gram")).join(F.broadcast(weights), "gram", "left")
    sums = each.groupBy("row", "paragraph").agg(
        F.first("id").alias("id"), F.first("last").alias("last"), F.collect_set("gram").alias("grams"),
        *[(F.round(F.coalesce(F.sum(n), F.lit(0.0)), 9) + F.lit(b)).alias(n) for n, b in zip(names, model.bias)])
    z = _once(sums, z=F.array(*names))
    p = _once(z, p=F.transform("z", lambda x: F.exp((x - F.array_max("z")) / model.temperature)))
    p = _once(p, top=F.array_max(F.slice("p", 2, len(names))))
    share = F.col("top") / F.aggregate("p", F.lit(0.0), lambda x, y: x + y)
    p = _once(p, share=share, best=F.element_at(_literal(model.classes[1:]), F.array_position(F.slice("p", 2, len(names)), F.col("top")).cast("int")))
    sure = (F.size("grams") > 0) & (F.col("top") > F.get("p", F.lit(0))) & (F.col("share") >= LEAST)
    got = p.select("row", "id", "paragraph", "last", "grams", F.when(sure, F.col("best")).alias("family"), F.when(sure, F.col("share")).alias("probability"))
    shown = ", ".join("('{}', array({}))".format(f, ", ".join(f"'{g}'" for g in grams_of(words_of(t)))) for f, t in TEMPLATES)
    templates = spark.sql(f"SELECT * FROM VALUES {shown} AS t(family, template)")
    compared = _once(got.join(F.broadcast(templates), "family", "left"), both=F.size(F.array_intersect("grams", "template")).cast("double"))
    near = compared.groupBy("row", "paragraph").agg(
        F.first("id").alias("id"), F.first("last").alias("last"), F.first("family").alias("family"), F.first("probability").alias("probability"),
        F.max(F.col("both") / F.size("template")).alias("similarity"), F.max(F.when(F.size("grams") >= INSIDE_GRAMS, F.col("both") / F.size("grams"))).alias("inside"))
    confirmed = (F.col("similarity") >= CONFIRM) | F.coalesce(F.col("inside") >= INSIDE, F.lit(False))
    near = near.withColumn("confirmed", F.coalesce(confirmed, F.lit(False)))
    # "All rights reserved." right before a notice is part of that notice
    order = Window.partitionBy("row").orderBy("paragraph")
    followed = F.col("confirmed") & (F.col("family") == RESERVED) & F.lead("confirmed").over(order) & (F.lead("family").over(order) != RESERVED) & (F.lead("paragraph").over(order) - F.col("last") <= APART)
    near = near.withColumn("part", F.coalesce(followed, F.lit(False)))
    return near.select("row", "id", "paragraph", "last", F.when(~F.col("part"), F.col("family")).alias("family"), "probability", "similarity", F.col("confirmed") & ~F.col("part"))\
        .toDF("row", "id", "paragraph", "last", "family", "probability", "similarity", "confirmed")


def scan_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, paragraph, last, family, probability, similarity, confirmed) of each run of pieces classed as some licence family,
    from its first piece (from 0: a line, or a sentence where a line holds several) to its last.

    Of equal probabilities the first family in order wins.
    """
    return _scored(docs, id_col, text_col).where(F.col("family").isNotNull())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_licences (confirmed notices), families (sorted, comma-joined; empty: none), n_unconfirmed,
    top_probability (of the confirmed notices, 6 digits; null: none).

    Null and empty texts have none.  Repeated rows are rows of their own; a null id stays null; an empty table gives none;
    other columns are not read, whatever their names.
    """
    sure, named = F.col("confirmed"), F.col("family").isNotNull()
    per = _scored(docs, id_col, text_col).groupBy("row").agg(
        F.first("id").alias(id_col), F.count_if(sure).alias("n_licences"), F.concat_ws(",", F.sort_array(F.collect_set(F.when(sure, F.col("family"))))).alias("families"),
        F.count_if(named & ~sure).alias("n_unconfirmed"), F.round(F.max(F.when(sure, F.col("probability"))), 6).alias("top_probability"))
    return per.select(id_col, "n_licences", "families", "n_unconfirmed", "top_probability")

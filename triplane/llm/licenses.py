"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

A template is compared with windows of a text's words, wherever they lie: line ends, paragraphs and what stands before or
after don't matter. Windows begin and end at bigrams that the template has too, and have sizes at which they can be similar
enough; a text is read further only if it holds one of the bigrams without which no window is similar to any template.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from math import ceil, floor
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplane.llm.common import durable, fresh, once, table, text_key

SIMILAR = 0.8
# Possessive, as Java's matcher recurses for each other turn of a group.
WORDS = r"[\p{L}\p{N}]++(?:[.-][\p{L}\p{N}]++)*+"
#: For templates of more bigrams, windows begin only at the first of adjacent bigrams that the template has.
SHORT = 32
BROADCAST_ROWS = 200_000

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU = """is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. {it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details. You should have received a copy of the GNU {kind}General Public License along with {of}. If not, see <https://www.gnu.org/licenses/>."""
_GPL_3 = "This program " + _GNU.format(kind="", version="3", it="This program", of="this program")
_GPL_2 = "This program " + _GNU.format(kind="", version="2", it="This program", of="this program").replace("; without", "; without").replace("If not, see <https://www.gnu.org/licenses/>.", "if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.")
_AGPL_3 = "This program " + _GNU.format(kind="Affero ", version="3", it="This program", of="this program")
_LGPL_3 = "This library " + _GNU.format(kind="Lesser ", version="3", it="This library", of="this library")
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _whole(name: str) -> str:
    return (Path(__file__).parent / "license_texts" / f"{name}.txt").read_text(encoding="utf-8")


#: Name and text; a licence may have several.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GPL_3),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GPL_2),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _LGPL_3),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _AGPL_3),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", _MPL),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_3} {_BSD_END}"),
    ("BSD", "Use of this source code is governed by a BSD-style license."),
    ("ISC", _ISC),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", _whole("Apache-2.0")),
    ("GPL-2.0", _whole("GPL-2")),
    ("GPL-3.0", _whole("GPL-3")),
    ("LGPL-2.1", _whole("LGPL-2.1")),
    ("LGPL-3.0", _whole("LGPL-3")),
    ("MPL-2.0", _whole("MPL-2.0")),
)

_PLAIN = {*"a an and any are as at be by for from in is it not of on or such that the this to under was will with you".split()}


def bigrams(text: str) -> Counter:
    """Word bigrams of a text, normalised as by the operator."""
    found = [w.lower() for w in re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", text)]
    return Counter(f"{a} {b}" for a, b in zip(found, found[1:], strict=False))


@cache
def probes(templates: tuple[tuple[str, str], ...], similar: float) -> list[str]:
    """Bigrams of which a window holds one if it is similar to any template.

    A similar window shares at least s / (2 - s) of the template's bigrams, so it can't miss all of a set that holds more
    than the rest. The sets prefer bigrams of words that prose rarely has.
    """
    out = set()
    for _, text in templates:
        found = bigrams(text)
        missed = floor(sum(found.values()) * (1 - similar / (2 - similar)) + 1e-9)
        taken = 0
        for b, n in sorted(found.items(), key=lambda x: (sum(w in _PLAIN for w in x[0].split()), -len(x[0]), x[0])):
            if taken > missed:
                break
            out.add(b)
            taken += n
    return sorted(out)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def size_bounds(n: int, similar: float) -> tuple[int, int]:
    """Sizes that a window may have to reach a Dice coefficient with a template of n bigrams."""
    return ceil(n * similar / (2 - similar) - 1e-9), floor(n * (2 - similar) / similar + 1e-9)


def _among(values: list[str]) -> str:
    """SQL: a list of literals."""
    return "(" + ",".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) + ")"


KIND = "array<struct<license:string,template:int,dice:double,segment:string>>"


def _hits(docs: DataFrame, templates: tuple[tuple[str, str], ...], similar: float) -> DataFrame:
    """Rows ``key_a, key_b, template, n, high, need, hits``: per text and template that may be similar, where it has the
    template's bigrams: an array of ``place, older``, rising.

    older: where the same bigram stands as many of its kind before as the template has of it, or -1. A window that begins
    beyond it counts the hit; one that begins before has met that bigram often enough.
    """
    spark = docs.sparkSession
    counts = [bigrams(t) for _, t in templates]
    known = []
    for k, c in enumerate(counts):
        n = sum(c.values())
        low, high = size_bounds(n, similar)
        known += [(g, k, often, n, high, low) for g, often in c.items()]
    known = spark.createDataFrame(known, "gram string, template int, often int, n int, high int, need int")  # as many as the templates have
    one = docs.where(F.col("text").isNotNull()).select(*text_key(F.col("text")), _words(F.col("text")).alias("words"))
    pairs = once(one, grams=F.slice(F.transform("words", lambda w, i: F.concat_ws(" ", w, F.get(F.col("words"), i + 1))), 1, F.greatest(F.size("words") - 1, F.lit(0)))).drop("words")
    asked = pairs.where(F.expr(f"exists(grams, g -> g in {_among(probes(templates, similar))})"))
    places = asked.select("key_a", "key_b", F.posexplode("grams").alias("place", "gram")).join(F.broadcast(known), "gram")
    # Equal texts have equal places, so a set of them has each once.
    by = places.groupBy("key_a", "key_b", "template", "gram", "often", "n", "high", "need").agg(F.array_sort(F.collect_set("place")).alias("places"))
    listed = by.groupBy("key_a", "key_b", "template", "n", "high", "need").agg(F.sum(F.least(F.size("places"), F.col("often"))).alias("most"), F.collect_list(F.struct("places", "often")).alias("grams")).where("most >= need")
    aged = lambda g: F.transform(g["places"], lambda p, m: F.struct(p.alias("place"), F.coalesce(F.get(g["places"], m - g["often"]), F.lit(-1)).alias("older")))
    return once(listed, hits=F.array_sort(F.flatten(F.transform("grams", aged)))).drop("grams", "most")


def _best_windows(hits: DataFrame, similar: float) -> DataFrame:
    """Rows ``key_a, key_b, template, dice, start, end, shared``: of each text and template the most similar window."""
    at = lambda i: F.get(F.col("hits"), i)["place"]
    full = lambda x, i: at(i + F.col("need") - 1) < x["place"] + F.col("high")
    first = lambda x, i: (F.col("n") <= SHORT) | F.coalesce(at(i - 1) < x["place"] - 1, F.lit(True))
    none = F.struct(F.lit(0).alias("shared"), F.lit(0.0).alias("dice"), F.lit(-1).alias("end"), F.lit(0).alias("best"))

    def window(x: Column, i: Column) -> Column:
        start = x["place"]

        def step(acc: Column, y: Column) -> Column:
            shared = acc["shared"] + (y["older"] < start).cast("int")
            dice = 2.0 * shared / (y["place"] - start + 1 + F.col("n"))
            better = dice > acc["dice"]
            longer = F.struct(
                shared.alias("shared"), F.when(better, dice).otherwise(acc["dice"]).alias("dice"), F.when(better, y["place"]).otherwise(acc["end"]).alias("end"), F.when(better, shared).otherwise(acc["best"]).alias("best")
            )
            return F.when(y["place"] < start + F.col("high"), longer).otherwise(acc)

        found = F.aggregate(F.slice("hits", i + 1, F.col("high")), none, step)
        return F.struct(found["dice"].alias("dice"), (-start).alias("back"), found["end"].alias("end"), found["best"].alias("shared"))

    windows = F.transform("hits", lambda x, i: F.when(full(x, i) & first(x, i), window(x, i)))
    best = once(hits, best=F.array_max(F.filter(windows, lambda w: w["dice"] >= similar - 1e-12)))
    return best.where("best is not null").select("key_a", "key_b", "template", "best.dice", (-F.col("best.back")).alias("start"), "best.end", "best.shared")


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, similar: float = SIMILAR) -> DataFrame:
    """``docs`` with ``licenses`` added: an array of ``license, template, dice, segment``, best first.

    segment: the words of the window most like the template, of equal ones the first. A template is left out where another
    is more similar to an overlapping window and shares as many bigrams. A null or empty text has none; texts are taken
    whole; all rows stay, repeated ones too, and an empty table stays empty. A column ``licenses`` is replaced.
    """
    docs = docs.drop("licenses")
    ka, kb, found, words = (fresh(docs, x) for x in ("_ka", "_kb", "_found", "_words"))
    windows = _best_windows(_hits(docs.select("text"), templates, similar), similar).groupBy("key_a", "key_b")
    windows = durable(windows.agg(F.collect_list(F.struct("dice", "template", "start", "end", "shared")).alias("found")).toDF(ka, kb, found))  # as many as templates
    a, b = text_key(F.col("text"))
    few = windows.count() <= BROADCAST_ROWS
    out = docs.join(F.broadcast(windows) if few else windows, (a == F.col(ka)) & (b == F.col(kb)), "left").drop(ka, kb)
    out = once(out, **{words: F.when(F.col(found).isNotNull(), _words(F.col("text")))})
    over = lambda x, y: (x["start"] <= y["end"]) & (y["start"] <= x["end"]) & (y["dice"] > x["dice"]) & (y["shared"] >= x["shared"])
    stay = F.filter(found, lambda x: ~F.exists(found, lambda y: over(x, y)))
    order = lambda x, y: F.when(x["dice"] > y["dice"], -1).when(x["dice"] < y["dice"], 1).otherwise(x["template"] - y["template"])
    names = F.array(*(F.lit(name) for name, _ in templates))
    told = F.transform(
        F.array_sort(stay, order),
        lambda x: F.struct(F.get(names, x["template"]).alias("license"), x["template"].alias("template"), x["dice"].alias("dice"), F.array_join(F.slice(words, x["start"] + 1, x["end"] - x["start"] + 2), " ").alias("segment")),
    )
    return once(out, licenses=F.coalesce(told, F.array().cast(KIND))).drop(found, words)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and licence template that it holds."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.explode("licenses").alias("x")).select("doc_id", "x.license", "x.template", F.round("x.dice", 6).alias("dice"), "x.segment")

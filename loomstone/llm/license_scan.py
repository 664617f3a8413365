"""License scans by the Dice coefficient over word bigrams, in DataFrame operations only.

The units of a document are its lines, its paragraphs and its whole text, and windows of its words where a template is
found across or within them. A unit and a template can only reach the threshold t if the smaller has at least t / (2 - t)
of the bigrams of the larger: units outside every template's bounds never get bigrams, and a unit is compared with a
template within the template's bounds, if its document holds enough of the template's bigrams at all. A window that
reaches t holds that many of the template's bigrams, and the best ones start and end with one: only windows between two
of the template's bigrams are compared. As a window grows, its bigrams are counted on: one is new in the window if it
occurred last before the window began.
"""

from __future__ import annotations

from json import dumps
from math import ceil, floor
from pathlib import Path

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import ready, table

THRESHOLD = 0.85
#: Whole licenses, as text files beside this module: one template a file, named like it.
TEXTS = Path(__file__).with_name("licenses")

#: License texts and notices, by name.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
    "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE "
    "ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY "
    "OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_APACHE_HEADER = (
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License."
)
_GPL3_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
    "any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU General Public License for more details."
)
_ZLIB = (
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
    "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim "
    "that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, "
    "and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
TEMPLATES = {
    "mit-text": _MIT,
    "isc-text": _ISC,
    "bsd-2-text": _BSD_HEAD + _BSD_TAIL,
    "bsd-3-text": _BSD_HEAD + _BSD_NAMES + _BSD_TAIL,
    "zlib-text": _ZLIB,
    "apache-2-header": _APACHE_HEADER,
    "gpl-3-header": _GPL3_HEADER,
    "mit-notice": "Released under the MIT License.",
    "apache-2-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2-notice": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "cc-by-4-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4-notice": "Licensed under CC BY-ND 4.0.",
    "bsd-3-notice": "Released under the BSD 3-Clause License.",
    "all-rights-reserved": "All rights reserved.",
}

TEMPLATES |= {
    "mit-named": "This project is licensed under the MIT License.",
    "apache-2-named": "This project is licensed under the Apache License 2.0.",
    "gpl-3-named": "This project is licensed under the GNU GPL v3.",
    "gpl-2-named": "This project is licensed under the GNU GPL v2.",
    "mpl-2-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense-head": "This is free and unencumbered software released into the public domain.",
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "isc-spdx": "SPDX-License-Identifier: ISC",
    "zlib-spdx": "SPDX-License-Identifier: Zlib",
    "unlicense-spdx": "SPDX-License-Identifier: Unlicense",
    "apache-2-spdx": "SPDX-License-Identifier: Apache-2.0",
    "bsd-2-spdx": "SPDX-License-Identifier: BSD-2-Clause",
    "bsd-3-spdx": "SPDX-License-Identifier: BSD-3-Clause",
    "mpl-2-spdx": "SPDX-License-Identifier: MPL-2.0",
    "gpl-2-spdx": "SPDX-License-Identifier: GPL-2.0",
    "gpl-3-spdx": "SPDX-License-Identifier: GPL-3.0",
    "lgpl-2-1-spdx": "SPDX-License-Identifier: LGPL-2.1",
    "lgpl-3-spdx": "SPDX-License-Identifier: LGPL-3.0",
    "agpl-3-spdx": "SPDX-License-Identifier: AGPL-3.0",
    "cc0-1-spdx": "SPDX-License-Identifier: CC0-1.0",
    "cc-by-4-spdx": "SPDX-License-Identifier: CC-BY-4.0",
    "cc-by-sa-4-spdx": "SPDX-License-Identifier: CC-BY-SA-4.0",
}

TEMPLATES |= {f"{f.stem.lower()}-full": f.read_text(encoding="utf-8") for f in sorted(TEXTS.glob("*.txt"))}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    low = text.translate(str.maketrans(_UPPER, _LOWER))
    return "".join(c if c in _LOWER or c in "0123456789" else " " for c in low).split()


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(m: int, threshold: float) -> range:
    """The bigram counts with which a unit can reach the threshold against a template of m."""
    return range(ceil(m * threshold / (2 - threshold) - 1e-9), floor(m * (2 - threshold) / threshold + 1e-9) + 1)


def anchors(bigrams: list[str], threshold: float) -> set[str]:
    """Words without which a text misses too many of the bigrams to reach the threshold, rare (long) ones first."""
    spare, left, found = len(bigrams) - bounds(len(bigrams), threshold).start, list(bigrams), set()
    for w in sorted({w for b in bigrams for w in b.split()}, key=lambda w: (-len(w), w)):
        if len(bigrams) - len(left) > spare:
            break
        found.add(w)
        left = [b for b in left if w not in b.split()]
    return found


def normalised(text: Column) -> Column:
    """Lower-cased words of a-z and 0-9 with single spaces between; line ends stay. Only ASCII is left when cases are folded."""
    return F.lower(F.regexp_replace(text, "[^a-zA-Z0-9\n]+", " "))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kind, place, license, dice): a row for each unit and template at `threshold` or more.

    docs: doc_id, text (other columns are not read). Units: each line (kind 'line'), each paragraph between blank lines
    ('paragraph', if there are several) and the whole text ('text'); place counts from 0. Beyond them windows of
    consecutive words that don't overlap ('window', place is the first word), across lines and paragraphs, unless they
    start or end in a unit that matches the same template already. A window has at most as many words as the longest
    match, 2 / threshold - 1 times the template's. From left to right: where a window begins that reaches the threshold,
    the best of the windows that begin within it and overlap is a match, and the best that fits before that one; the
    search goes on after the match. Of windows with one beginning the best counts, of equal ones the shortest. One that
    could begin a word earlier, with one more of the template's bigrams, doesn't begin. Words are runs of a-z and 0-9
    after lower-casing A-Z; bigrams count once. Null and empty texts, and units of fewer than two words, match nothing.
    Repeated rows give repeated matches. An empty table gives an empty table. The templates are a parameter of fixed
    size and part of the plan; nothing is joined or broadcast. Everything happens within a document's row: it is split into words
    once, and goes no further without enough of a template's bigrams, which every matching unit or window of it would hold.
    """
    ready(docs.sparkSession)
    texts = {k: template_words(v) for k, v in (TEMPLATES if templates is None else templates).items()}
    sets = {k: template_bigrams(" ".join(v)) for k, v in texts.items()}
    sets = {k: v for k, v in sets.items() if v}
    vocabulary = _Bits({b for v in sets.values() for b in v})
    rows = []
    for k, v in sets.items():
        span = floor((len(texts[k]) - 1) * (2 - threshold) / threshold + 1e-9)
        rows.append({"license": k, "m": len(v), "need": bounds(len(v), threshold).start, "span": span, "theirs": v})
    known = F.from_json(F.lit(dumps(rows)), "array<struct<license: string, m: int, need: int, span: int, theirs: array<string>>>")
    most = max((bounds(len(v), threshold).stop - 1 for v in sets.values()), default=0)

    # A text without any of the anchors goes on its words alone, which take a split and no rewritten text.
    words = F.filter(F.split(F.translate("text", _UPPER, _LOWER), "[^a-z0-9]+"), lambda w: w != "")
    d = _once(docs.select("doc_id", "text"), "words", words).where(_may_match(sets, threshold))
    d = d.select("doc_id", "words", normalised(F.col("text")).alias("clean"))
    d = _once(d, "pairs", _pairs(F.col("words")))
    d = _once(d, "hits", F.filter(F.transform("pairs", lambda b, i: F.when(vocabulary.may_have(b), i)), lambda i: i.isNotNull())).where(F.size("hits") > 0)
    d = _once(d, "held", F.array_distinct(F.transform("hits", lambda i: F.get("pairs", i))))
    # Only templates that the number of hits alone lets in are compared, and only a document with one goes on.
    near = F.filter(known, lambda t: (F.size("held") >= t["need"]) & (F.size(F.array_intersect("held", t["theirs"])) >= t["need"]))
    d = _once(d, "near", near).where(F.size("near") > 0)
    d = _units(d, vocabulary, most)
    d = _around(d)
    d = d.select("*", F.explode("near").alias("t")).select("*", "t.*").drop("t", "held", "near")
    d = _once(d, "matched", _matches(threshold))
    d = _windows(d, vocabulary, threshold)
    windows = F.transform("taken", lambda w: F.struct(F.lit("window").alias("kind"), w["s"].alias("place"), w["dice"].alias("dice")))
    return d.select("doc_id", "license", F.explode(F.concat("matched", windows)).alias("u")).select("doc_id", "u.kind", "u.place", "license", "u.dice")


class _Bits:
    """A set of strings as bits of their hashes, one literal of the plan: what is in it is always found, and of a hundred others about one is too. Only a first sieve."""

    LOG = 20

    def __init__(self, strings: set[str]):
        words = [0] * (1 << self.LOG - 6)
        for b in strings:
            at = xxhash.xxh64_intdigest(b.encode(), 42) & (1 << self.LOG) - 1
            words[at >> 6] |= 1 << (at & 63)
        self.bits = F.from_json(F.lit(dumps([w - (1 << 64) * (w >> 63) for w in words])), "array<long>")

    def may_have(self, b: Column) -> Column:
        at = F.xxhash64(b)
        word = F.get(self.bits, F.shiftrightunsigned(at.bitwiseAND((1 << self.LOG) - 1), 6).cast("int"))
        return F.getbit(word, at.bitwiseAND(63).cast("int")) == 1


#: Templates of more bigrams are only looked for in texts that have as many words as a match needs.
LONG = 400


def _may_match(sets: dict[str, list[str]], threshold: float) -> Column:
    """Does the row with these `words` have an anchor of a template, and words enough for one of the long templates?"""
    some = F.lit(False)
    for long in (False, True):
        these = [v for v in sets.values() if (len(v) > LONG) == long]
        if these:
            rare = sorted(set().union(*[anchors(v, threshold) for v in these]))
            least = min(bounds(len(v), threshold).start for v in these)
            some = some | ((F.size("words") > least) & F.arrays_overlap("words", F.from_json(F.lit(dumps(rare)), "array<string>")))
    return some


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once, however often it is read."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _pairs(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1)))
    return F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \n]+"), lambda w: w != "")


def _dice(ours: Column) -> Column:
    """Of distinct bigrams and the template's."""
    return 2 * F.size(F.array_intersect(ours, F.col("theirs"))) / (F.size(ours) + F.col("m"))


def _units(d: DataFrame, vocabulary: _Bits, most: int) -> DataFrame:
    """d with `units` (kind, place, distinct bigrams) that some template's bounds let in, and `of_lines` and `of_paragraphs`, the unit of each word."""

    def fit(kind: str, units: Column) -> Column:
        """n distinct words make at least n - 1 distinct bigrams: units beyond every template's bounds get none."""
        sized = F.transform(units, lambda u, i: F.struct(i.alias("place"), u.alias("words")))
        sized = F.filter(sized, lambda u: (F.size(u["words"]) > 1) & (F.size(F.array_distinct(u["words"])) <= most + 1))
        paired = F.transform(sized, lambda u: F.struct(F.lit(kind).alias("kind"), u["place"].alias("place"), F.array_distinct(_pairs(u["words"])).alias("ours")))
        return F.filter(paired, lambda u: F.exists(u["ours"], vocabulary.may_have))

    for name, end in (("lines", "\n"), ("paragraphs", "\n[ \n]*\n")):
        d = _once(d, name, F.transform(F.split("clean", end), _words))
        d = _once(d, f"of_{name}", F.flatten(F.transform(name, lambda u, i: F.array_repeat(i, F.size(u)))))
    several = F.when(F.size("paragraphs") > 1, F.col("paragraphs")).otherwise(F.slice("paragraphs", 1, 0))
    return _once(d, "units", F.concat(fit("line", F.col("lines")), fit("paragraph", several), fit("text", F.array("words")))).drop("lines", "paragraphs", "words", "clean")


def _matches(threshold: float) -> Column:
    """(kind, place, dice) of the units that reach the threshold against the row's template; those outside its bounds can't."""
    near = F.filter("units", lambda u: F.size(u["ours"]).between(F.col("need"), F.floor(F.col("m") * ((2 - threshold) / threshold) + 1e-9)))
    scored = F.transform(near, lambda u: F.struct(u["kind"].alias("kind"), u["place"].alias("place"), _dice(u["ours"]).alias("dice")))
    return F.filter(scored, lambda u: u["dice"] >= threshold)


def _around(d: DataFrame) -> DataFrame:
    """d with `around`: of each bigram the places (before, after) where it occurs last before, and next; -1 and a place beyond all if it doesn't."""
    far = F.lit((1 << 31) - 1)
    d = _once(d, "in_order", F.array_sort(F.transform("pairs", lambda b, i: F.struct(b.alias("b"), i.alias("i")))))

    def beside(x: Column, k: Column, none: Column) -> Column:
        other = F.get("in_order", k)
        return F.coalesce(F.when(other["b"] == x["b"], other["i"]), none)

    placed = F.transform("in_order", lambda x, k: F.struct(x["i"].alias("i"), F.when(k > 0, beside(x, k - 1, F.lit(-1))).otherwise(-1).alias("before"), beside(x, k + 1, far).alias("after")))
    return _once(d, "around", F.array_sort(placed)).drop("in_order")


def _windows(d: DataFrame, vocabulary: _Bits, threshold: float) -> DataFrame:
    """d with `taken`: the matching windows (s, e, dice), without those that touch a matched unit."""
    d = _once(d, "at", F.when(F.exists("matched", lambda u: u["kind"] == "text"), F.slice("hits", 1, 0)).otherwise(F.filter("hits", lambda i: F.array_contains("theirs", F.get("pairs", i)))))
    # Of each place: before, after, and whether the template has its bigram.
    d = _once(d, "marks", F.when(F.size("at") < F.col("need"), F.array().cast("array<struct<before: int, after: int, hit: boolean>>")).otherwise(F.transform("pairs", lambda b, i: F.struct(F.get("around", i)["before"].alias("before"), F.get("around", i)["after"].alias("after"), F.when(vocabulary.may_have(b), F.array_contains("theirs", b)).otherwise(False).alias("hit")))))

    def best(s: Column, end: Column) -> Column:
        """The best window (s, e, dice) that begins at s and ends before `end`; dice 0 if there is none."""

        def grow(w: Column, x: Column) -> Column:
            new = F.when(x["before"] < s, 1).otherwise(0)
            d, h = w["d"] + new, w["h"] + F.when(x["hit"], new).otherwise(0)
            dice = 2 * h / (d + F.col("m"))
            better = x["hit"] & (dice > w["dice"])
            return F.struct(d.alias("d"), h.alias("h"), F.when(better, dice).otherwise(w["dice"]).alias("dice"), F.when(better, w["i"]).otherwise(w["e"]).alias("e"), (w["i"] + 1).alias("i"))

        start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("h"), F.lit(0.0).cast("double").alias("dice"), s.alias("e"), s.alias("i"))
        return F.aggregate(F.slice("marks", s + 1, F.least(F.col("span"), end - s)), start, grow, lambda w: F.struct(s.alias("s"), w["e"].alias("e"), w["dice"].alias("dice")))

    # A window that can reach the threshold has `need` of the template's bigrams within `span` places.
    dense = F.transform(F.filter(F.transform("at", lambda s, k: F.struct(s.alias("s"), F.get("at", k + F.col("need") - 1).alias("to"))), lambda x: x["to"] - x["s"] < F.col("span")), lambda x: x["s"])

    def begins(s: Column) -> Column:
        earlier = F.get("marks", s - 1)
        return (s == 0) | ~F.coalesce(earlier["hit"], F.lit(False)) | (earlier["after"] - s < F.col("span")) | (s - F.get("marks", s)["before"] < F.col("span"))

    d = _once(d, "starts", F.when(F.size("marks") > 0, F.filter(dense, begins)).otherwise(F.slice("hits", 1, 0)))
    d = _once(d, "bests", F.filter(F.transform("starts", lambda s: best(s, F.size("marks"))), lambda w: w["dice"] >= threshold))

    # What is being looked at: the window `now`, the beginning `first` and end `block` of the first one there.
    kind = "struct<s: int, e: int, dice: double, first: int, block: int>"
    none = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("now"))

    def look(acc: Column, w: Column) -> Column:
        now = acc["now"]
        fresh = F.struct(w["s"].alias("s"), w["e"].alias("e"), w["dice"].alias("dice"), w["s"].alias("first"), w["e"].alias("block"))
        better = F.struct(w["s"].alias("s"), w["e"].alias("e"), w["dice"].alias("dice"), now["first"].alias("first"), now["block"].alias("block"))
        over = w["s"] > F.least(now["block"], now["e"] + 1)
        closed = F.concat(acc["done"], F.array(now))
        ahead = (w["dice"] > now["dice"]) | ((w["dice"] == now["dice"]) & (w["e"] - w["s"] < now["e"] - now["s"]))
        blocked = F.coalesce(w["s"] <= F.try_element_at(acc["done"], F.lit(-1))["e"] + 1, F.lit(False))
        return (
            F.when(now.isNull(), F.struct(acc["done"].alias("done"), F.when(~blocked, fresh).cast(kind).alias("now")))
            .when(over, F.struct(closed.alias("done"), F.when(w["s"] > now["e"] + 1, fresh).cast(kind).alias("now")))
            .otherwise(F.struct(acc["done"].alias("done"), F.when(ahead, better).otherwise(now).cast(kind).alias("now")))
        )

    d = _once(d, "apart", F.aggregate("bests", none, look, lambda acc: F.when(acc["now"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))))

    def ordered(w: Column) -> Column:
        return F.struct((-w["dice"]).alias("less"), (w["e"] - w["s"]).alias("long"), w["s"].alias("s"), w["e"].alias("e"))

    def before(w: Column) -> Column:
        """The best window between the beginning of what was looked at and the match: there is room for one at most."""
        there = F.filter("bests", lambda b: (b["s"] >= w["first"]) & (b["s"] + F.col("need") < w["s"]))
        return F.get(F.array_sort(F.transform(there, lambda b: ordered(best(b["s"], w["s"] - 1)))), 0)

    gaps = F.filter(F.transform(F.filter("apart", lambda w: w["s"] - w["first"] > F.col("need")), before), lambda w: F.coalesce(-w["less"] >= threshold, F.lit(False)))
    whole = F.transform("apart", lambda w: F.struct(w["s"].alias("s"), w["e"].alias("e"), w["dice"].alias("dice")))
    d = _once(d, "parted", F.concat(whole, F.transform(gaps, lambda w: F.struct(w["s"].alias("s"), w["e"].alias("e"), (-w["less"]).alias("dice")))))

    def touches(w: Column, u: Column) -> Column:
        """What a unit matches is not found again: the window starts or ends in it."""
        inside = u["kind"] == "text"
        for kind, of in (("line", "of_lines"), ("paragraph", "of_paragraphs")):
            for place in (w["s"], w["e"] + 1):
                inside = inside | ((u["kind"] == kind) & (u["place"] == F.get(of, place)))
        return inside

    return _once(d, "taken", F.filter("parted", lambda w: ~F.exists("matched", lambda u: touches(w, u))))


def document_licenses(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, license (of the highest dice, then by name; null if none), dice, n_units, licenses (all names, sorted, comma-joined).

    Rows that share a doc_id get the matches of all of them. A null doc_id has no matches.
    """
    found = scan_licenses(docs, **options)
    best = F.max(F.struct(F.col("dice"), F.translate("license", _LOWER + "0123456789-", _LOWER[::-1] + "9876543210-").alias("last_first"), F.col("license")))
    by_doc = found.groupBy("doc_id").agg(best.alias("best"), F.countDistinct("kind", "place").alias("n_units"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"))
    return docs.select("doc_id").join(by_doc, "doc_id", "left").select("doc_id", F.col("best.license").alias("license"), F.round("best.dice", 6).alias("dice"), F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"), F.coalesce("licenses", F.lit("")).alias("licenses"))


def op3_license_scan(spark, sf_dir):
    return document_licenses(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    rows = ",\n  ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    words = "string_split(trim(regexp_replace(translate({}, '{}', '{}'), '[^a-z0-9]+', ' ', 'g')), ' ')"
    bigrams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return rf"""
WITH texts(license, text) AS (VALUES {rows}),
templates AS (SELECT license, {bigrams} AS theirs FROM (SELECT license, {words.format("text", _UPPER, _LOWER)} AS w FROM texts)),
clean AS (SELECT doc_id, regexp_replace(translate(text, '{_UPPER}', '{_LOWER}'), '[^a-z0-9\n]+', ' ', 'g') AS t FROM documents),
units AS (
  SELECT doc_id, 'line' AS kind, generate_subscripts(string_split(t, chr(10)), 1) AS place, unnest(string_split(t, chr(10))) AS unit FROM clean
  UNION ALL
  SELECT doc_id, 'paragraph', generate_subscripts(p, 1), unnest(p) FROM (SELECT doc_id, string_split_regex(t, '\n[ \n]*\n') AS p FROM clean) WHERE len(p) > 1
  UNION ALL
  SELECT doc_id, 'text', 0, t FROM clean),
words AS (SELECT doc_id, kind, place, string_split(trim(regexp_replace(unit, '[ \n]+', ' ', 'g')), ' ') AS w FROM units),
pairs AS (SELECT doc_id, kind, place, {bigrams} AS ours FROM words WHERE len(w) > 1),
found AS (  -- beyond these bounds 2 * min(a, b) / (a + b) is below the threshold
  SELECT doc_id, kind, place, license, 2 * len(list_intersect(ours, theirs)) / (len(ours) + len(theirs)) AS dice
  FROM pairs, templates WHERE len(ours) BETWEEN len(theirs) * 0.73 AND len(theirs) * 1.36),
kept AS (SELECT * FROM found WHERE dice >= {THRESHOLD}),
best AS (
  SELECT doc_id, first(license ORDER BY dice DESC, license) AS license, max(dice) AS dice, COUNT(DISTINCT kind || ':' || place) AS n_units,
         string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
  FROM kept GROUP BY doc_id)
SELECT d.doc_id, b.license, round(b.dice, 6) AS dice, COALESCE(b.n_units, 0) AS n_units, COALESCE(b.licenses, '') AS licenses
FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id
"""


ORACLE_SQL = _oracle()

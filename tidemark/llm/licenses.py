"""License scans: texts against licence templates by the Dice coefficient of their word bigrams, with DataFrame functions only.

A text is normalised to lower-case words of the letters A-Z and digits, and compared as
the set of its word pairs (a single word counts as a pair by itself). The units
compared are each line of a document, where it has several the document as a
whole, and all runs of its sentences (cut at line ends, too). Runs of words as such
are no units: a mention of one licence, less its last word, is near others. Two
sets of a and b pairs reach the coefficient 2 * shared / (a + b) >=
threshold only if b lies between a * t / (2 - t) and a * (2 - t) / t; so a unit
meets, by a hash join on its number of pairs, only the templates that such a
size allows. Before that, texts and units go that have none of the words without
which too few pairs of any template are left. Runs of sentences are looked at only
where a document has as many of a template's pairs as a unit near it must share,
and each is followed until it has more pairs than the size allows; the work is in proportion to the text, however often it repeats itself. Null and empty
texts have no unit; a document that names a licence
several times has one row for it, with its best coefficient and, of equal ones,
its first place (line from 0, for a run that of its first word; -1 for the whole document).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import stored

THRESHOLD = 0.8
#: A run of sentences is followed pair by pair over so many times the places that its allowed pairs take, before the text counts as one that repeats itself.
PROBE = 16
_NO_END = 1 << 30
#: Blanks after a sentence's last mark; before a digit they may stand in "v. 2.0".
SENTENCE_END = r"(?<=[.!?])\s+(?=[^0-9\s])"
#: Words that most texts hold, so that to look for them is of little use.
COMMON = frozenset("a all an and any are as at be by for from in is it no not of on or that the this to under with without".split())

#: Wordings by which texts name a licence, and the bodies of the shortest licences.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "The MIT License (MIT)"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3 or later."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Licensed under the ISC License."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
]


def template_pairs(text: str) -> list[str]:
    words = re.findall(r"[a-z0-9]+", text.lower())
    return sorted({" ".join(p) for p in zip(words, words[1:], strict=False)} or set(words))


def size_bounds(pairs: int, threshold: float) -> tuple[int, int]:
    """Least and greatest number of pairs that a unit near a template may have."""
    return math.ceil(pairs * threshold / (2 - threshold) - 1e-9), math.floor(pairs * (2 - threshold) / threshold + 1e-9)


def words_of(unit: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(unit, "[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")


def pairs_of(unit: Column) -> Column:
    return _let(words_of(unit), lambda words: F.when(F.size(words) < 2, words).otherwise(F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)))))


def keywords(pairs: list[str], threshold: float) -> set[str]:
    """Words of which a unit near the template has at least one: so many of the template's pairs hold one of them that a unit without any shares too few."""
    missing = len(pairs) - math.ceil(threshold * (len(pairs) + size_bounds(len(pairs), threshold)[0]) / 2 - 1e-9)
    left, chosen = [p.split(" ") for p in pairs], set()
    while len(pairs) - len(left) <= missing:
        word = max({w for p in left for w in p}, key=lambda w: (w not in COMMON, sum(w in p for p in left), len(w), w))
        chosen.add(word)
        left = [p for p in left if word not in p]
    return chosen


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _once(value: Column, name: str) -> Column:
    """A column whose value is made once: filters and uses are not moved through a generator."""
    return F.explode(F.array(value)).alias(name)


def _marked(each: Column) -> Column:
    """For each place of a text's pairs: ``pos``, the pair, whether a sentence begins and ends there, and the place before of the same pair (``prev``, -1 if none)."""
    def mark(by_pair: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.get(by_pair, i - 1)
            prev = F.when(before["pair"] == x["pair"], before["pos"]).otherwise(-1)
            return F.struct(x["pos"].alias("pos"), prev.alias("prev"), x["pair"].alias("pair"), x["begins"].alias("begins"), x["ends"].alias("ends"))

        return F.array_sort(F.transform(by_pair, one))

    return _let(F.array_sort(F.transform(each, lambda p, i: F.struct(p["pair"].alias("pair"), i.alias("pos"), p["begins"].alias("begins"), p["ends"].alias("ends")))), mark)


def _hits(marked: Column, pairs: Column) -> Column:
    """``marked`` with whether the template has the pair (``hit``) in the pair's place."""
    return F.transform(marked, lambda x: F.struct(x["pos"].alias("pos"), x["prev"].alias("prev"), F.array_contains(pairs, x["pair"]).alias("hit"), x["begins"].alias("begins"), x["ends"].alias("ends")))


def _best_run(marked: Column, size: Column, most: Column) -> Column:
    """The greatest coefficient of a run of sentences with a template of ``size`` pairs, and less its first place. A pair counts once in a run.

    A run grows until it has more pairs than allowed. Nearly always that is within
    ``PROBE`` times as many places; a text in which some run is longer, since it says the same again
    and again, is gone through backwards instead, so that either way the work is in proportion to the text.
    """
    ahead = lambda x, n: F.slice(marked, x["pos"] + 1, n)
    new = lambda x, pos: x["prev"] < pos
    enough = lambda x, n: F.size(F.filter(ahead(x, n), lambda y: new(y, x["pos"]))) > most
    longest = most * PROBE
    repeats = F.exists(marked, lambda x: x["begins"] & (F.size(marked) - x["pos"] > longest) & ~enough(x, most * 2) & ~enough(x, longest))
    return F.when(repeats, _best_backwards(marked, size, most)).otherwise(_best_forwards(marked, size, most))


def _best_forwards(marked: Column, size: Column, most: Column) -> Column:
    """From each sentence on, pair by pair: a pair is new where the one before it lies ahead of the run."""
    def run(start: Column) -> Column:
        pos = start["pos"]
        ahead = lambda n: F.slice(marked, pos + 1, n)
        length = F.when(F.size(F.filter(ahead(most * 2), lambda x: x["prev"] < pos)) > most, most * 2).otherwise(most * PROBE)

        def step(s: Column, x: Column) -> Column:
            new = x["prev"] < pos
            n, shared = s["n"] + new.cast("int"), s["shared"] + (new & x["hit"]).cast("int")
            dice = F.when(x["ends"], F.greatest(s["dice"], F.lit(2.0) * shared / (n + size))).otherwise(s["dice"])
            return F.struct(n.alias("n"), shared.alias("shared"), dice.alias("dice"))

        start_at = F.struct(F.lit(0).alias("n"), F.lit(0).alias("shared"), F.lit(0.0).alias("dice"))
        return F.struct(F.aggregate(ahead(length), start_at, step)["dice"].alias("dice"), (-pos).alias("from"))

    return F.array_max(F.transform(F.filter(marked, lambda x: x["begins"]), run))


def _best_backwards(marked: Column, size: Column, most: Column) -> Column:
    """From the last place to the first, with the pairs of the run that begins here, each at its first place, in order: a place's pair comes to the front, and leaves its old place. More than ``most`` are not kept. A run of the first k pairs can end wherever a sentence does before the next pair."""
    entry = "struct<pos:int,prev:int,hit:boolean,end:int>"

    def step(s: Column, x: Column) -> Column:
        end = F.when(x["ends"], x["pos"]).otherwise(s["end"])
        own = F.struct(x["pos"].alias("pos"), x["prev"].alias("prev"), x["hit"].alias("hit"), end.alias("end"))
        pairs = F.slice(F.concat(F.array(own), F.filter(s["pairs"], lambda e: e["prev"] != x["pos"])), F.lit(1), most + 1)

        def judged(t: Column, e: Column) -> Column:
            dice = F.when(t["end"] < e["pos"], F.greatest(t["dice"], F.lit(2.0) * t["shared"] / (t["n"] + size))).otherwise(t["dice"])
            return F.struct((t["n"] + 1).alias("n"), (t["shared"] + e["hit"].cast("int")).alias("shared"), e["end"].alias("end"), dice.alias("dice"))

        def best(pairs: Column) -> Column:
            last = F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(0).alias("shared"), F.lit(_NO_END).alias("end"), F.lit(0.0).alias("dice")), judged)
            return _let(last, lambda t: F.when(t["end"] < _NO_END, F.greatest(t["dice"], F.lit(2.0) * t["shared"] / (t["n"] + size))).otherwise(t["dice"]))

        def told(pairs: Column) -> Column:
            dice = F.when(x["begins"], best(pairs)).otherwise(F.lit(-1.0))
            return _let(dice, lambda d: F.struct(pairs.alias("pairs"), end.alias("end"), F.greatest(d, s["dice"]).alias("dice"), F.when(d >= s["dice"], -x["pos"]).otherwise(s["from"]).alias("from")))

        return _let(pairs, told)

    start = F.struct(F.array().cast(f"array<{entry}>").alias("pairs"), F.lit(_NO_END).alias("end"), F.lit(0.0).alias("dice"), F.lit(0).alias("from"))
    done = F.aggregate(F.reverse(marked), start, step)
    return _let(done, lambda s: F.struct(s["dice"].alias("dice"), s["from"].alias("from")))


def _runs(docs: DataFrame, rows: list[tuple[str, list[str]]], threshold: float) -> DataFrame:
    """The best run of sentences of each text for each template near one. ``docs``: doc_id and text."""
    bounds = [size_bounds(len(pairs), threshold) for _, pairs in rows]
    schema = "template int, license string, pairs array<string>, size int, least int, most int"
    known = docs.sparkSession.createDataFrame([(k, name, pairs, len(pairs), max(lo, 1), hi) for k, ((name, pairs), (lo, hi)) in enumerate(zip(rows, bounds, strict=True))], schema)

    def sentence(words: Column, line: Column) -> Column:
        return F.transform(words, lambda w, k: F.struct(w.alias("word"), line.alias("line"), (k == 0).alias("begins"), (k == F.size(words) - 1).alias("ends")))

    at = F.flatten(F.transform(F.split("text", "\n"), lambda t, i: F.flatten(F.transform(F.split(t, SENTENCE_END), lambda part: _let(words_of(part), lambda words: sentence(words, i))))))
    one = F.transform("at", lambda w: F.struct(F.when(w["begins"] & w["ends"], w["word"]).otherwise("").alias("pair"), w["begins"].alias("begins"), w["ends"].alias("ends")))
    less = lambda c: F.greatest(F.size(c) - 1, F.lit(0))
    two = F.zip_with(F.slice("at", 1, less("at")), F.slice("at", 2, less("at")), lambda a, b: F.struct(F.concat_ws(" ", a["word"], b["word"]).alias("pair"), a["begins"].alias("begins"), b["ends"].alias("ends")))
    every = sorted({p for _, pairs in rows for p in pairs})
    listed = F.zip_with(F.slice("words", 1, less("words")), F.slice("words", 2, less("words")), lambda a, b: F.concat_ws(" ", a, b))
    if any(" " not in p for p in every):
        listed = F.concat(listed, "words")
    seen = docs.select("doc_id", "text", _once(words_of(F.col("text")), "words"))
    seen = seen.select("doc_id", "text", _once(F.array_distinct(F.filter(listed, lambda p: p.isin(every))), "seen"))
    # A unit near a template shares at least as many pairs as the smallest that its size allows has.
    seen = stored(seen.where(F.size("seen") >= max(1, min(lo for lo, _ in bounds))).withColumn("row", F.monotonically_increasing_id()))
    index = known.select("template", "least", F.explode("pairs").alias("pair"))
    shared = seen.select("row", F.explode("seen").alias("pair")).join(index, "pair").groupBy("row", "template", "least").count().where("count >= least")
    # A text is cut and its pairs are put in order once, however many templates it may be near.
    met = seen.join(shared.groupBy("row").agg(F.collect_list("template").alias("templates")), "row")
    kinds = {True: two, False: one}
    used = sorted({" " in pairs[0] for _, pairs in rows if pairs})
    met = met.select("doc_id", "templates", _once(at, "at"))
    for k in used:
        met = met.select("doc_id", "templates", "at", *[f"marked_{o}" for o in used if o < k], _once(_marked(kinds[k]), f"marked_{k}"))
    met = met.withColumn("template", F.explode("templates")).drop("templates").join(F.broadcast(known), "template")
    by = F.get("pairs", F.lit(0)).contains(" ")
    marked = F.col(f"marked_{used[0]}") if len(used) == 1 else F.when(by, F.col("marked_True")).otherwise(F.col("marked_False"))
    met = met.select("doc_id", "license", "size", "most", "at", _once(_hits(marked, F.col("pairs")), "marked"))
    best = _best_run(F.col("marked"), F.col("size"), F.col("most"))
    found = met.select("doc_id", "license", "at", _once(best, "best")).where(F.col("best")["dice"] >= threshold)
    return found.select("doc_id", "license", F.col("best")["dice"].alias("dice"), F.get("at", -F.col("best")["from"])["line"].alias("place"))


def scan(df: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and licence found: ``doc_id``, ``license``, ``dice`` and ``place``. Rows with a null id are scanned like others; without templates (an empty list) nothing is found."""
    spark = df.sparkSession
    rows = [(name, template_pairs(text)) for name, text in (TEMPLATES if templates is None else templates)]
    if not rows:
        return spark.createDataFrame([], "doc_id long, license string, dice double, place int")
    sizes = [(n, i) for i, (_, pairs) in enumerate(rows) for n in range(*(lambda lo, hi: (max(lo, 1), hi + 1))(*size_bounds(len(pairs), threshold)))]
    least, most = min(n for n, _ in sizes), max(n for n, _ in sizes)
    long = StructField("template", LongType())
    by_size = spark.createDataFrame(sizes, StructType([StructField("n", LongType()), long]))
    known = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], StructType([long, StructField("license", StringType()), StructField("pairs", ArrayType(StringType()))]))

    wanted = sorted(set().union(*(keywords(pairs, threshold) for _, pairs in rows)))
    first = "".join(sorted({w[0] for w in wanted}))
    some_keyword = f"(?i)(?=[{first}])(?<![A-Za-z0-9])(?:{'|'.join(wanted)})(?![A-Za-z0-9])"
    lines = F.split("text", "\n")
    units = F.concat(F.transform(lines, lambda t, i: F.struct(i.alias("place"), t.alias("unit"))), F.when(F.size(lines) > 1, F.array(F.struct(F.lit(-1).alias("place"), F.col("text").alias("unit")))).otherwise(F.array()))
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(some_keyword))
    each = docs.select("doc_id", F.inline(units)).where(F.col("unit").rlike(some_keyword))
    found = each.select("doc_id", "place", _once(pairs_of(F.col("unit")), "own")).withColumn("n", F.size("own").cast("long")).where(F.col("n").between(least, most))
    # The two small tables have a row for each template and possible size: bounded by the templates alone.
    met = found.join(F.broadcast(by_size), "n").join(F.broadcast(known), "template")
    dice = F.lit(2.0) * F.size(F.array_intersect("own", "pairs")) / (F.col("n") + F.size("pairs"))
    best = met.select("doc_id", "license", dice.alias("dice"), "place").where(F.col("dice") >= threshold).union(_runs(docs, rows, threshold))
    return best.groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), F.max_by("place", F.struct("dice", -F.col("place"))).alias("place"))

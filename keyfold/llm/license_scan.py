"""License scans: MinHash bands over overlapping text windows, then exact shingle containment. DataFrame functions only.

Words are runs of letters and digits in lower case; shingles have five words. Templates are held against text windows of their own scale: those of ``LONG`` shingles or more against
windows of 20 shingles (24 words) at every tenth word, shorter ones against windows of two shingles at every second word. A template has a window at each of its words. A window has
``BANDS`` bands of one MinHash each, so two windows of similarity J share a band with probability 1 - (1 - J) ** BANDS:

* A long template of t shingles of which ``CONTAINED`` stand in the text has a window of similarity 0.67 on average where t is 40 or more (eight of ten shingles in each of
  two windows in step), and 0.43 at least where t is 12 (9 of its shingles in a window with 11 others): 0.999 at least.
* A shorter one has a window in step or one that shares one shingle of two at either end: 0.9998 at least for one shingle, 1 for runs of three.

A template's windows come once for each band and value. Candidates are grouped by text, template and block (the block of a template's length in which the window
begins); each group is verified once: a template is reported if ``CONTAINED`` of its distinct shingles stand, word for word, in the block, its two neighbours and a window more. The work
is linear in the lengths of text and template. Before all that, texts are left out in which no template can be: each template has words such that more than a fifth of its shingles hold
one of them, so a text without any of these words holds too few. Of the others only windows get bands that hold a shingle of some template.

Candidates join their texts by a hash of the text. Templates come in blocks of bounded size: ``BLOCK_WORDS`` words or one template.
A template of fewer than five words is one shingle by itself: its word sequence must stand in the text. Null and empty texts have no windows; rows with
equal ids count as one document (so do those without an id); of several places the first is reported; texts and templates of any length are taken whole; empty tables give no rows;
only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from keyfold.llm.store import written

SHINGLE = 5
LONG = 12
SCALES = {"short": (2, 2), "long": (20, 10)}  # shingles of a window, words between two windows
BANDS = 12
CONTAINED = 0.8
BLOCK_WORDS = 100_000  # words of templates at once

#: Notices by which texts declare their licence, standard headers, the bodies of short licences, and passages that only one long licence has (its
#: header or appendix among them). Wordings of one licence share its id. Names and versions stand where a text of a sibling falls under CONTAINED.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("All-rights-reserved", "All rights reserved."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Distributed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "terms and conditions of this Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    *(
        (f"{short}-{version}", f"under the terms of the GNU {name} as published by the Free Software Foundation, either version {version.removesuffix('.0')} of the License")
        for short, name, version in (
            ("GPL", "General Public License", "2.0"),
            ("GPL", "General Public License", "3.0"),
            ("LGPL", "Lesser General Public License", "2.1"),
            ("LGPL", "Lesser General Public License", "3.0"),
            ("AGPL", "Affero General Public License", "3.0"),
        )
    ),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    (
        "Apache-2.0",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to "
        "reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
        "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    # what all BSD licences share; the clause that only the one of three has
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("BSD-3-Clause", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
]


def words(text: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def hashes(w: Column) -> Column:
    """The hash of each shingle, in order (texts have SHINGLE words at least)."""
    return F.transform(F.sequence(F.lit(0), F.size(w) - F.lit(SHINGLE)), lambda i: F.xxhash64(*(F.get(w, i + F.lit(j)) for j in range(SHINGLE))))


def shingles(w: Column, first: Column | None = None, last: Column | None = None) -> Column:
    """Distinct shingles as strings, all or those that begin at ``first`` to ``last``; empty without SHINGLE words. (Words are got one by one: a slice in a lambda copies the whole text.)"""
    n = F.size(w) - F.lit(SHINGLE)
    lo = F.lit(0) if first is None else first
    hi = n if last is None else F.least(n, last)
    found = F.transform(F.sequence(lo, F.greatest(hi, lo)), lambda i: F.concat_ws(" ", *(F.get(w, i + F.lit(j)) for j in range(SHINGLE))))
    return F.when(hi < lo, F.array().cast("array<string>")).otherwise(F.array_distinct(found))


def starts(hashed: Column, step: int) -> Column:
    """Where windows begin."""
    return F.sequence(F.lit(0), F.greatest(F.size(hashed) - F.lit(1), F.lit(0)), F.lit(step))


def bands(window: Column) -> Column:
    """The least hash of a window's shingles under each of BANDS hash functions."""

    def band(k: int) -> Column:
        return F.array_min(F.transform(window, lambda x: F.xxhash64(x, F.lit(k))))

    return F.array(*map(band, range(BANDS)))


def banded(windows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, start, band, value of all windows (start, window: their shingles' hashes)."""
    return windows.select(*keys, "start", F.posexplode(bands(F.col("window"))).alias("band", "value"))


def cut(at: Column, size: int) -> Column:
    """A row (start, window) for each place in ``at``; cut before they are dealt out, so that no row brings along the whole text."""
    return F.explode(F.transform(at, lambda i: F.struct(i.alias("start"), F.array_compact(F.array(*(F.get("h", i + F.lit(j)) for j in range(size)))).alias("window"))))


def template_windows(own: DataFrame, size: int) -> DataFrame:
    """t, n, start, window: one from each shingle of each template on."""
    return own.select("t", "n", cut(starts(F.col("h"), 1), size).alias("x")).select("t", "n", "x.*")


def text_windows(rows: DataFrame, own: DataFrame, size: int, step: int) -> DataFrame:
    """mark, start, window: those at every ``step`` words that hold a shingle of some template; all others have similarity 0 to any window of a template."""
    known = own.select(F.explode("h").alias("x")).distinct()
    met = rows.select("mark", F.posexplode("h").alias("pos", "x")).join(F.broadcast(known), "x", "left_semi")  # a block: bounded
    last = (F.floor(F.col("pos") / step) * step).cast("int")
    met = met.select("mark", F.explode(F.array(*(last - F.lit(i * step) for i in range(size // step)))).alias("start")).where("start >= 0")
    met = met.groupBy("mark").agg(F.collect_set("start").alias("at"))  # as many as a text has windows
    return rows.join(met, "mark").select("mark", cut(F.col("at"), size).alias("x")).select("mark", "x.*")


def anchors(templates: DataFrame, contained: float) -> DataFrame:
    """Words (``word``) of which each text that holds a template has one: the longest words of each template, as many as it takes for more than
    ``1 - contained`` of its shingles to hold one of them."""
    each = templates.select("n", F.explode(F.transform(shingles(F.col("w")), lambda x: F.split(x, " "))).alias("shingle"), F.xxhash64("template_id", "w").alias("t"))
    each = each.withColumn("s", F.xxhash64("shingle"))
    # a shingle counts for the longest of its words; a template takes its longest words until enough shingles count for them
    best = each.select("t", "s", F.array_max(F.transform("shingle", lambda x: F.struct(F.length(x).alias("len"), x.alias("word")))).alias("b"))
    words_ = best.groupBy("t", "b").agg(F.count("*").alias("c"))
    order = Window.partitionBy("t").orderBy(F.desc("b"))
    words_ = words_.withColumns({"all": F.sum("c").over(Window.partitionBy("t")), "before": F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return words_.where(F.col("before") <= F.floor(F.col("all") * F.lit(1 - contained) + F.lit(1e-9))).select(F.col("b.word").alias("word")).distinct()


def blocks(templates: DataFrame) -> list[list[str]]:
    """Ids of templates in blocks of at most BLOCK_WORDS words, or one template."""
    sizes = templates.where("template_id IS NOT NULL").groupBy("template_id").agg(F.sum(F.size(words(F.col("text")))).alias("n")).orderBy("template_id")
    out, room = [], 0
    for r in sizes.toLocalIterator():
        if not out or room < r["n"]:
            out.append([])
            room = BLOCK_WORDS
        out[-1].append(r["template_id"])
        room -= r["n"]
    return out


def scan(docs: DataFrame, templates: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """doc_id, template_id, first_word, containment: a row for each document and template that it contains."""
    out = None
    for ids in blocks(templates):
        part = _scan_block(docs, templates.where(F.col("template_id").isin(ids)), contained)
        out = part if out is None else out.unionByName(part) if part is not None else out
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, template_id string, first_word long, containment double")
    return out.groupBy("doc_id", "template_id").agg(F.min("start").cast("long").alias("first_word"), F.max("containment").alias("containment"))


def _scan_block(docs: DataFrame, templates: DataFrame, contained: float) -> DataFrame | None:
    own = templates.select("template_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    own = written(own.withColumns({"t": F.xxhash64("template_id", "w"), "h": F.when(F.size("w") >= SHINGLE, hashes(F.col("w")))}), "templates").withColumn("n", F.size("h"))
    long_, short = own.where("h IS NOT NULL"), sorted(own.where("h IS NULL").select("template_id", "w").collect())  # a block: bounded
    some = {r[0] for r in anchors(long_, contained).toLocalIterator()} | {max(r["w"], key=len) for r in short}
    if not some:
        return None
    has = F.arrays_overlap("w", F.array(*map(F.lit, sorted(some))))
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), words(F.col("text")).alias("w")).where(has)
    rows = written(rows.withColumn("h", F.when(F.size("w") >= SHINGLE, hashes(F.col("w")))), "candidates")  # what is left: every later step reads it
    found = _scan_long(rows, long_, contained)
    return found.unionByName(_scan_short(rows, short)) if short else found


def _scan_short(rows: DataFrame, templates: list) -> DataFrame:
    """doc_id, template_id, start, containment of templates under SHINGLE words: their whole sequences."""
    rows = rows.select("doc_id", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("t"))
    at = [F.struct(F.lit(r["template_id"]).alias("template_id"), F.instr("t", f" {' '.join(r['w'])} ").alias("at")) for r in templates]
    rows = rows.select("doc_id", "t", F.explode(F.filter(F.array(*at), lambda x: x["at"] > 0)).alias("x"))
    before = F.substring(F.col("t"), F.lit(1), F.col("x.at") - F.lit(1))
    return rows.select("doc_id", "x.template_id", (F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))).alias("start"), F.lit(1.0).alias("containment"))


def _scan_long(rows: DataFrame, own: DataFrame, contained: float) -> DataFrame:
    """doc_id, template_id, start, containment by windows."""
    rows = rows.where(F.size("w") >= SHINGLE)
    hashed = rows.select("mark", "h")
    hit = None
    for scale, (size, step) in SCALES.items():
        of = own.where((F.col("n") >= LONG) if scale == "long" else (F.col("n") < LONG))
        theirs = banded(template_windows(of, size), ["t", "n"]).select("t", "n", "band", "value").distinct()
        mine = banded(text_windows(hashed, of, size, step), ["mark"])
        part = mine.join(F.broadcast(theirs), ["band", "value"]).select("mark", "t", "start", F.floor(F.col("start") / F.col("n")).alias("block"))  # a block: bounded
        hit = part if hit is None else hit.unionByName(part)
    hit = hit.groupBy("mark", "t", "block").agg(F.min("start").alias("start"))
    known = own.select("t", "template_id", "n", shingles(F.col("w")).alias("shingles"))
    found = rows.join(hit, "mark").join(F.broadcast(known), "t")
    begin = F.greatest((F.col("block") - F.lit(1)) * F.col("n"), F.lit(0)).cast("int")
    end = ((F.col("block") + F.lit(2)) * F.col("n")).cast("int") + F.lit(max(size for size, _ in SCALES.values()) - 1)
    share = F.size(F.array_intersect(shingles(F.col("w"), begin, end), F.col("shingles"))) / F.size("shingles")
    return found.select("doc_id", "template_id", "start", share.alias("containment")).where(F.col("containment") >= F.lit(contained))


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "template_id string, text string")

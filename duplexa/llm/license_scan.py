"""License scans: TF-IDF cosine of lines, blocks and files to templates, then inheritance along directories.

Units are compared with templates by the cosine of sparse TF-IDF vectors (inverse
document frequencies counted over all files). Single lines are compared with the
short notices of ``TEMPLATES``; blocks of consecutive lines and whole files with
those and with standard headers, titles and full licence texts (``NOTICES`` and the
folder ``license_texts``). A block for a template of n words is the fewest lines with
n words or more; blocks begin at the first line of every n/8 words that has a word of the template. A unit is labelled
by the best template at or above the threshold. Units of several lines outrank lines
within a file, by the cosine's sixth power times the logarithm of the template's words: a
long text beats a title in it, and a text its longer relatives. Otherwise the best cosine labels the file. A file whose labelled lines, alone or in a labelled unit, make up enough of
its words is a licence file of its directory. A file without a label takes that of the
nearest directory above it that has a licence file: each path is exploded to its
ancestors and joined with the licensed directories.

All of it is DataFrame operations. Lines that share no decisive word with any
template are dropped before they are exploded; decisive words are such that without
them no template can be reached, so no labelled line is lost. Likewise a file is cut to
blocks for a template only if it has enough of the template's words to reach it; equal
texts are cut once.

* Null texts count as empty; null paths have no directory, so such files neither
  give nor take an inherited label. Repeated rows are files like others.
* Ties: the higher cosine, then the alphabetically first template; the directory's
  label is the one of most licence files, then the alphabetically first. Empty
  tables give empty results. Input columns are kept unless a result or working column has
  their name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._exchange import small, written

# Short forms of public licence notices, with their SPDX names.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "Proprietary": "All rights reserved",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}
TAG = "SPDX-License-Identifier:"
#: Standard headers, titles and tags. A tag's name is stated more than once: without it the tag is no match.
NOTICES = [
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
    You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
    software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
    See the License for the specific language governing permissions and limitations under the License."""),
    *[(f"GPL-{v}.0", f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
    You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/""") for v in (2, 3)],
    *[(f"LGPL-{v}", f"""This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by
    the Free Software Foundation; either version {v} of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.
    You should have received a copy of the GNU Lesser General Public License along with this library. If not, see https://www.gnu.org/licenses/""") for v in ("2.1", "3.0")],
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
    You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Proprietary", "Copyright (c) All rights reserved"),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    *[(x, f"{TAG} {x} {x} {x}") for x in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-NC-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense")],
]
THRESHOLD = 0.75
#: Blocks begin this often within a template's length.
STARTS = 8
#: A licence file has this percentage of its words or more in labelled lines.
FILE_PERCENT = 25
SEPARATORS = "[^a-z0-9]+"
RESULT = ["license", "cosine", "n_lines", "origin", "origin_dir"]


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def _array(words: Iterable[str]) -> Column:
    """An array of words from one literal, which the optimizer folds: plans are copied again and again, and one literal a word fills the driver."""
    text = " ".join(words)
    return F.split(F.lit(text), " ") if text else F.array().cast("array<string>")


def _table(values: dict[str, float]) -> Column:
    """A map of words from two literals."""
    return F.map_from_arrays(_array(values), _array(map(repr, values.values())).cast("array<double>"))


VOCABULARY = sorted({w for t in TEMPLATES.values() for w in _words(t)})


@lru_cache(1)
def notices() -> list[tuple[str, list[str], int]]:
    """(name, words, words of a unit) of what blocks and files are compared with; the first are the short ones of TEMPLATES."""
    texts = [(p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
    size = lambda name, text: len(_words(f"{TAG} {name}" if text.startswith(TAG) else text))
    return [(name, _words(text), size(name, text)) for name, text in [*TEMPLATES.items(), *NOTICES, *texts]]


def _unit(words: list[str], idf: dict[str, float]) -> dict[str, float]:
    """The TF-IDF vector of some words, of length one."""
    x = {w: n * idf[w] for w, n in Counter(words).items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    return {w: v / norm for w, v in x.items()}


def least_words(vector: dict[str, float], threshold: float) -> int:
    """Distinct words of a template that a unit must have: fewer, though the heaviest, have a norm below the threshold."""
    total = 0.0
    for k, v in enumerate(sorted(vector.values(), reverse=True), 1):
        total += v * v
        if math.sqrt(total) >= threshold - 1e-6:
            return k
    return len(vector)


def vectors(idf: dict[str, float]) -> dict[str, dict[str, float]]:
    """Each template's TF-IDF vector, of length one."""
    return {name: _unit(_words(text), idf) for name, text in TEMPLATES.items()}


def decisive(templates: dict[str, dict[str, float]], threshold: float) -> list[str]:
    """Words of which a line must have one: the rest of a template, its lightest words, has a norm below the threshold."""
    out = set()
    for vector in templates.values():
        total = 0.0
        for w, v in sorted(vector.items(), key=lambda x: (x[1], x[0])):
            total += v * v
            if math.sqrt(total) >= threshold - 1e-6:
                out.add(w)
    return sorted(out)


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda w: w != "")


def frequencies(files: DataFrame, text_col: str) -> DataFrame:
    """(word, df) of the templates' words over all files, and the number of files as word ''."""
    known = files.sparkSession.createDataFrame([(w,) for w in sorted({w for _, words, _ in notices() for w in words} | {""})], "word string")
    own = F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), SEPARATORS)), "")
    return files.select(F.explode(F.concat(own, F.array(F.lit("")))).alias("word")).join(F.broadcast(known), "word").groupBy("word").agg(F.count("*").alias("df"))


def _tries(own: Column, weights: list[dict[str, float]], threshold: float) -> Column:
    """Numbers of the templates that some unit of a text with these distinct words can reach."""

    def may_reach(vector: dict[str, float]) -> Column:
        least, squares = least_words(vector, threshold), _table({w: v * v for w, v in vector.items()})
        common = F.array_intersect(_array(vector), own)
        total = F.aggregate(common, F.lit(0.0), lambda s, w: s + squares[w])
        return (F.size(own) >= least) & (F.size(common) >= least) & (F.sqrt(total) >= threshold - 1e-6)

    return F.array_compact(F.array(*[F.when(may_reach(v), F.lit(t)) for t, v in enumerate(weights)]))


def _cut(texts: DataFrame, vocabulary: Column) -> DataFrame:
    """The lines with words of ``texts``, each with the words before it, its words of tried templates and the number of words of no template."""
    c = F.col
    own = F.array_distinct(F.flatten(F.transform("tries", lambda t: vocabulary[t])))
    lines = texts.select("key", "alone", "tries", "known", F.array_intersect(own, "known").alias("own"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("key", "tries", "known", "own", "pos", F.array_contains("alone", c("pos")).alias("alone"), tokens(c("line")).alias("words")).where(F.size("words") > 0)
    mine = F.filter("words", lambda w: F.array_contains("own", w))
    others = F.size(F.filter("words", lambda w: ~F.array_contains("known", w)))
    before = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.select("key", "tries", "pos", "alone", "words", F.size("words").alias("n"), mine.alias("mine"), others.alias("others"))
    return lines.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))


def blocks(texts: DataFrame, weights: list[dict[str, float]], idf: dict[str, float], other: float, threshold: float) -> DataFrame:
    """(key, rank, lines) of ``texts`` (key, text, tries, alone, known) with a labelled block or a label as a whole.

    ``alone`` are lines labelled by themselves: a block with one is no wrapped short notice. Blocks begin with a line
    that has a word of the template. Of the others only the templates' words are looked at, until these can reach the
    threshold beside as many foreign words as there are; what can is compared in full.
    """
    c, spark = F.col, texts.sparkSession
    kinds = spark.createDataFrame([(t, name, size, max(1, size // STARTS), t < len(TEMPLATES)) for t, (name, _, size) in enumerate(notices())], "t int, name string, size int, step int, short boolean")
    weight = spark.createDataFrame([(t, w, v) for t, vector in enumerate(weights) for w, v in vector.items()], "t int, word string, v double")
    rare = spark.createDataFrame(list(idf.items()), "word string, idf double")
    vocabulary = F.array(*[_array(sorted(vector)) for vector in weights])
    unit = ["key", "t", "block"]
    # a block's number is that of the step in which it begins; the whole file is number -1
    low, high = F.greatest(F.lit(0), F.floor((c("first") - c("size") + 1) / c("step"))), F.floor(c("first") / c("step"))

    def parts_of(lines: DataFrame, starts: DataFrame) -> DataFrame:
        """Lines by the blocks they are in."""
        each = lines.withColumn("block", F.explode(F.concat(F.sequence(low, high), F.array(F.lit(-1).cast("long")))))
        return each.join(starts, unit).where("block = -1 or (start <= first and first < start + size)")

    tried = written(_cut(texts, vocabulary).select("key", "pos", "alone", "first", "mine", "others", F.explode("tries").alias("t")).withColumn("mine", F.filter("mine", lambda w: F.array_contains(vocabulary[c("t")], w))).where(F.size("mine") > 0), "tried")
    tried = tried.join(F.broadcast(kinds), "t")
    starts = tried.groupBy("key", "t", high.alias("block")).agg(F.min("first").alias("start"))
    starts = starts.unionByName(tried.select("key", "t").distinct().withColumns({"block": F.lit(-1).cast("long"), "start": F.lit(0).cast("long")}))
    parts = parts_of(tried, starts)
    foreign = parts.groupBy(*unit, "start").agg(F.sum("others").alias("others"), F.max(c("short") & c("alone")).alias("no")).where("not no")
    counted = parts.select(*unit, F.explode("mine").alias("word")).groupBy(*unit, "word").agg(F.count("*").alias("n"))
    weighed = counted.join(F.broadcast(rare), "word").join(F.broadcast(weight), ["t", "word"])
    weighed = weighed.groupBy(*unit).agg(F.sum(c("n") * c("idf") * c("v")).alias("dot"), F.sum(c("n") * c("idf") * c("n") * c("idf")).alias("square"))
    hope = weighed.join(foreign, unit).where(c("dot") / F.sqrt(c("square") + c("others") * (other * other)) >= threshold - 1e-5)
    hope = written(hope.select(*unit, "start"), "hope")

    lines = _cut(texts.join(small(hope.select("key").distinct()), "key", "left_semi"), vocabulary)
    lines = written(lines.select("key", "pos", "alone", "first", "n", "words"), "lines")
    parts = lines.join(small(hope), "key").join(F.broadcast(kinds), "t").where("block = -1 or (start <= first and first < start + size)")
    ranges = parts.groupBy(*unit).agg(F.min("pos").alias("from"), F.max("pos").alias("to"), F.max("alone").alias("alone"))
    counted = parts.select(*unit, F.explode("words").alias("word")).groupBy(*unit, "word").agg(F.count("*").alias("n"))
    x = c("n") * F.coalesce("idf", F.lit(other))
    compared = counted.join(F.broadcast(rare), "word", "left").join(F.broadcast(weight), ["t", "word"], "left").groupBy(*unit).agg(F.round(F.sum(x * F.coalesce("v", F.lit(0.0))) / F.sqrt(F.sum(x * x)), 6).alias("cosine"))
    found = compared.where(c("cosine") >= threshold).join(ranges, unit).join(F.broadcast(kinds), "t")
    several = c("to") > c("from")
    found = found.where(~c("short") | (several & ~c("alone")))
    rank = F.struct(F.when(several, -F.log2(c("size") + 1) * F.pow("cosine", F.lit(6.0))).otherwise(0.0).alias("matched"), (-c("cosine")).alias("less"), c("name").alias("name"))
    labels = found.groupBy("key").agg(F.min(rank).alias("rank"))
    inside = found.select("key", F.explode(F.sequence("from", "to")).alias("pos")).distinct()
    held = inside.join(lines.select("key", "pos", "n"), ["key", "pos"]).groupBy("key").agg(F.collect_list(F.struct("pos", "n")).alias("lines"))
    return labels.join(held, "key")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD, file_percent: int = FILE_PERCENT, keep_text: bool = False) -> DataFrame:
    """``files`` with license, cosine, n_lines (labelled), origin ("own", "inherited" or null) and origin_dir; the text only if asked for."""
    c = F.col
    df = {r["word"]: r["df"] for r in frequencies(files, text_col).collect()}  # at most one row a word of the templates
    total = df.get("", 0)
    idf = {w: math.log((1 + total) / (1 + df.get(w, 0))) + 1 for w in VOCABULARY}
    other = math.log(1 + total) + 1  # of a word outside the vocabulary: as rare as can be
    every = {w: math.log((1 + total) / (1 + df.get(w, 0))) + 1 for w in sorted({w for _, words, _ in notices() for w in words})}
    weights = [_unit(words, every) for _, words, _ in notices()]
    templates = vectors(idf)
    needed = _array(decisive(templates, threshold))

    def may_match(text: Column) -> Column:
        return F.arrays_overlap(F.split(F.lower(text), SEPARATORS), needed)

    keep = [x for x in files.columns if x not in [*RESULT, "__lines", "__words", "__key", "__id", "rank", "lines"] and (keep_text or x != text_col)]
    text = F.coalesce(c(text_col), F.lit(""))

    def dot(weighted: Column, weights: Column) -> Column:
        return F.aggregate(weighted, F.lit(0.0), lambda s, e: s + e["x"] * F.coalesce(weights[e["w"]], F.lit(0.0)))

    def label(line: Column) -> Column:
        words = tokens(line)
        idf_of = _table(dict(sorted(idf.items())))
        # words outside the vocabulary add to the norm only; known ones by how often they occur
        weighted = F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("w"), (F.size(F.filter(words, lambda x: x == w)) * F.coalesce(idf_of[w], F.lit(other))).alias("x")))
        norm = F.sqrt(F.aggregate(weighted, F.lit(0.0), lambda s, e: s + e["x"] * e["x"]))
        scores = [F.struct((-F.round(F.when(norm > 0, dot(weighted, _table(dict(sorted(v.items())))) / norm).otherwise(0.0), 6)).alias("less"), F.lit(name).alias("name")) for name, v in templates.items()]
        best = F.array_min(F.array(*scores))
        return F.struct((-best["less"]).alias("cosine"), best["name"].alias("name"), F.size(words).alias("n"))

    # only lines of texts that hold a decisive word are looked at one by one
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("pos")))
    labels = F.transform(F.filter(numbered, lambda x: may_match(x["line"])), lambda x: F.struct(label(x["line"]).alias("l"), x["pos"].alias("pos")))
    labels = F.transform(F.filter(labels, lambda x: x["l"]["cosine"] >= threshold), lambda x: F.struct(x["l"]["cosine"].alias("cosine"), x["l"]["name"].alias("name"), x["l"]["n"].alias("n"), x["pos"].alias("pos")))
    none = F.array().cast("array<struct<cosine:double,name:string,n:int,pos:int>>")
    known = _array(every)
    gate = _array(decisive(dict(enumerate(weights)), threshold))
    split = F.split(F.lower(text), SEPARATORS)
    known = F.when(F.arrays_overlap(split, gate), F.array_intersect(split, known)).otherwise(F.array().cast("array<string>"))
    labelled = files.select(*dict.fromkeys([*keep, text_col]), F.when(may_match(text), labels).otherwise(none).alias("__lines"), known.alias("__known"))
    labelled = labelled.withColumn("__tries", _tries(c("__known"), weights, threshold))
    tried = F.size("__tries") > 0
    n_words = F.when((F.size("__lines") > 0) | tried, F.regexp_count(F.lower(text), F.lit("[a-z0-9]+")))
    # texts are read once for all that follows; only those that may hold more than lines are kept
    read = labelled.select(*keep, "__lines", n_words.alias("__words"), F.when(tried, F.sha2(text, 256)).alias("__key"), F.when(tried, text).alias("__text"), F.when(tried, c("__tries")).alias("__tries"), F.when(tried, c("__known")).alias("__known"))
    read = written(read.withColumn("__id", F.monotonically_increasing_id()), "read")
    first = read.where("__key is not null").groupBy("__key").agg(F.min("__id").alias("__id"))  # one row of each text
    texts = read.where("__key is not null").join(small(first.select("__id")), "__id", "left_semi")
    texts = texts.select(c("__id").alias("key"), c("__text").alias("text"), c("__tries").alias("tries"), F.transform("__lines", lambda x: x["pos"]).alias("alone"), c("__known").alias("known"))
    held = ["__lines", "__words", "__key"]
    plain = read.where("__key is null").select(*keep, *held)
    if texts.limit(1).count():
        found = blocks(texts, weights, every, other, threshold).withColumnRenamed("key", "__id")
        more = written(found.join(first, "__id").drop("__id"), "blocks")
        some = read.where("__key is not null").select(*keep, *held).join(more, "__key", "left")
        plain = plain.withColumn("rank", F.lit(None).cast(more.schema["rank"].dataType)).withColumn("lines", F.lit(None).cast(more.schema["lines"].dataType)).unionByName(some)
    else:
        plain = plain.withColumn("rank", F.lit(None).cast("struct<matched:double,less:double,name:string>")).withColumn("lines", F.lit(None).cast("array<struct<pos:int,n:int>>"))
    alone = F.array_min(F.transform("__lines", lambda x: F.struct(F.lit(0.0).alias("matched"), (-x["cosine"]).alias("less"), x["name"].alias("name"))))
    own = plain.withColumn("__best", F.least(alone, "rank"))
    own = own.withColumn("__own", c("__best.name")).withColumn("cosine", -c("__best.less"))
    own = own.withColumn("__all", F.array_union(F.transform("__lines", lambda x: F.struct(x["pos"].alias("pos"), x["n"].alias("n"))), F.coalesce("lines", F.array().cast("array<struct<pos:int,n:int>>"))))
    own = own.withColumn("n_lines", F.size("__all").cast("long"))
    covered = F.aggregate("__all", F.lit(0), lambda s, x: s + x["n"])
    own = own.withColumn("__file", c("__own").isNotNull() & (100 * covered >= file_percent * c("__words")))
    own = written(own.select(*keep, "__own", "cosine", "n_lines", "__file"), "labelled")
    parts = F.slice(F.split(path_col, "/"), 1, F.greatest(F.size(F.split(path_col, "/")) - 1, F.lit(0)))
    directory = F.array_join(parts, "/")

    # licensed directories: one row each, pre-aggregated by directory and template
    votes = own.where(c("__file") & c(path_col).isNotNull()).groupBy(directory.alias("__dir"), c("__own").alias("__name")).agg(F.count("*").alias("__n"))
    licensed = votes.groupBy("__dir").agg(F.min(F.struct((-c("__n")).alias("less"), c("__name").alias("name"))).alias("__vote")).select("__dir", c("__vote.name").alias("__name"))

    # every directory of a file without a label, with its ancestors: distinct directories, not files
    homes = own.where(c("__own").isNull() & c(path_col).isNotNull()).select(directory.alias("__home")).distinct()
    depth = F.when(c("__home") == "", 0).otherwise(F.size(F.split("__home", "/")))
    ancestors = F.transform(F.sequence(F.lit(0), depth), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(F.split("__home", "/"), 1, k), "/").alias("dir")))
    up = homes.select("__home", F.explode(ancestors).alias("a")).select("__home", c("a.depth").alias("__depth"), c("a.dir").alias("__dir")).distinct()
    nearest = up.join(licensed, "__dir").groupBy("__home").agg(F.max(F.struct(c("__depth").alias("depth"), c("__dir").alias("dir"), c("__name").alias("name"))).alias("__near"))
    out = own.withColumn("__home", F.when(c("__own").isNull(), directory)).join(nearest, "__home", "left")
    inherited = c("__own").isNull() & c("__near").isNotNull()
    return out.select(
        *[c(f"`{k}`") for k in keep],
        F.coalesce("__own", c("__near.name")).alias("license"),
        c("cosine"),
        c("n_lines"),
        F.when(c("__own").isNotNull(), "own").when(inherited, "inherited").alias("origin"),
        F.when(inherited, c("__near.dir")).when(c("__own").isNotNull() & c(path_col).isNotNull(), directory).alias("origin_dir"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.concat_ws("/", "source", "lang", "doc_id").alias("path"))
    return scan(docs).select("doc_id", "license", "cosine", "n_lines", "origin", "origin_dir")


def _sql_list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


ORACLE_SQL = f"""
WITH files AS (
    SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', source, lang, doc_id::VARCHAR) AS path FROM documents
), words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS words FROM files
), vocabulary AS (
    SELECT unnest([{_sql_list(VOCABULARY)}]) AS word
), total AS (
    SELECT count(*) AS n FROM files
), df AS (
    SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(words) AS word FROM words) WHERE word IN (SELECT word FROM vocabulary) GROUP BY word
), idf AS (
    SELECT word, ln((1 + n)::DOUBLE / (1 + coalesce(df, 0))) + 1 AS idf FROM vocabulary LEFT JOIN df USING (word), total
), template AS (
    SELECT unnest([{", ".join(f"{{'name': '{k}', 'words': [{_sql_list(_words(v))}]}}" for k, v in TEMPLATES.items())}], recursive := true)
), template_word AS (
    SELECT name, word, count(*) * any_value(idf) AS x FROM (SELECT name, unnest(words) AS word FROM template) JOIN idf USING (word) GROUP BY name, word
), template_norm AS (
    SELECT name, sqrt(sum(x * x)) AS norm FROM template_word GROUP BY name
), line AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM files
), line_word AS (
    SELECT doc_id, pos, word, count(*) AS tf FROM (
        SELECT doc_id, pos, unnest(list_filter(regexp_split_to_array(lower(line), '[^a-z0-9]+'), lambda w: w <> '')) AS word FROM line
    ) GROUP BY doc_id, pos, word
), line_vector AS (
    SELECT doc_id, pos, word, tf, tf * coalesce(idf, ln(1 + n) + 1) AS x FROM line_word LEFT JOIN idf USING (word), total
), line_norm AS (
    SELECT doc_id, pos, sqrt(sum(x * x)) AS norm, sum(tf) AS n FROM line_vector GROUP BY doc_id, pos
), cosine AS (
    SELECT doc_id, pos, name, round(sum(v.x * t.x) / any_value(l.norm * m.norm), 6) AS cosine, any_value(l.n) AS n
    FROM line_vector v JOIN template_word t USING (word) JOIN line_norm l USING (doc_id, pos) JOIN template_norm m USING (name) GROUP BY doc_id, pos, name
), labelled AS (
    SELECT * FROM cosine WHERE cosine >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY cosine DESC, name) = 1
), own AS (
    SELECT doc_id, arg_min(name, (-cosine, name)) AS license, max(cosine) AS cosine, count(*) AS n_lines, sum(n) AS covered FROM labelled GROUP BY doc_id
), file AS (
    SELECT f.doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, o.license, o.cosine, coalesce(n_lines, 0) AS n_lines,
        o.license IS NOT NULL AND 100 * covered >= {FILE_PERCENT} * len(w.words) AS is_file
    FROM files f LEFT JOIN own o USING (doc_id) JOIN words w USING (doc_id)
), licensed AS (
    SELECT dir, license FROM (SELECT dir, license, count(*) AS n FROM file WHERE is_file GROUP BY dir, license) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, license) = 1
), near AS (
    SELECT home, l.dir, l.license FROM (SELECT DISTINCT dir AS home FROM file) h
    JOIN licensed l ON h.home = l.dir OR starts_with(h.home, l.dir || '/') OR l.dir = '' QUALIFY row_number() OVER (PARTITION BY home ORDER BY length(l.dir) DESC) = 1
)
SELECT doc_id, coalesce(f.license, n.license) AS license, f.cosine, n_lines,
    CASE WHEN f.license IS NOT NULL THEN 'own' WHEN n.license IS NOT NULL THEN 'inherited' END AS origin,
    CASE WHEN f.license IS NOT NULL THEN f.dir ELSE n.dir END AS origin_dir
FROM file f LEFT JOIN near n ON n.home = f.dir
"""

"""License scans, with DataFrame functions only.

Every line of a file, and the whole file, is a unit. A unit's words are weighed by TF-IDF over the templates and compared
with each template by sparse cosine; the best template of a line at THRESHOLD or more is the file's own licence (a header),
and a file that is as a whole that close to a template, or that is named like a licence file and has one, licenses its directory. A file
without its own licence inherits from the licence file of the nearest directory above it, found by joining the paths of
all its ancestors.

Only lines with a word of SIGNALS can reach the threshold, since without them no template keeps enough of its length (this is
checked on import); so only these lines, and the files that hold them, are taken apart. Templates are a constant table.

Defined results: null and empty texts, and empty files, have no own licence but may inherit; a null path inherits nothing; ties go to the
better score, then the smaller template name, and for directories to the smaller path; repeated rows get equal results; an empty
table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.6
# Short public notices of common licences.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
}
# Function words, which neither templates nor units count.
STOP = ("a", "by", "is", "of", "the", "this", "to", "under", "use")
SIGNALS = ("license", "licensed", "mit", "apache", "gnu", "lesser", "general", "public", "version", "bsd", "style", "governed", "source", "code", "mozilla", "form", "subject", "terms", "cc", "nc", "sa", "work", "released", "4")
FILE_NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
_WORD = "[a-z0-9]+"


def words_of(text: str) -> list[str]:
    return re.findall(_WORD, text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def _counted(text: str) -> list[str]:
    return [w for w in words_of(text) if w not in STOP]


def weights() -> tuple[dict[str, float], list[tuple[str, str, float]], float]:
    """IDF by word; (template, word, unit-length weight times IDF) so that a dot product with counts is what cosine needs; IDF of other words."""
    n = len(TEMPLATES)
    df = Counter(w for t in TEMPLATES.values() for w in set(_counted(t)))
    idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in df.items()}
    rows = []
    for name, text in TEMPLATES.items():
        tf = Counter(_counted(text))
        size = math.sqrt(sum((c * idf[w]) ** 2 for w, c in tf.items()))
        rows += [(name, w, c * idf[w] / size * idf[w]) for w, c in tf.items()]
    return idf, rows, math.log(1 + n) + 1


def _unsignalled() -> float:
    """The best cosine of a unit without any signal word."""
    idf, rows, _ = weights()
    return max(math.sqrt(sum((x / idf[w]) ** 2 for t, w, x in rows if t == name and w not in SIGNALS)) for name in TEMPLATES)


if _unsignalled() >= THRESHOLD:
    raise ValueError("a unit without signal words could reach the threshold")


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit_scores(units: DataFrame, keys: list[str]) -> DataFrame:
    """keys, template, score of units (keys, words array) that share a word with a template."""
    spark = units.sparkSession
    idf, rows, other = weights()
    table = F.broadcast(spark.createDataFrame(rows, "template string, word string, dot double"))
    sizes = F.broadcast(spark.createDataFrame(list(idf.items()), "word string, idf double"))
    counts = units.select(*keys, F.explode("words").alias("word")).filter(~F.col("word").isin(*STOP)).groupBy(*keys, "word").agg(F.count("*").alias("tf"))
    lengths = counts.join(sizes, "word", "left").groupBy(*keys).agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.coalesce("idf", F.lit(other)), 2))).alias("size"))
    dots = counts.join(table, "word").groupBy(*keys, "template").agg(F.sum(F.col("tf") * F.col("dot")).alias("dot"))
    return dots.join(lengths, keys).select(*keys, "template", F.round(F.col("dot") / F.col("size"), 6).alias("score"))


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """path, n_units (lines that reach the threshold), own_license, own_score, is_license_file, license, from_dir of every row."""
    signal = r"(?:^|[^a-z0-9])(?:" + "|".join(SIGNALS) + r")(?:[^a-z0-9]|$)"
    rows = common.columns(files, path=path_col, text=text_col).withColumn("row", F.xxhash64("text"))
    marked = rows.select("path", "row", lowered(F.coalesce("text", F.lit(""))).alias("low")).filter(F.col("low").rlike(signal)).filter(F.col("path").isNotNull()).dropDuplicates(["path", "row"])
    lines = marked.select("path", "row", F.posexplode(F.split("low", "\n")).alias("unit", "line")).filter(F.col("line").rlike(signal))
    units = lines.select("path", "row", "unit", F.col("line").alias("t")).unionByName(marked.select("path", "row", F.lit(-1).alias("unit"), F.col("low").alias("t")))
    scored = unit_scores(units.select("path", "row", "unit", F.regexp_extract_all("t", F.lit(f"({_WORD})")).alias("words")), ["path", "row", "unit"]).filter(F.col("score") >= threshold)
    own = scored.groupBy("path", "row").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "template")).alias("b"),
        F.count_distinct(F.when(F.col("unit") >= 0, F.col("unit"))).alias("n_units"),
        F.coalesce(F.bool_or(F.col("unit") == -1), F.lit(False)).alias("whole"),
    ).select("path", "row", "n_units", F.col("b.template").alias("own_license"), (-F.col("b.s")).alias("own_score"), "whole")
    name = F.substring_index("path", "/", -1)
    parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    owned = common.cut(own.withColumn("is_license_file", F.col("whole") | name.rlike(FILE_NAME)).drop("whole"))
    dirs = owned.filter("is_license_file").select(parent.alias("from_dir"), "own_license", "own_score", "path").groupBy("from_dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "own_license", "path")).alias("b")).select("from_dir", F.col("b.own_license").alias("dir_license"))
    # Every directory once, with all its ancestors.
    below = rows.filter(F.col("path").isNotNull()).select(parent.alias("dir")).distinct()
    steps = F.split("dir", "/")
    above = below.select("dir", F.explode(F.sequence(F.lit(1), F.size(steps))).alias("depth")).withColumn("from_dir", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/"))
    root = below.select("dir", F.lit(0).alias("depth"), F.lit("").alias("from_dir")).filter(~F.col("dir").startswith("/") & (F.col("dir") != ""))
    nearest = above.unionByName(root).join(dirs, "from_dir").groupBy("dir").agg(F.max_by(F.struct("from_dir", "dir_license"), "depth").alias("b")).select("dir", "b.from_dir", "b.dir_license")
    out = rows.select("path", "row", parent.alias("dir")).join(owned, ["path", "row"], "left").join(nearest, "dir", "left")
    return out.select(
        F.col("path").alias(path_col),
        F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"),
        "own_license",
        "own_score",
        F.coalesce("is_license_file", F.lit(False)).alias("is_license_file"),
        F.coalesce("own_license", "dir_license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("from_dir")).alias("from_dir"),
    )

"""Licence scans: TF-IDF cosine to templates, then inheritance by directory (operator 4).

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightings.session import cut

# Notices by licence; a licence may have several.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this "
     "file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in "
     "the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, "
     "are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
     "International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or "
     "neighboring rights to this work. CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms "
     "of the GNU General Public License as published by the Free Software Foundation, either version 3 "
     "of the License, or any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
     "software and associated documentation files, to deal in the Software without restriction, "
     "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
     "sublicense, and/or sell copies of the Software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If "
     "a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]

# Headers of versions and kin that differ from a notice above in a few words only.
HEADERS = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms "
     "of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 "
     "of the License, or any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
] + [
    (name, f"This {what} is free software; you can redistribute it and/or modify it under the terms of the "
     f"GNU {kind}General Public License as published by the Free Software Foundation; either version {version} "
     "of the License, or any later version.")
    for name, what, kind, version in (
        ("GPL-2.0", "program", "", "2"), ("LGPL-2.1", "program", "Lesser ", "2.1"), ("LGPL-3.0", "program", "Lesser ", "3"),
    )
]

# Words that carry no weight.
STOP_WORDS = (
    "a an and any are as at be by can for from in is it may not of on one or that the this to was "
    "with without you"
).split()

MIN_COSINE = 0.75
#: Words of all templates, as rows, that may be broadcast; more are joined by a shuffle.
BROADCAST_WORDS = 100_000
LICENCE_FILES = r"(?i)^(licen[cs]e|copying|unlicense)([.-][a-z0-9.-]*)?$"

_TOKEN = r"[\p{L}\p{N}]+"
_COMMENT = r"^\s*(//|/\*|\*|#|--|;|%|<!--)"


def _template_words(text: str) -> list[str]:
    return [w for w in re.findall(r"[^\W_]+", text.lower()) if w not in STOP_WORDS]


def vocabulary(templates=None) -> list[str]:
    return sorted({w for _, t in templates or TEMPLATES + HEADERS for w in _template_words(t)})


def document_files(docs: DataFrame, text: str = "text") -> DataFrame:
    """file_id, path, text of a file tree made of the documents of a flat table.

    Ten documents share a directory, ten directories the one above, and so on up to thousands;
    of each ten, hundred and thousand the first document is the directory's LICENSE.
    """
    d = F.col("doc_id").cast("long")
    level = [F.floor(d / n).cast("long").cast("string") for n in (1000, 100, 10)]
    name = F.when(d % 1000 == 0, F.concat_ws("/", level[0], F.lit("LICENSE")))
    name = name.when(d % 100 == 0, F.concat_ws("/", *level[:2], F.lit("LICENSE")))
    name = name.when(d % 10 == 0, F.concat_ws("/", *level, F.lit("LICENSE")))
    name = name.when(d.isNotNull(), F.concat_ws("/", *level, F.concat(d.cast("string"), F.lit(".txt"))))
    return docs.select(d.alias("file_id"), name.alias("path"), F.col(text).cast("string").alias("text"))


def _counted(files: DataFrame, vocab: list[str]) -> DataFrame:
    """row, file_id, path, units: per unit with a template word its words and how many others.

    Units are lines, blocks of several lines, and the whole file as unit -1. Blocks are the
    paragraphs, which end at lines without a letter or digit, and what of them are comment lines
    in a row, which the code below a header doesn't belong to. Marks of comments are no words.
    """

    def unit(line: Column, at: Column) -> Column:
        found = F.filter(
            F.regexp_extract_all(F.lower(line), F.lit(_TOKEN), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS)
        )
        return F.struct(at.alias("at"), F.filter(found, lambda w: w.isin(*vocab)).alias("own"), F.size(found).alias("n"))

    lines = F.split(F.coalesce("text", F.lit("")), "\n")

    def lines_if(holds) -> Column:
        """Runs of lines for which it holds."""
        kept = F.transform(lines, lambda x: F.when(holds(x), x).otherwise(F.lit("")))
        return F.split(F.array_join(kept, "\n"), "\n{2,}")

    said = lines_if(lambda x: x.rlike(_TOKEN))
    remarks = lines_if(lambda x: x.rlike(_TOKEN) & x.rlike(_COMMENT))
    several = F.filter(F.array_distinct(F.concat(said, remarks)), lambda x: F.trim(x, F.lit("\n")).contains("\n"))
    d = files.select(
        F.monotonically_increasing_id().alias("row"), "file_id", "path",
        F.transform(lines, lambda x, i: unit(x, i)).alias("units"),
        F.transform(several, lambda x, i: unit(x, -2 - i)).alias("blocks"),
    )
    whole = F.struct(
        F.lit(-1).alias("at"),
        F.flatten(F.transform("hit", lambda u: u["own"])).alias("own"),
        F.aggregate("units", F.lit(0), lambda n, u: n + u["n"]).alias("n"),
    )
    return (
        d.withColumn("hit", F.filter("units", lambda u: F.size(u["own"]) > 0))
        .withColumn("blocks", F.filter("blocks", lambda u: F.size(u["own"]) > 0))
        .withColumn("units", F.when(F.size("hit") > 0, F.concat(F.array_append("hit", whole), "blocks")))
        .drop("hit", "blocks")
    )


def own_licenses(counted: DataFrame, min_cosine: float = MIN_COSINE, templates=None) -> DataFrame:
    """row, own_license, own_cosine: the closest template of any line, block of lines or of the whole file.

    Words weigh by their inverse document frequency over all files; a word that no template has
    weighs like one in no file. Units whose template words can't reach the cosine, whatever the
    template (Cauchy-Schwarz), are left out before templates are joined, so only notices are.
    Ties go to the first licence by name.
    """
    templates = templates or TEMPLATES + HEADERS
    spark = counted.sparkSession
    files = counted.count()
    whole = counted.filter("units is not null").select("row", F.explode("units").alias("u"))
    terms = whole.filter("u.at = -1").select(F.explode(F.array_distinct("u.own")).alias("word"))
    df = {r[0]: r[1] for r in terms.groupBy("word").count().collect()}  # a row per template word
    table = [(t, name, w, _template_words(text).count(w)) for t, (name, text) in enumerate(templates) for w in sorted(set(_template_words(text)))]
    def small(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if len(table) <= BROADCAST_WORDS else rows

    words = spark.createDataFrame([(w, df.get(w, 0)) for w in vocabulary(templates)], "word string, df long")
    weight = F.log(F.lit(1.0 + files) / (1.0 + F.col("df"))) + 1.0
    words = words.select("word", weight.alias("idf"))
    most = F.log(F.lit(1.0 + files)) + 1.0
    units = whole.select("row", "u.at", "u.own", (F.col("u.n") - F.size("u.own")).alias("others"))
    # As if all its template words were one, of the greatest weight.
    n = F.size("own").cast("double")
    units = units.filter(n * n >= min_cosine**2 * (n * n + F.col("others")))
    tf = units.select("row", "at", "others", F.explode("own").alias("word")).groupBy("row", "at", "others", "word")
    tf = tf.count().join(small(words), "word")
    tf = tf.withColumn("weight", F.col("count") * F.col("idf")).select("row", "at", "others", "word", "weight")
    t = spark.createDataFrame(table, "template int, name string, word string, n int").join(words, "word")
    t = t.withColumn("weight", F.col("n") * F.col("idf"))
    length = t.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    t = t.join(length, "template").select("template", "name", "word", (F.col("weight") / F.col("length")).alias("unit"))
    norm = tf.groupBy("row", "at").agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight")) + F.max("others") * most * most).alias("norm")
    )
    dot = tf.join(small(t), "word").groupBy("row", "at", "template", "name").agg(
        F.sum(F.col("weight") * F.col("unit")).alias("dot")
    )
    cosine = dot.join(norm, ["row", "at"]).select("row", "name", (F.col("dot") / F.col("norm")).alias("cosine"))
    best = F.min(F.struct((-F.round("cosine", 9)).alias("c"), F.col("name"))).alias("best")
    return (
        cosine.filter(F.round("cosine", 9) >= min_cosine)
        .groupBy("row")
        .agg(best)
        .select("row", F.col("best.name").alias("own_license"), (-F.col("best.c")).alias("own_cosine"))
    )


def license_scan(files: DataFrame, min_cosine: float = MIN_COSINE, templates=None) -> DataFrame:
    """One row per file (file_id, path, text): its licence, its own or inherited.

    Columns: file_id, path, own_license and own_cosine (null without a notice), license, and
    from_path, the file that it comes from. A file without a notice takes the licence of the
    nearest directory above it (its own first) that holds a licence file with one; of several in
    a directory the closest, then the first by path. Directories are joined by path: a file has
    a row per directory above it, a directory one row, however many files lie below.
    Null text has no notice, a null path no directory; rows that repeat are scanned one by one, an
    empty table gives no rows, and other columns are left aside.
    """
    counted = cut(_counted(files, vocabulary(templates)))
    own = cut(own_licenses(counted, min_cosine, templates))
    d = counted.select("row", "file_id", "path").join(own, "row", "left")
    parts = F.split("path", "/")
    named = d.filter("own_license is not null and path is not null").select(
        F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("dir"),
        F.element_at(parts, -1).alias("name"), "path", "own_license", "own_cosine",
    )
    first = F.min(F.struct((-F.col("own_cosine")).alias("c"), "path", "own_license")).alias("first")
    dirs = named.filter(F.col("name").rlike(LICENCE_FILES)).groupBy("dir").agg(first)
    dirs = cut(dirs.select("dir", F.col("first.path").alias("from_path"), F.col("first.own_license").alias("license")))
    # The top folder is above all files: its one row is a value, and no key where all meet.
    top = dirs.filter("dir = ''").first()
    bare = d.filter("own_license is null and path is not null and contains(path, '/')")
    above = bare.select("row", parts.alias("parts")).select(
        "row", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("depth")
    ).select("row", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("dir"))
    nearest = F.max(F.struct("depth", "license", "from_path")).alias("near")
    given = above.join(dirs, "dir").groupBy("row").agg(nearest)
    given = given.select("row", F.col("near.license").alias("_license"), F.col("near.from_path").alias("_from"))
    below = F.col("path").isNotNull()
    license_, from_ = (F.when(below, F.lit(top[c] if top else None).cast("string")) for c in ("license", "from_path"))
    return d.join(given, "row", "left").select(
        "file_id", "path", "own_license", "own_cosine",
        F.coalesce("own_license", "_license", license_).alias("license"),
        F.when(F.col("own_license").isNotNull(), F.col("path")).otherwise(F.coalesce("_from", from_)).alias("from_path"),
    )

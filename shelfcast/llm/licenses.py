"""License scans: TF-IDF cosine to templates, then nearest-ancestor inheritance, in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import stage

COSINE = 0.6
# Words of which a stretch of lines needs one to be held against the notices.
CUES = (
    "license", "licence", "licensed", "licenses", "copyright", "spdx", "warranty", "permission", "redistribution", "redistribute",
    "unencumbered",
)
# Stretches around a line with such a word: lines before it, lines in all.
STRETCHES = ((0, 1), (0, 2), (1, 2), (0, 3), (1, 3), (0, 4), (1, 4), (1, 5))
# Opening words, titles and short texts of public licences.
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GNU_TITLE = "GNU {} GENERAL PUBLIC LICENSE Version {}"
_GNU_SHORT = "This work is licensed under the GNU {} General Public License, version {}."
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
_NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", _APACHE,
        _APACHE + " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License Version 2.0, January 2004",
    ),
    "MIT": ("Released under the MIT License.", "The MIT License (MIT)", _MIT.split(" and associated")[0] + ".", _MIT, _MIT + " " + _AS_IS),
    "ISC": ("ISC License", _ISC.split(", and/or")[0], _ISC),
    "GPL-2.0": (_GNU_SHORT.format("", 2), _GNU.format("", 2), _GNU_TITLE.format("", "2, June 1991"), _GNU_TITLE.format("", 2)),
    "GPL-3.0": (_GNU_SHORT.format("", 3), _GNU.format("", 3), _GNU_TITLE.format("", "3, 29 June 2007"), _GNU_TITLE.format("", 3)),
    "LGPL-2.1": (_GNU_SHORT.format("Lesser", 2.1), _GNU.format("Lesser", 2.1), _GNU_TITLE.format("LESSER", "2.1, February 1999")),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        _GNU_SHORT.format("Lesser", 3), _GNU.format("Lesser", 3), _GNU_TITLE.format("LESSER", "3, 29 June 2007"),
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        _GNU_SHORT.format("Affero", 3), _GNU.format("Affero", 3), _GNU_TITLE.format("AFFERO", "3, 19 November 2007"),
    ),
    "MPL-2.0": (
        _MPL, "Mozilla Public License Version 2.0",
        _MPL + " If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "BSD-2-Clause": ("BSD 2-Clause License", _BSD, _BSD + " " + _BSD_AS_IS),
    "BSD-3-Clause": (
        "BSD 3-Clause License", _BSD.split(" provided")[0] + ".", _BSD + " " + _BSD_NAME, _BSD + " " + _BSD_NAME + " " + _BSD_AS_IS,
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International License"),
}
_SPDX = "SPDX-License-Identifier: {}"
_GNU_IDS = {x: (x, f"{x}-only", f"{x}-or-later") for x in _NOTICES if "GPL" in x}
TEMPLATES = {x: (*notices, *(_SPDX.format(i) for i in _GNU_IDS.get(x, (x,)))) for x, notices in _NOTICES.items()}
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"


def terms(text: Column) -> Column:
    """Words of letters, digits, dots inside, in lower case; version numbers stay whole."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9.]+|\.+(?![a-z0-9])", -1), lambda w: w != "")


def template_table(df: DataFrame, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    """(license, notice, term, idf, weight): unit TF-IDF vectors of the notices, with the idf of each term."""
    notices = [(x, i, text) for x, texts in templates.items() for i, text in enumerate(texts)]
    rows = df.sparkSession.createDataFrame(notices, "license string, notice int, text string")
    key = ["license", "notice"]
    tf = rows.select(*key, F.explode(terms(F.col("text"))).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    df_ = tf.groupBy("term").agg(F.count("license").alias("df"))
    tf = tf.join(df_, "term").withColumn("idf", F.log(F.lit(1.0 + len(notices)) / F.col("df")))
    norm = tf.groupBy(*key).agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("norm"))
    return tf.join(norm, key).select(*key, "term", "idf", (F.col("tf") * F.col("idf") / F.col("norm")).alias("weight"))


def matches(texts: DataFrame, keys: list[str], templates: dict[str, tuple[str, ...]]) -> DataFrame:
    """keys, license, cosine: the licence with the best notice for each (keys, text)."""
    table = stage(template_table(texts, templates), "templates")
    idf = table.select("term", "idf").distinct()
    unknown = F.log(F.lit(1.0 + sum(map(len, templates.values()))))
    tf = texts.select(*keys, F.explode(terms(F.col("text"))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    # the templates, and so their terms, are a fixed list
    tf = tf.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", unknown))
    norm = tf.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = tf.join(F.broadcast(table.select("license", "notice", "term", "weight")), "term").groupBy(*keys, "license", "notice").agg(
        F.sum(F.col("w") * F.col("weight")).alias("dot")
    )
    scored = dots.join(norm, keys).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9))
    best = scored.groupBy(*keys).agg(F.max(F.struct("cosine", F.col("license").alias("license"))).alias("best"))
    return best.select(*keys, "best.license", "best.cosine")


def units(files: DataFrame) -> DataFrame:
    """(path, unit, text): the stretches of each text that may be a notice.

    Each line with a cue word alone and with up to three lines around it, the leading
    block up to the first blank line, and the whole text of a licence file.
    """
    cue = "(?i)\\b(" + "|".join(CUES) + ")\\b"
    held = files.select("path", "text").where(F.col("path").isNotNull() & F.col("text").rlike(cue)).distinct()
    lines = held.select("path", "text", F.split("text", "\n", -1).alias("lines"))

    def around(at: Column) -> Column:
        cut = [F.slice("lines", F.greatest(at - before, F.lit(0)) + 1, F.least(at, F.lit(before)) + (n - before)) for before, n in STRETCHES]
        return F.array(*[F.array_join(c, "\n") for c in cut])

    at = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("lines", i).rlike(cue))
    block = F.split(F.ltrim(F.regexp_replace("text", "\r", "")), r"\n[ \t]*\n", 2)[0]
    whole = F.when(F.col("path").rlike(LICENSE_FILE), F.array("text")).otherwise(F.array().cast("array<string>"))
    opening = F.when(block.rlike(cue), F.array(block)).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(F.flatten(F.transform(at, around)), opening, whole))
    return lines.select("path", F.posexplode(every).alias("unit", "text"))


def scan(files: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, cosine: float = COSINE) -> DataFrame:
    """(path, license, cosine, origin, from_path): the licence of every row of files (path, text, ...).

    The stretches of ``units`` are held against every notice of every licence; a file
    whose name says so is a licence file, which is also compared whole. Terms that no
    notice has count in the length of a text. origin: "header" or "file"
    for a match of at least ``cosine`` in the file itself (the best; of equals the
    last by name), "inherited" from the licence file in the nearest directory above,
    else "none" with nulls. Several licence files of one directory: the best match.
    Null, empty texts match nothing; a null path inherits nothing. Repeated rows get
    equal answers.
    """
    templates = TEMPLATES if templates is None else templates
    found = stage(matches(units(files), ["path", "unit"], templates), "licenses").where(F.col("cosine") >= cosine)
    own = found.groupBy("path").agg(F.max(F.struct("cosine", "license")).alias("own"))
    above = own.where(F.col("path").rlike(LICENSE_FILE)).select(
        F.regexp_replace("path", "[^/]*$", "").alias("folder"), "own", F.col("path").alias("from_path")
    )
    above = above.groupBy("folder").agg(F.max(F.struct("own", "from_path")).alias("above"))
    paths = files.select("path").where("path is not null").distinct()
    parts = F.split(F.regexp_replace("path", "[^/]*$", ""), "/", -1)
    depth = F.sequence(F.lit(0), F.size(parts) - 1)
    folders = F.transform(depth, lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))
    # each file once per folder over it
    over = paths.select("path", F.posexplode(folders).alias("depth", "folder")).join(above, "folder")
    nearest = over.groupBy("path").agg(F.max(F.struct("depth", "above")).alias("nearest"))
    file = F.col("path").rlike(LICENSE_FILE)
    out = files.select("path").join(own, "path", "left").join(nearest, "path", "left")
    inherited = F.col("nearest.above.own")
    return out.select(
        "path",
        F.coalesce("own.license", inherited.getField("license")).alias("license"),
        F.coalesce("own.cosine", inherited.getField("cosine")).alias("cosine"),
        F.when(F.col("own").isNotNull(), F.when(file, "file").otherwise("header"))
        .when(F.col("nearest").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("own").isNotNull(), F.col("path")).otherwise(F.col("nearest.above.from_path")).alias("from_path"),
    )

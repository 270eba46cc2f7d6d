"""License scan: TF-IDF cosine of notices to templates, then inheritance from the nearest directory above.

A notice is a line, a sentence over line ends, or a window of terms around a word of licensing; short texts and licence
files are also compared whole. Its terms are weighed by frequency and by how rare they are among the
templates, and compared with each template's vector; the best one above the threshold is the file's license. A file
that is mostly such a notice, or has the name of a licence file, speaks for its directory; a file without a notice of
its own takes the license of the nearest directory above that has one. Everything is DataFrame expressions.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored

#: Tags by which SPDX names each license.
SPDX = {name: (name,) for name in ("MIT", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "Unlicense")}
SPDX |= {name: (name, f"{name}-only", f"{name}-or-later") for name in ("GPL-3.0", "GPL-2.0", "LGPL-3.0", "AGPL-3.0")}
_AS_IS_MIT = "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_AS_IS_BSD = "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."
#: Short notices of public licenses, titles and opening texts of licence files, and SPDX tags.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Licensed under the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 license."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS_MIT),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("BSD-2-Clause", _BSD + _AS_IS_BSD),
    ("BSD-3-Clause", _BSD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS_BSD),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    *((name, f"SPDX-License-Identifier: {tag}") for name, tags in SPDX.items() for tag in tags),
)
#: Possessive, so that a long dotted run takes no stack.
TERM = r"[a-z0-9]++(?:[.-][a-z0-9]++)*+"
CUE = r"(?i)licen[cs]e|copyright|public domain|permission is hereby granted|redistribut"
#: Terms around which windows are laid: (length, how far before the term it begins). Texts up to SHORT terms are compared whole.
CUE_TERM = r"^(?:licen[cs]e[ds]?|licensing|copyright|permission|redistribut\w*|domain)$"
WINDOWS = tuple((9, k) for k in (0, 2, 3, 4, 6)) + tuple((20, k) for k in (0, 5, 10, 15)) + tuple((36, k) for k in (0, 9, 18, 27))
SHORT = 400
#: Names of files that hold a license for their directory.
FILE_NAME = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense)(?:[.-][a-z0-9.-]*+)?$"


def vectors() -> tuple[dict[str, list[float]], dict[str, float], float]:
    """For each term its weight in each template's unit vector; each term's rarity; that of any other term."""
    counts = [Counter(re.findall(TERM, text.lower())) for _, text in TEMPLATES]
    n = len(TEMPLATES)
    rarity = {t: math.log((1 + n) / (1 + sum(t in c for c in counts))) + 1 for t in sorted(set().union(*counts))}
    norms = [math.sqrt(sum((k * rarity[t]) ** 2 for t, k in c.items())) for c in counts]
    return {t: [c[t] * rarity[t] / norm for c, norm in zip(counts, norms)] for t in rarity}, rarity, math.log(1 + n) + 1


def template_terms(df: DataFrame) -> DataFrame:
    """(term, rarity, weights) as literals: a table of the templates' few terms."""
    weights, rarity, _ = vectors()
    rows = [F.struct(F.lit(t).alias("term"), F.lit(rarity[t]).alias("rarity"), F.array(*[F.lit(w) for w in weights[t]]).alias("weights")) for t in weights]
    return df.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def notices(files: DataFrame, threshold: float) -> DataFrame:
    """(path, copy, license, score, line, share): the best notice of each file that has one.

    share: the part of the file's terms that stand in lines with notices; all of a text that is a template's.
    """
    found = lambda text: F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    some = files.filter(F.col("text").rlike(CUE)).select("path", "copy", "text", found(F.col("text")).alias("all")).withColumn("all_terms", F.size("all"))
    # Kinds: 0 a line, 1 a sentence, 2 a window, 3 the whole text; each part is the terms of one candidate.
    told = lambda pattern, text: F.transform(F.filter(F.split(text, pattern), lambda x: x.rlike(CUE)), found)
    at = F.filter(F.transform("all", lambda t, i: F.when(t.rlike(CUE_TERM), i)), lambda i: i.isNotNull())
    places = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(*[F.struct(F.greatest(i - back, F.lit(0)).alias("start"), F.lit(n).alias("n")) for n, back in WINDOWS]))))
    whole = F.when(F.col("path").rlike(FILE_NAME) | (F.col("all_terms") <= SHORT), F.array("all")).otherwise(F.expr("CAST(array() AS array<array<string>>)"))
    some = some.withColumn("places", places)
    kinds = (told("\n", F.col("text")), told(r"[.!?;:](?=\s|$)|\n\s*\n", F.col("text")), F.transform("places", lambda w: F.slice(F.col("all"), w["start"] + 1, w["n"])), whole)
    tagged = lambda x, k: F.transform(x, lambda terms: F.struct(F.lit(k).alias("kind"), terms.alias("terms")))
    parts = F.concat(*[tagged(F.array_distinct(x) if k else x, k) for k, x in enumerate(kinds)])
    some = some.select("path", "copy", "all_terms", F.posexplode(parts).alias("line", "part")).select("path", "copy", "all_terms", "line", "part.kind", "part.terms")
    each = some.select("path", "copy", "all_terms", "line", "kind", F.size("terms").alias("own_terms"), F.explode("terms").alias("term"))
    counted = each.groupBy("path", "copy", "line", "term").agg(F.count("*").alias("k"), F.first("all_terms").alias("all_terms"), F.first("own_terms").alias("own_terms"), F.first("kind").alias("kind"))
    weighed = counted.join(F.broadcast(template_terms(files)), "term", "left")
    weight = F.col("k") * F.coalesce("rarity", F.lit(vectors()[2]))
    dots = [F.coalesce(F.sum(weight * F.get(F.col("weights"), F.lit(i))), F.lit(0.0)).alias(f"d{i}") for i in range(len(TEMPLATES))]
    # Copies of a row double every count of theirs alike, which no cosine shows.
    lines = weighed.groupBy("path", "copy", "line").agg(F.sqrt(F.sum(weight * weight)).alias("norm"), F.first("all_terms").alias("all_terms"), F.first("own_terms").alias("own_terms"), F.first("kind").alias("kind"), *dots)
    best = F.greatest(*[F.struct(F.round(F.col(f"d{i}") / F.col("norm"), 6).alias("score"), F.lit(-i).alias("i"), F.lit(name).alias("license")) for i, (name, _) in enumerate(TEMPLATES)])
    scored = lines.withColumn("best", best).filter(F.col("best.score") >= threshold)
    top = F.max(F.struct(F.col("best.score").alias("score"), (-F.col("line")).alias("line"), F.col("best.license").alias("license")))
    # Sentences and windows reach into the prose around a notice and say nothing of its length; a whole text counts only if it is a template's.
    spoken = [F.sum(F.when(own, F.col("own_terms"))) for own in (F.col("kind") == 0, (F.col("kind") == 3) & (F.col("best.score") >= 0.9))]
    per = scored.groupBy("path", "copy").agg(top.alias("top"), (F.coalesce(F.greatest(*spoken), F.lit(0)) / F.greatest(F.first("all_terms"), F.lit(1))).alias("share"))
    return per.select("path", "copy", F.col("top.license").alias("license"), F.col("top.score").alias("score"), (-F.col("top.line")).alias("line"), F.round("share", 6).alias("share"))


def folders(path: Column) -> Column:
    """The directories above a path, nearest first, the root ('') last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), "/"))


def scan_licenses(files: DataFrame, path_col: str, text_col: str, threshold: float = 0.6, file_share: float = 0.5) -> DataFrame:
    """One row for each row of ``files``: path, license, score, origin and from_path.

    origin: ``file`` (a licence file), ``header`` (a notice of its own), ``inherited`` (from ``from_path``, a licence
    file in the nearest directory above that has any; of several there the best score, then the first path) or
    ``none``. Null paths or texts have no notice and inherit nothing; repeated rows each get their row; other columns
    are ignored.
    """
    rows = files.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("copy", F.xxhash64("text"))
    own = stored(notices(rows.filter(F.col("path").isNotNull()), threshold).withColumn("is_file", F.col("path").rlike(FILE_NAME) | (F.col("share") >= file_share)))
    speaking = own.filter("is_file").select(F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), "license", "score", "path")
    heads = speaking.groupBy("folder").agg(F.max(F.struct("score", "license")).alias("best")).join(speaking.withColumnRenamed("folder", "_f"), F.col("folder") == F.col("_f")).filter((F.col("best.score") == F.col("score")) & (F.col("best.license") == F.col("license")))
    heads = stored(heads.groupBy("folder").agg(F.first("license").alias("head_license"), F.first("score").alias("head_score"), F.min("path").alias("head_path")))
    mine = own.select(F.col("path").alias("_p"), F.col("copy").alias("_c"), "license", "score", "is_file")
    all_rows = rows.select("path", "copy").join(mine, (F.col("path") == F.col("_p")) & (F.col("copy") == F.col("_c")), "left").drop("_p", "_c")
    # Each distinct directory is looked up once, however many files it holds.
    bare = all_rows.filter(F.col("license").isNull()).select(F.regexp_replace("path", "/?[^/]*$", "").alias("at")).filter(F.col("at").isNotNull()).distinct()
    up = bare.select("at", F.posexplode(F.concat(F.array("at"), F.when(F.col("at") != "", folders(F.col("at"))).otherwise(F.array().cast("array<string>")))).alias("steps", "folder"))
    near = up.join(small(heads), "folder").groupBy("at").agg(F.min(F.struct("steps", "head_license", "head_score", "head_path")).alias("near"))
    out = all_rows.withColumn("at", F.when(F.col("license").isNull(), F.regexp_replace("path", "/?[^/]*$", ""))).join(small(stored(near)).withColumnRenamed("at", "_at"), F.col("at") == F.col("_at"), "left")
    origin = F.when(F.col("is_file"), "file").when(F.col("license").isNotNull(), "header").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return out.select(F.col("path").alias(path_col), F.coalesce("license", "near.head_license").alias("license"), F.coalesce("score", "near.head_score").alias("score"), origin.alias("origin"), F.col("near.head_path").alias("from_path"))

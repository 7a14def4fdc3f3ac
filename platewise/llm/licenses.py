"""Licences of files by text similarity and by directory, from DataFrame operations only.

A file's header lines that mention a licence, and the whole text of a licence file, are compared with templates by the
cosine of sparse TF-IDF vectors; every distinct line is scored once, however many files hold it. Headers run over
several lines: windows of consecutive lines around a mention are compared with the usual headers and titles, licence
files as a whole with full texts, and SPDX identifiers are read as they are. A file without a licence of its own
inherits that of the licence file in the nearest directory above it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import landed, salted_join

#: Name and text of the templates: usual notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Headers and titles, compared with windows of lines; the long licences are known by their titles and notices.
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation, {} of the License, or (at your option) any later version."
HEADERS = (
    ("AGPL-3.0", _GNU.format("Affero General Public", "either version 3")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("GPL-2.0", _GNU.format("General Public", "either version 2")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", _GNU.format("General Public", "either version 3")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "ISC License"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", _GNU.format("Lesser General Public", "either version 3")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Full texts, compared with licence files as a whole.
TEXTS = (
    ("BSD-2-Clause", _BSD.format("")),
    ("BSD-3-Clause", _BSD.format("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n")),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org"""),
)
#: Names of licence files, in any case, with any ending.
LICENSE_FILES = r"(?i)^(?:licen[sc]e|copying|notice|unlicense)(?:[._-].*)?$"
MENTION = r"(?i)licen[sc]e|copyright|redistribut|permission is hereby|spdx"
#: What else a header or a full text has.
MORE = MENTION + r"|free software|unencumbered|permission to use|creative commons|cc0"
#: License names keep neither -only nor -or-later.
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.-]+?)(?:-only|-or-later|\+)?(?![A-Za-z0-9.+-])"
#: Lines of a window before and from a line with a mention on.
BEFORE, AHEAD = 2, 7
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
LEAST_COSINE = 0.7


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def is_license_file(path: Column) -> Column:
    return F.coalesce(base_name(path).rlike(LICENSE_FILES), F.lit(False))


def directory(path: Column) -> Column:
    """The path without its last part; empty at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def vectors(texts: DataFrame, key: str, text: str, idf: DataFrame, unseen: float) -> DataFrame:
    """key, term and weight: term counts times idf, of unit length."""
    terms = texts.select(key, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TERM), F.lit(0))).alias("term"))
    counts = terms.groupBy(key, "term").agg(F.count("*").alias("tf"))
    raw = counts.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def score(units: DataFrame, templates: tuple[tuple[str, str], ...], least: float) -> DataFrame:
    """unit (md5), license and score of the distinct units (unit, line) that resemble a template. idf and template
    vectors are as large as the templates, which the caller passes as a list, and are broadcast."""
    spark = units.sparkSession
    t = spark.createDataFrame([(i, n, x) for i, (n, x) in enumerate(templates)], "t int, license string, text string")
    seen = t.select("t", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    idf = seen.groupBy("term").agg((F.log((1.0 + len(templates)) / (1.0 + F.count("*"))) + 1).alias("idf"))
    unseen = math.log(1.0 + len(templates)) + 1
    known = vectors(t, "t", "text", idf, unseen).withColumnRenamed("weight", "tw").join(t.select("t", "license"), "t")
    cosine = vectors(units, "unit", "line", idf, unseen).join(F.broadcast(known), "term").groupBy("unit", "t", "license").agg(F.round(F.sum(F.col("weight") * F.col("tw")), 6).alias("score"))
    best = cosine.filter(F.col("score") >= least).groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select("unit", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def scan_licenses(files: DataFrame, *, path: str = "path", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """path, own (licence found in the file), score, license (own or inherited), origin and directory (whence).

    origin is own, inherited or none. Of several licences in a file the most similar counts, then the one that sorts
    first. Null and empty texts have none of their own. Rows that share a path are one file and give one row; a null
    path is a path that inherits nothing. A very long text is split into lines once and takes time in proportion to them;
    a line that mentions a licence makes 21 windows of up to nine lines.
    Other columns don't matter; an empty frame stays empty.
    """
    files = files.select(F.col(path).alias("path"), F.col(text).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(MENTION))
    whole = F.when(is_license_file(F.col("path")), F.array("text")).otherwise(F.array().cast("array<string>"))
    held = files.filter(F.col("text").rlike(MENTION)).select("path", F.explode(F.array_distinct(F.concat(lines, whole))).alias("line"))
    held = landed(held.withColumn("unit", F.md5(F.col("line").cast("binary"))), "licence-lines")
    scored = score(held.groupBy("unit").agg(F.first("line").alias("line")), templates, least)
    single = salted_join(held.select("path", "unit"), scored, ["unit"], "path").select("path", "license", "score")
    noted = files.filter(F.col("text").rlike(MORE))
    # A mention takes the few lines around it along, so a text is split once and a window costs its own lines.
    split = noted.select("path", F.split("text", "\n").alias("every"))
    around = F.transform("every", lambda x, i: F.when(x.rlike(MORE), F.struct(F.least(i + 1, F.lit(BEFORE + 1)).alias("at"), F.slice("every", F.greatest(i + 1 - BEFORE, F.lit(1)), 2 * BEFORE + AHEAD).alias("lines"))))
    near = split.select("path", F.explode(F.array_compact(around)).alias("m")).select("path", "m.*")
    spans = F.array(*(F.array_join(F.slice("lines", F.greatest(F.col("at") - x, F.lit(1)), n), " ") for x in range(BEFORE + 1) for n in range(x + 1, x + AHEAD + 1)))
    windows, wholes = near.select("path", F.explode(F.array_distinct(spans)).alias("line")), noted.filter(is_license_file(F.col("path"))).select("path", F.col("text").alias("line"))
    for units, known in ((windows, HEADERS), (wholes, TEXTS)):
        units = landed(units.withColumn("unit", F.md5(F.col("line").cast("binary"))), "licence-windows")
        more = score(units.groupBy("unit").agg(F.first("line").alias("line")), known, least)
        single = single.unionByName(salted_join(units.select("path", "unit"), more, ["unit"], "path").select("path", "license", "score"))
    tags = noted.select("path", F.explode(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1))).alias("license"), F.lit(1.0).alias("score"))
    own = single.unionByName(tags).groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    paths = files.select("path").distinct()
    own = paths.join(own.select(F.col("path").alias("p"), F.col("b.license").alias("own"), (-F.col("b.s")).alias("score")), F.col("path").eqNullSafe(F.col("p")), "left").drop("p")
    own = landed(own.withColumn("dir", directory(F.col("path"))), "licences")
    given = own.filter(F.col("own").isNotNull() & is_license_file(F.col("path"))).groupBy(F.col("dir").alias("above")).agg(F.min(F.struct((-F.col("score")).alias("s"), "own")).alias("g"))
    # Every directory finds the nearest one above (or itself) that gives a licence.
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    dirs = own.filter(F.col("own").isNull() & F.col("dir").isNotNull()).select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("above"))
    nearest = salted_join(dirs, given, ["above"], "dir").groupBy("dir").agg(F.max_by(F.struct("above", F.col("g.own").alias("license")), F.length("above")).alias("n"))
    out = salted_join(own, nearest, ["dir"], "path", "left")
    license_ = F.coalesce("own", F.col("n.license"))
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("n").isNotNull(), "inherited").otherwise("none")
    return out.select("path", "own", "score", license_.alias("license"), origin.alias("origin"), F.when(origin == "inherited", F.col("n.above")).alias("directory"))

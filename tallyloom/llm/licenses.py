"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

DataFrame operations only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.storage import materialise

#: Licence identifiers with sentences by which their notices are known.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("all-rights-reserved", "All rights reserved."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
]
#: A line is looked at if it holds one of these.
CUES = r"licen[cs]e|rights reserved|public domain|permission|redistribut|\bcc0\b|spdx"
#: Names of licence files; their whole text is looked at as well.
FILES = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.-][^/]*)?$"
THRESHOLD = 0.7
#: A word in more than one line of so many is common.
COMMON = 100
#: A text of which so large a share of words stands in matched lines is a licence file under any name.
WHOLE = 0.8
#: Lines of a paragraph that are joined and compared, at every quarter of that length.
WINDOWS = (2, 3, 4, 6, 8, 12, 16, 24)
#: A text of no more words than these is compared as a whole: twice the longest template.
WHOLE_WORDS = 2 * max(len(text.split()) for _, text in TEMPLATES)
#: Identifiers that a file states itself.
SPDX = r"(?i)spdx-license-identifier:[\t (]*([a-z0-9][a-z0-9.+-]*)"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _windows(text: Column) -> Column:
    """Paragraphs of two lines or more and overlapping windows of their lines, normal, those with a cue."""
    flat = F.array_join(F.transform(F.split(text, r"\R", -1), _normal), "\n")
    blocks = F.filter(F.split(flat, r"\n\n+", -1), lambda b: b.rlike(CUES) & F.contains(b, F.lit("\n")))

    def own(block: Column) -> Column:
        lines = F.split(F.trim(block, F.lit("\n")), "\n", -1)
        n = F.size(lines)
        some = [F.when(n > k, F.transform(F.sequence(F.lit(1), n - k + 1, F.lit(max(1, k // 4))), lambda i, k=k: F.array_join(F.slice(lines, i, k), " "))).otherwise(F.array().cast("array<string>")) for k in WINDOWS]
        return F.concat(F.array(F.array_join(lines, " ")), *some)

    return F.array_distinct(F.filter(F.flatten(F.transform(blocks, own)), lambda w: w.rlike(CUES)))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", carry: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """Licence of every file: its own, else that of the nearest directory above it with a licence file.

    All lines with a cue, paragraphs and windows of lines that hold one, licence files, and short texts
    as a whole are compared with ``TEMPLATES`` by the cosine of their words' TF-IDF weights; document
    frequencies count the different lines and licence files and the templates.  What comes to ``threshold``
    or more is a notice, and an SPDX identifier is one of score 1; of a file's notices the best one counts,
    ties by identifier.  A licence file, by name or because ``WHOLE`` of its words stand in notices, gives its
    licence to its directory (the best one of several, ties by identifier).

    Returns path, ``carry`` columns, license, score (1 for inherited ones: the directory's), origin (``own``,
    ``directory`` or null), from_dir and notices (identifiers found in the file, sorted).  Null and empty
    texts have no own licence; a null path is a file without directory, as is one without a slash, whose
    directory is the empty one.  Rows are kept one for one; an empty table gives no rows.
    """
    spark = files.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = F.coalesce(F.col(path_col).rlike(FILES), F.lit(False))
    lines = F.filter(F.split(text, r"\R", -1), lambda x: F.lower(x).rlike(CUES))
    lines = F.when(F.lower(text).rlike(CUES), lines).otherwise(F.array().cast("array<string>"))
    lines = F.transform(F.when(named, F.array_append(lines, text)).otherwise(lines), _normal)
    cued = F.lower(text).rlike(CUES)
    count = F.when(F.size(lines) > 0, F.regexp_count(F.lower(text), F.lit("[a-z0-9]+"))).otherwise(0)
    scanned = files.select(
        F.monotonically_increasing_id().alias("row"), F.col(path_col).alias("path"), *(F.col(c).alias(f"_c_{c}") for c in carry),
        F.regexp_extract(F.col(path_col), r"^(.*)/[^/]*$", 1).alias("dir"), named.alias("named"), count.alias("words"), lines.alias("lines"),
        F.when(cued, F.concat(_windows(text), F.when(count <= WHOLE_WORDS, F.array(_normal(text))).otherwise(F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>")).alias("blocks"),
        F.when(cued, F.transform(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), _listed)).otherwise(F.array().cast("array<string>")).alias("stated"),
    )
    scanned = materialise(scanned, "license-scan")
    # lines and blocks go by their digest, as a block is long and has many words
    length = F.size(F.split("line", " ")).alias("length")
    single = scanned.select("row", F.explode("lines").alias("line")).select("row", F.unhex(F.md5("line")).alias("line"), length).groupBy("row", "line", "length").agg(F.count("*").alias("n"))
    blocks = scanned.select("row", F.explode("blocks").alias("line")).select("row", F.unhex(F.md5("line")).alias("line"), length).distinct()
    texts = lambda name: scanned.select(F.explode(name).alias("text")).select(F.unhex(F.md5("text")).alias("line"), "text")
    best = materialise(_best(spark, texts("lines"), texts("blocks"), threshold), "license-best")
    stated = scanned.select("row", F.explode("stated").alias("license"), F.lit(1.0).alias("score"), F.lit(0).cast("long").alias("alone"), F.lit(0).alias("joined"))
    of_lines = single.join(best, "line").select("row", "license", "score", (F.col("length") * F.col("n")).alias("alone"), F.lit(0).alias("joined"))
    of_blocks = blocks.join(best, "line").select("row", "license", "score", F.lit(0).cast("long").alias("alone"), F.col("length").alias("joined"))
    notices = materialise(of_lines.unionByName(of_blocks).unionByName(stated), "license-notices")
    top = F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), F.col("license")))
    covered = F.greatest(F.sum("alone"), F.max("joined")).alias("covered")
    own = notices.groupBy("row").agg(top.alias("own"), F.array_sort(F.collect_set("license")).alias("notices"), covered)
    files_ = scanned.drop("lines", "blocks", "stated").join(own, "row", "left")
    files_ = materialise(files_, "license-own")
    gives = files_.filter(F.col("own").isNotNull() & F.col("path").isNotNull() & (F.col("named") | (F.col("covered") >= WHOLE * F.col("words"))))
    gives = gives.groupBy(F.col("dir").alias("above")).agg(F.min_by("own", F.struct(-F.col("own.score"), F.col("own.license"))).alias("given"))
    parts = F.split("dir", "/", -1)
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above")))
    dirs = files_.filter("own IS NULL AND path IS NOT NULL").select("dir").distinct().select("dir", F.explode(up).alias("u")).select("dir", "u.depth", "u.above").distinct()
    near = dirs.join(gives, "above").groupBy("dir").agg(F.max_by(F.struct("above", "given"), "depth").alias("near")).withColumnRenamed("dir", "_dir")
    out = files_.join(near, (F.col("dir") == F.col("_dir")) & F.col("own").isNull() & F.col("path").isNotNull(), "left")
    either = F.coalesce("own", "near.given")
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("near").isNotNull(), "directory")
    return out.select(
        F.col("path").alias(path_col), *(F.col(f"_c_{c}").alias(c) for c in carry), either["license"].alias("license"), either["score"].alias("score"), origin.alias("origin"),
        F.when(F.col("own").isNull(), F.col("near.above")).alias("from_dir"), F.coalesce("notices", F.array().cast("array<string>")).alias("notices"),
    )


def _listed(name: Column) -> Column:
    """An SPDX identifier as ``TEMPLATES`` spells it, where it is there."""
    plain = F.regexp_replace(name, r"(?i)(-only|-or-later|\+)$", "")
    return F.coalesce(*(F.when(F.lower(plain) == known.lower(), F.lit(known)) for known in sorted({n for n, _ in TEMPLATES})), plain)


def _rank(license_col: str) -> Column:
    """Smaller identifiers rank higher."""
    names = sorted({name for name, _ in TEMPLATES})
    return -F.array_position(F.array(*map(F.lit, names)), F.col(license_col))


def _best(spark: SparkSession, lines: DataFrame, blocks: DataFrame, threshold: float) -> DataFrame:
    """Best template of each different line or block: line, license and score, for those at the threshold.

    A text's product with a template is a sum over its words; the square of its length is at least the
    sum of its words' squared weights, and a word that is neither in a template nor in one of ``COMMON`` lines
    weighs as much as that.  So one pass finds all that may come to the threshold, and only those are weighed word
    by word.  The table of templates' and common words goes to all executors: no more common words than ``COMMON``
    times the mean number of different words of a line.
    """
    templates = reduce(DataFrame.union, [spark.range(1).select(F.lit(k).alias("template"), F.lit(name).alias("license"), _normal(F.lit(text)).alias("line")) for k, (name, text) in enumerate(TEMPLATES)])
    templates = materialise(templates.coalesce(1), "license-templates")
    term = F.explode(F.split("line", " ")).alias("term")
    of_templates = templates.select("template", "license", term).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))
    different = lines.groupBy("line").agg(F.first("text").alias("text")).filter("text <> ''")
    of_lines = different.select(F.explode(F.array_distinct(F.split("text", " "))).alias("term"))
    frequency = of_lines.union(of_templates.select("term")).groupBy("term").agg(F.count("*").alias("df"))
    frequency = materialise(frequency, "license-words")
    total = lines.agg(F.count_distinct("line").alias("_total")).select(F.col("_total") + len(TEMPLATES)).first()[0]
    idf = 1 + F.log((1 + F.lit(total)) / (1 + F.coalesce("df", F.lit(0))))
    b = of_templates.join(frequency, "term").select("template", "license", "term", (F.col("tf") * idf).alias("v"))
    b = materialise(b.coalesce(1), "license-template-weights")
    sizes = {r.template: r.size for r in b.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size")).collect()}  # a row for each template
    of = b.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("template", "v"))).alias("_v"))
    of = of.select("term", *(F.coalesce(F.try_element_at("_v", F.lit(k)), F.lit(0.0)).alias(f"_v{k}") for k in sizes))
    known = frequency.filter(F.col("df") * COMMON >= total).union(frequency.join(F.broadcast(of.select("term")), "term", "left_semi")).distinct()
    known = known.select("term", idf.alias("_idf")).join(of, "term", "left")
    rare = 1 + F.log((1 + F.lit(total)) / (1 + F.lit(total / COMMON)))
    texts = lines.union(blocks).groupBy("line").agg(F.first("text").alias("text")).filter("text <> ''")
    words = texts.select("line", F.explode(F.split("text", " ")).alias("term")).join(F.broadcast(known), "term", "left")
    weight = F.coalesce("_idf", rare)
    dots = {k: F.sum(F.col("_idf") * F.col(f"_v{k}")) for k in sizes}
    # words and texts come from one shuffle by line, and the sums need no further one
    bound = words.groupBy("line").agg(F.sum(weight * weight).alias("_least"), *(d.alias(f"_d{k}") for k, d in dots.items()))
    may = reduce(Column.__or__, (F.coalesce(F.col(f"_d{k}") >= (threshold - 1e-6) * size * F.sqrt("_least"), F.lit(False)) for k, size in sizes.items()))
    near = materialise(texts.join(bound.filter(may).select("line").hint("merge"), "line"), "license-near")
    each = near.select("line", F.explode(F.split("text", " ")).alias("term")).groupBy("line", "term").agg(F.count("*").alias("tf"))
    a = materialise(each.join(frequency, "term", "left").select("line", "term", (F.col("tf") * idf).alias("w")), "license-weights")
    products = a.join(F.broadcast(b), "term").groupBy("line", "template", "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    size_a = a.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size_a"))
    size_b = b.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size_b"))
    scored = products.join(F.broadcast(size_b), "template").join(size_a, "line").withColumn("score", F.least(F.round(F.col("dot") / (F.col("size_a") * F.col("size_b")), 9), F.lit(1.0)))
    scored = scored.filter(F.col("score") >= threshold).withColumn("rank", _rank("license"))
    top = scored.groupBy("line").agg(F.max(F.struct("score", "rank", "license")).alias("top"))
    return top.select("line", "top.license", "top.score")

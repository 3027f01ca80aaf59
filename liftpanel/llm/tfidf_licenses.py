"""Licences of files: notices by TF-IDF, and inheritance from folders.

Column expressions and joins only. The notice of a file is the words of its lines that speak of rights. Its
terms are weighted by how rare they are among all notices, and compared with every template by the cosine of
the two sparse vectors, as a join on terms. A file without a notice of its own takes the licence of the nearest
folder above it that has a licence file: paths of folders are spelled out once for each folder, not for each
file, and joined to the folders that have one.
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftpanel.llm.common import written

# Usual notices, by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC0-1.0", "Released into the public domain under Creative Commons CC0 1.0 License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("proprietary", "Copyright. All rights reserved"),
    ("proprietary", "All rights reserved"),
]
# Standard headers of source files, and whole licence texts from the folder beside this file, by the same identifiers.
HEADERS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-2.0", 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program'),
    ("GPL-3.0", 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program'),
    ("LGPL-2.1", 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program'),
    ("LGPL-3.0", 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program'),
    ("AGPL-3.0", 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program'),
    ("MPL-2.0", 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.'),
]
TEXTS = [(f.stem, f.read_text()) for f in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))]
NOTICE = r"(?i)licen[sc]e|copyright|permission is hereby|redistribution|public domain|all rights reserved"
COMMENT = r"^\s*($|#|//|/?\*|--|;|%|<!--|REM )"
BLOCK_COMMENT = r"(?s)^\s*/\*(.*?)\*/"
BETWEEN_PARAGRAPHS = r"\n[ \t]*[#/*;%-]{0,3}[ \t]*\r?\n"
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice|copyright)(\.[a-z]+)?$"
BETWEEN_TERMS = r"[^a-z0-9.-]+|[.-]+(?=[^a-z0-9]|$)|(?<=^|[^a-z0-9])[.-]+"
LEAST_COSINE = 0.7
#: No term weighs more: one that few notices or none have must not outweigh the others as the corpus grows.
MOST_WEIGHT = 4.0


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BETWEEN_TERMS, -1), lambda t: t != "")


def notice_terms(text: Column) -> Column:
    """Terms of the lines that speak of rights; empty for other texts."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(NOTICE))
    return F.when(text.rlike(NOTICE), _terms(F.array_join(lines, "\n"))).otherwise(F.array().cast("array<string>"))


def notice_blocks(text: Column) -> Column:
    """Terms of what may be a notice of several lines, for a text that speaks of rights: the whole text, its
    leading comment, and each paragraph with such a line."""
    lines = F.split(text, "\n", -1)
    code = F.array_position(F.transform(lines, lambda line: line.rlike(COMMENT)), F.lit(False))
    head = F.array_join(F.slice(lines, F.lit(1), F.when(code > 0, code - 1).otherwise(F.size(lines)).cast("int")), "\n")
    paragraphs = F.filter(F.split(text, BETWEEN_PARAGRAPHS, -1), lambda p: p.rlike(NOTICE))
    blocks = F.array_distinct(F.concat(F.array(text, head, F.regexp_extract(text, BLOCK_COMMENT, 1)), paragraphs))
    return F.when(text.rlike(NOTICE), F.transform(blocks, _terms)).otherwise(F.array().cast("array<array<string>>"))


def own_licenses(files: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """``path, license, cosine, notice_terms``: the best template of each path's notice, if it is close enough.

    ``files`` has ``path`` and ``terms`` of single lines, and may have ``blocks``, which are compared with standard
    headers and whole texts too: a whole text goes before a header, a header before a line, which may be a part of both. Rows of one path are one file. Cosines are rounded to 6 places, ties
    go to the first identifier. The weight of a term is its count times ``1 + ln((1 + n) / (1 + df))`` over the
    n notices, at most ``MOST_WEIGHT``; a term of templates that no notice has counts as if one had it.
    """
    spark = files.sparkSession
    views = F.concat(F.array("terms"), F.col("blocks")) if "blocks" in files.columns else F.array("terms")
    each = files.select("path", F.posexplode(views).alias("view", "terms")).select("path", "view", F.explode("terms").alias("term"))
    counted = written(each.groupBy("path", "view", "term").agg(F.count("*").alias("tf")), "notice-terms")
    lines = counted.where("view = 0")
    n = F.lit(lines.select("path").distinct().count())
    idf = lines.groupBy("term").agg(F.least(F.lit(MOST_WEIGHT), 1 + F.log((1 + n) / (1 + F.count("*")))).alias("idf"))
    unseen = F.least(F.lit(MOST_WEIGHT), F.greatest(F.lit(1.0), 1 + F.log((1 + n) / 2)))
    notices = [(i, name, text, rank) for i, (rank, (name, text)) in enumerate((rank, x) for rank, own in enumerate([TEXTS, HEADERS, TEMPLATES]) for x in own)]
    given = spark.createDataFrame(notices, "template int, license string, notice string, rank int")
    model = given.select("template", "license", "rank", F.explode(_terms(F.col("notice"))).alias("term")).groupBy("template", "license", "rank", "term").agg(F.count("*").alias("tf"))
    # Blocks have ordinary words too: those are told by the templates, and a word that comes often counts by its logarithm.
    told = model.groupBy("term").agg((1 + F.log((1 + F.lit(len(notices))) / (1 + F.count("*")))).alias("told"))
    untold = F.lit(1 + math.log(1 + len(notices)))
    often = 1 + F.log("tf")
    block = F.col("view") > 0
    model = model.join(idf, "term", "left").join(told, "term").withColumn("view", F.explode(F.when(F.col("rank") == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    model = model.select("template", "license", "rank", "term", block.alias("block"), F.when(block, often * F.col("told")).otherwise(F.col("tf") * F.coalesce("idf", unseen)).alias("model_weight"))
    sizes = model.groupBy("template", "block").agg(F.sqrt(F.sum(F.col("model_weight") ** 2)).alias("model_size"))
    model = F.broadcast(model.join(sizes, ["template", "block"]))  # as many rows as the templates have terms, short ones twice

    weighted = counted.join(idf, "term", "left").join(F.broadcast(told), "term", "left").select("path", "view", "term", "tf", block.alias("block"), F.when(block, often * F.coalesce("told", untold)).otherwise(F.col("tf") * F.col("idf")).alias("weight"))
    total = weighted.groupBy("path", "view").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("size"), F.sum("tf").alias("notice_terms"))
    dots = weighted.join(model, ["term", "block"]).groupBy("path", "view", "template", "license", "rank", "model_size").agg(F.sum(F.col("weight") * F.col("model_weight")).alias("dot"))
    cosine = F.round(F.col("dot") / (F.col("size") * F.col("model_size")), 6).alias("cosine")
    scored = dots.join(total, ["path", "view"]).select("path", "license", "rank", cosine, "notice_terms").where(F.col("cosine") >= least)
    best = F.min(F.struct("rank", (-F.col("cosine")).alias("less"), "license", "notice_terms")).alias("best")
    return scored.groupBy("path").agg(best).select("path", "best.license", (-F.col("best.less")).alias("cosine"), "best.notice_terms")


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan(files: DataFrame, is_license_file: Column | None = None, least: float = LEAST_COSINE) -> DataFrame:
    """``path, license, cosine, origin, from_folder`` for each path of ``files (path, text)``.

    ``origin`` is ``own`` for a notice in the file, ``inherited`` for one of the nearest folder from its own up
    to the root that has a licence file, else ``none``. Whether a file speaks for its folder is told by its
    name, or by ``is_license_file`` over ``path, text, n_terms, n_notice``; among several the closest to a
    template does, then the first path. Null text is empty; rows with a null path are left out; repeated rows
    and rows of one path are one file; an empty table gives an empty result; further columns are not read.
    """
    rule = F.col("path").rlike(LICENSE_FILE) if is_license_file is None else is_license_file
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.length(F.regexp_replace(text, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "w")).alias("n_terms")
    read = files.where("path is not null").select("path", text.alias("text")).withColumn("terms", notice_terms(F.col("text"))).withColumn("blocks", notice_blocks(F.col("text")))
    read = read.select("path", "text", "terms", "blocks", words, F.size("terms").alias("n_notice")).select("path", "terms", "blocks", rule.alias("speaks"))
    own = own_licenses(read.select("path", "terms", "blocks"), least)
    paths = read.groupBy("path").agg(F.max("speaks").alias("speaks"))
    found = paths.join(own, "path", "left").withColumn("folder", _folder(F.col("path")))
    speaking = found.where("speaks and license is not null").groupBy("folder")
    licensed = speaking.agg(F.min(F.struct((-F.col("cosine")).alias("less"), "path", "license")).alias("best")).select(F.col("folder").alias("from_folder"), F.col("best.license").alias("inherited"), (-F.col("best.less")).alias("inherited_cosine"))

    folders = found.where("license is null").select("folder").distinct()
    parts = F.split("folder", "/", -1)
    above = folders.select("folder", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("depth", "from_folder"))
    nearest = above.join(licensed, "from_folder").groupBy("folder").agg(F.max_by(F.struct("from_folder", "inherited", "inherited_cosine"), "depth").alias("up")).select("folder", "up.*")
    joined = found.join(nearest, "folder", "left")
    kept = F.col("license").isNotNull()
    return joined.select(
        "path",
        F.coalesce("license", "inherited").alias("license"),
        F.when(kept, F.col("cosine")).otherwise(F.col("inherited_cosine")).alias("cosine"),
        F.when(kept, "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~kept, F.col("from_folder")).alias("from_folder"),
    )

"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A text is looked through line by line and as a whole. What names a licence cue is a segment; its terms are weighed by
the inverse document frequency among the templates (a term that no template has weighs most), and the cosine to each
template is a join on terms, with the templates, a fixed table, broadcast. The best template above the threshold is
the segment's licence. A file whose whole text matches, or that has the name of a licence file, covers its directory:
files without a licence of their own take that of the nearest directory above them that has one. Everything is
DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Licence identifiers with the wording of their notices, short and long.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC0-1.0", "This work has been dedicated to the public domain under CC0 1.0 Universal."),
    ("All-rights-reserved", "All rights reserved."),
)
#: Every template holds one of them; a segment without any is no licence notice.
CUES = ("licen", "copyright", "permission is hereby", "redistribut", "public domain", "rights reserved")
FILE_NAMES = "(?i)(^|/)(licen[cs]e|copying|notice|unlicense)(\\.[a-z]+)?$"
LEAST = 0.6


def _cue(text: Column) -> Column:
    found = text.contains(CUES[0])
    for cue in CUES[1:]:
        found = found | text.contains(cue)
    return found


def _terms(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, term, tf): the words of the column seg."""
    words = df.select(*keys, F.explode(F.regexp_extract_all("seg", F.lit("[a-z0-9]+"), F.lit(0))).alias("term"))
    return words.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def template_weights(spark: SparkSession, templates: tuple = TEMPLATES) -> tuple[DataFrame, DataFrame, float]:
    """(term, idf), (term, license, template, weight) with unit vectors, and the idf of a term no template has."""
    table = spark.createDataFrame([(i, name, text.lower()) for i, (name, text) in enumerate(templates)], "template int, license string, seg string")
    terms = _terms(table, "template", "license")
    idf = terms.groupBy("term").agg((F.log(F.lit(1.0 + len(templates)) / (F.count(F.lit(1)) + 1)) + 1).alias("idf"))
    weighed = terms.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("template")))
    most = F.log(F.lit(1.0 + len(templates))) + 1
    return idf, weighed.select("term", "license", "template", (F.col("w") / norm).alias("weight")), spark.range(1).select(most).first()[0]


def segment_licenses(files: DataFrame, templates: tuple = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(path, seq, kind, license, score): every segment of files (path, text) that matches a template.

    kind is file for a whole text, else header. A tie goes to the licence that comes first by name.
    """
    idf, weights, most = template_weights(files.sparkSession, templates)
    found = files.select("path", F.lower("text").alias("low")).where(_cue(F.col("low")))
    lines = F.filter(F.split("low", "\n"), _cue)
    pieces = found.select("path", F.explode(F.array_union(F.transform(F.array_distinct(lines), lambda x: F.struct(F.lit("header").alias("kind"), x.alias("seg"))), F.array(F.struct(F.lit("file").alias("kind"), F.col("low").alias("seg"))))).alias("piece"))
    # Equal segments of a path are one; the segment's hash tells the others apart.
    segments = pieces.select("path", F.col("piece.kind").alias("kind"), F.xxhash64("piece.seg").alias("seq"), F.col("piece.seg").alias("seg"))
    terms = _terms(segments, "path", "kind", "seq").join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(most)))
    norms = terms.groupBy("path", "kind", "seq").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = terms.join(F.broadcast(weights), "term").groupBy("path", "kind", "seq", "license", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, ["path", "kind", "seq"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= least)
    return scored.groupBy("path", "kind", "seq").agg(F.min(F.struct(-F.col("score"), "license")).alias("best")).select("path", "seq", "kind", F.col("best.license").alias("license"), (-F.col("best.col1")).alias("score"))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: tuple = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(path, license, score, method, origin) of every path.

    method is file (the whole text matches), header (a line does), inherited (from the directory `origin`) or null.
    Of a path's own segments the best counts, a whole text before a line at the same score, then the first licence by
    name. A directory has the best licence of its licence files, which are those whose whole text matches and those
    with such a name; the directory of `a/b` is `a`, that of `a` is empty. Null and empty texts match nothing but may
    inherit; rows with a null path have no directory, and match by their text alone, all as one path. Repeated paths
    are one path with all their texts. Other columns are ignored; an empty table gives no row.
    """
    source = files.select(F.coalesce(files[f"`{path_col}`"].cast("string"), F.lit("\0")).alias("path"), files[f"`{text_col}`"].alias("text"))
    segments = segment_licenses(source, templates, least)
    best = F.min(F.struct((-F.col("score")).alias("low"), (F.col("kind") != "file").alias("line"), "license", "kind"))
    own = segments.groupBy("path").agg(best.alias("b")).select("path", F.col("b.license").alias("license"), (-F.col("b.low")).alias("score"), F.col("b.kind").alias("kind"))
    directory = lambda path: F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    # Any whole text that matches covers its directory, whether or not one of its lines matches better.
    whole = segments.where((F.col("kind") == "file") & ~F.col("path").rlike(FILE_NAMES)).select("path", "license", "score")
    named = whole.union(own.where(F.col("path").rlike(FILE_NAMES)).select("path", "license", "score")).where(F.col("path") != "\0").withColumn("dir", directory("path"))
    covered = named.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("low"), "license")).alias("b")).select(F.col("dir").alias("origin"), F.col("b.license").alias("d_license"), (-F.col("b.low")).alias("d_score"))
    paths = source.select("path").distinct().withColumn("dir", directory("path"))
    parts = F.split("dir", "/")
    ancestors = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    above = paths.where(F.col("path") != "\0").select("dir").distinct().select("dir", F.posexplode(ancestors).alias("depth", "origin"))
    nearest = above.join(covered, "origin").groupBy("dir").agg(F.max(F.struct("depth", "origin", "d_license", "d_score")).alias("n"))
    all_paths = paths.join(own, "path", "left").join(nearest, "dir", "left")
    mine = F.col("license").isNotNull()
    inherits = ~mine & F.col("n").isNotNull() & (F.col("path") != "\0")
    return all_paths.select(
        F.nullif(F.col("path"), F.lit("\0")).alias("path"), F.when(mine, F.col("license")).when(inherits, F.col("n.d_license")).alias("license"), F.when(mine, F.col("score")).when(inherits, F.col("n.d_score")).alias("score"),
        F.when(mine, F.col("kind")).when(inherits, F.lit("inherited")).alias("method"), F.when(inherits, F.col("n.origin")).alias("origin"),
    )

"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Texts and templates become sparse TF-IDF vectors (idf over the templates; a word that no template has weighs as the
rarest). A header is looked for wherever a text holds a template's first cue word: the words around it that the template
would cover are one vector, across line ends, compared with that template. A licence file is one whose whole text is
like a template. It covers its directory: a file without a licence of its own takes that of the nearest
directory above it that has one, found by joining ancestor paths.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutflow.llm.common import let, load, written

# Public licence notices and short licence texts by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "Released under CC0 1.0, no rights reserved, dedicated to the public domain"),
]
# Words that a template is found by; each template has one.
CUES = ["licensed", "license", "licence", "licenced", "released", "permission", "redistribution", "redistribute"]
CUE = "licen[sc]e|released|permission|redistribut"
NOT_WORD = "[^a-z0-9.]+"
THRESHOLD = 0.6
REACH = max(len(re.split(NOT_WORD, t.lower())) for _, t in TEMPLATES)


def tokens(text: Column) -> Column:
    """Lower-case words; dots stay inside (2.0) and go at the end."""
    parts = F.transform(F.split(F.lower(text), NOT_WORD), lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    return F.filter(parts, lambda w: w != "")


def template_words(spark: SparkSession) -> DataFrame:
    """``tid, spdx, cue, before`` (words before the first cue), ``len, weights`` (word to weight of unit norm): a fixed list."""
    rows = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(TEMPLATES)], "tid int, spdx string, template string").withColumn("w", tokens(F.col("template")))
    tf = rows.select("tid", F.explode("w").alias("word")).groupBy("tid", "word").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    raw = tf.join(df, "word").withColumn("idf", F.log(F.lit(1.0 + len(TEMPLATES)) / (F.col("df") + 1)) + 1).withColumn("x", F.col("tf") * F.col("idf"))
    norm = raw.groupBy("tid").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    vectors = raw.join(norm, "tid").select("tid", "word", "idf", (F.col("x") / F.col("norm")).alias("weight"))
    first = F.filter(F.transform("w", lambda w, i: F.when(w.isin(CUES), i)), lambda i: i.isNotNull())[0]
    heads = rows.withColumn("before", first).select("tid", "spdx", F.get("w", F.col("before")).alias("cue"), "before", F.size("w").alias("len"))
    return vectors.join(heads, "tid").select("tid", "spdx", "cue", "before", "len", "word", "idf", "weight")


def cosines(units: DataFrame, vectors: DataFrame, key: list[str], pinned: bool) -> DataFrame:
    """``key, tid, spdx, cosine`` of units ``key, words`` to the templates; with ``pinned``, only to the one that ``tid`` in the key names."""
    counted = units.select(*key, F.explode("words").alias("word")).groupBy(*key, "word").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    # The vectors are of the fixed list above: a few hundred rows.
    idf = F.broadcast(vectors.select("word", "idf").distinct())
    rarest = F.log(F.lit((1.0 + len(TEMPLATES)) / 2)) + 1
    weighted = counted.join(idf, "word", "left").withColumn("x", F.col("tf") * F.coalesce("idf", rarest))
    norms = weighted.groupBy(*key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    shared = weighted.join(F.broadcast(vectors.select("tid", "spdx", "word", "weight")), ["tid", "word"] if pinned else "word")
    on = key if pinned else [*key, "tid"]
    dots = shared.groupBy(*on, "spdx").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    return dots.join(norms, key).select(*on, "spdx", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"))


def matches(files: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Headers ``path, start, spdx, cosine`` and whole files ``path, spdx, cosine`` at or above ``threshold``.

    ``start`` is the 0-based word where the header begins. ``files`` has ``path, text``; null texts and paths match nothing, and
    of rows that share a path each text is compared by itself.
    """
    spark = files.sparkSession
    vectors = written(template_words(spark), "licence-templates")
    # Only texts with a cue go on: written, as two branches read their words.
    cued = files.select("path", "text").filter(F.lower("text").rlike(CUE) & F.col("path").isNotNull()).select("path", F.xxhash64("text").alias("copy"), tokens(F.col("text")).alias("words"))
    # A row that is repeated only doubles its counts, which changes no cosine.
    texts = written(cued, "licence-texts")
    heads = F.broadcast(vectors.select("tid", "cue", "before", "len").distinct())

    def around(w: Column) -> Column:
        """Each cue word with the words that any template could cover there."""
        cues = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("at"), x.alias("cue"))), lambda s: s["cue"].isin(CUES))
        span = lambda at: F.sequence(F.greatest(at - REACH, F.lit(0)), F.least(at + REACH, F.size(w) - 1))
        return F.transform(cues, lambda s: F.struct(s["at"].alias("at"), s["cue"].alias("cue"), F.transform(span(s["at"]), lambda k: F.get(w, k)).alias("near")))

    spots = texts.select("path", "copy", F.inline(let(F.col("words"), around)))
    found = spots.join(heads, "cue").withColumn("start", F.greatest(F.col("at") - F.col("before"), F.lit(0)))
    window = F.slice("near", F.col("start") - F.greatest(F.col("at") - REACH, F.lit(0)) + 1, F.col("at") - F.col("before") + F.col("len") - F.col("start"))
    headers = found.select("path", "copy", "start", "tid", window.alias("words")).distinct()
    near = cosines(headers, vectors, ["path", "copy", "start", "tid"], pinned=True).filter(F.col("cosine") >= threshold)
    whole = cosines(texts, vectors, ["path", "copy"], pinned=False).filter(F.col("cosine") >= threshold)
    return near.select("path", "start", "spdx", "cosine"), whole.select("path", "spdx", "cosine")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def ancestors(folder: Column) -> Column:
    """The directory and every one above it, with their depth: for a/b: ("", 0), (a, 1), (a/b, 2)."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("dir"), k.alias("depth")))


def scan_licenses(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Each row of ``files`` (``path, text``), without the text, with ``spdx, cosine, origin`` (``own``, ``inherited`` or ``none``) and ``from_path``.

    A file's own licence is that of its most alike header or of its whole text (ties by name); a directory's is the
    best whole text of its files (ties by name, then path). Repeated rows share their path's result; a null path gets ``none``; columns of the
    added names are overwritten, any others are kept.
    """
    files = files.drop("spdx", "cosine", "origin", "from_path")
    headers, whole = matches(files, threshold)
    best = F.min(F.struct((-F.col("cosine")).alias("neg"), "spdx"))
    own = headers.select("path", "spdx", "cosine").unionByName(whole).groupBy("path").agg(best.alias("b")).select("path", F.col("b.spdx").alias("__own"), (-F.col("b.neg")).alias("__cos"))
    own = written(own, "licences")
    dirs = whole.groupBy(directory(F.col("path")).alias("__dir")).agg(F.min(F.struct((-F.col("cosine")).alias("neg"), "spdx", "path")).alias("d"))
    dirs = written(dirs, "licensed-directories")
    # Directories climb, not files: each asks once for all that it holds.
    folders = files.filter("path is not null").select(directory(F.col("path")).alias("__folder")).distinct()
    climbing = folders.select("__folder", F.inline(ancestors(F.col("__folder")))).withColumnRenamed("dir", "__dir")
    nearest = climbing.join(dirs, "__dir").groupBy("__folder").agg(F.max_by("d", "depth").alias("__up"))
    rows = files.drop("text").join(own, "path", "left").withColumn("__folder", directory(F.col("path"))).join(nearest, "__folder", "left")
    has, up = F.col("__own").isNotNull(), F.col("__up").isNotNull() & F.col("path").isNotNull()
    added = [
        F.coalesce("__own", "__up.spdx").alias("spdx"),
        F.coalesce(F.col("__cos"), -F.col("__up.neg")).alias("cosine"),
        F.when(has, "own").when(up, "inherited").otherwise("none").alias("origin"),
        F.when(has, F.col("path")).otherwise(F.col("__up.path")).alias("from_path"),
    ]
    return rows.select(*[f"`{c}`" for c in files.columns if c != "text"], *added)


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files ``doc_id, path, text``: ``source/a/b/doc_id`` with 4096 ids to an a and 64 to a b; a null id has a null path."""
    parts = [F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 4096).cast("string"), F.floor(F.col("doc_id") / 64).cast("string"), F.col("doc_id").cast("string")]
    return docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.concat_ws("/", *parts)).alias("path"), "text")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, path, spdx, cosine, origin, from_path`` of every document; null ids and texts get ``none``."""
    return scan_licenses(document_files(load(spark, sf_dir, "documents"))).select("doc_id", "path", "spdx", "cosine", "origin", "from_path")


def _tokens_sql(text: str) -> str:
    return f"list_filter(list_transform(string_split_regex(lower({text}), '{NOT_WORD}'), lambda w: regexp_replace(w, '^\\.+|\\.+$', '', 'g')), lambda w: w <> '')"


def _oracle() -> str:
    values = ", ".join(f"({i}, '{s}', '{t}')" for i, (s, t) in enumerate(TEMPLATES))
    n, cues = len(TEMPLATES), ", ".join(f"'{c}'" for c in CUES)
    return f"""
WITH files AS (
  SELECT doc_id, concat_ws('/', coalesce(source, 'none'), floor(doc_id / 4096)::BIGINT, floor(doc_id / 64)::BIGINT, doc_id) AS path, text FROM documents),
templates(tid, spdx, template) AS (VALUES {values}),
tw AS MATERIALIZED (SELECT tid, spdx, {_tokens_sql("template")} AS w FROM templates),
heads AS (SELECT tid, spdx, len(w) AS n, list_filter(generate_series(1, len(w)), lambda i: w[i] IN ({cues}))[1] AS at, w FROM tw),
ttf AS (SELECT tid, spdx, word, count(*) AS tf FROM (SELECT tid, spdx, unnest(w) AS word FROM tw) GROUP BY ALL),
idf AS (SELECT word, ln({1.0 + n} / (count(*) + 1)) + 1 AS idf FROM ttf GROUP BY word),
traw AS (SELECT tid, spdx, word, tf * idf AS w FROM ttf JOIN idf USING (word)),
tvec AS MATERIALIZED (SELECT tid, spdx, word, w / sqrt(sum(w * w) OVER (PARTITION BY tid)) AS weight FROM traw),
texts AS MATERIALIZED (SELECT path, {_tokens_sql("text")} AS w FROM files WHERE regexp_matches(lower(coalesce(text, '')), '{CUE}')),
spots AS (SELECT path, w, i FROM (SELECT path, w, unnest(generate_series(1, len(w))) AS i FROM texts) WHERE w[i] IN ({cues})),
units AS (
  SELECT DISTINCT path, h.tid, greatest(i - h.at, 0) AS start, list_slice(s.w, greatest(i - h.at, 0) + 1, i - h.at + h.n) AS w FROM spots s JOIN heads h ON s.w[s.i] = h.w[h.at]
  UNION ALL SELECT path, -1, -1, w FROM texts),
tf AS (
  SELECT path, u.tid, start, word, count(*) * coalesce(any_value(idf), ln({(1.0 + n) / 2}) + 1) AS x
  FROM (SELECT path, tid, start, unnest(w) AS word FROM units) u LEFT JOIN idf USING (word) GROUP BY ALL),
norms AS (SELECT path, tid, start, sqrt(sum(x * x)) AS norm FROM tf GROUP BY ALL),
dots AS (SELECT path, f.tid AS unit, start, v.tid, spdx, sum(x * weight) AS dot FROM tf f JOIN tvec v USING (word) WHERE f.tid IN (-1, v.tid) GROUP BY ALL),
good AS MATERIALIZED (
  SELECT * FROM (SELECT d.path, d.unit, d.spdx, round(dot / norm, 6) AS cosine FROM dots d JOIN norms n ON d.path = n.path AND d.unit = n.tid AND d.start = n.start) WHERE cosine >= {THRESHOLD}),
own AS (SELECT path, spdx, cosine FROM good QUALIFY row_number() OVER (PARTITION BY path ORDER BY cosine DESC, spdx) = 1),
dirs AS (
  SELECT regexp_replace(path, '/[^/]*$', '') AS dir, spdx, cosine, path FROM good WHERE unit = -1
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, spdx, path) = 1),
up AS (
  SELECT f.path, d.spdx, d.cosine, d.path AS from_path FROM files f JOIN dirs d ON starts_with(f.path, d.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY f.path ORDER BY length(d.dir) DESC) = 1)
SELECT f.doc_id, f.path, coalesce(o.spdx, u.spdx) AS spdx, coalesce(o.cosine, u.cosine) AS cosine,
  CASE WHEN o.spdx IS NOT NULL THEN 'own' WHEN u.spdx IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN o.spdx IS NOT NULL THEN f.path ELSE u.from_path END AS from_path
FROM files f LEFT JOIN own o USING (path) LEFT JOIN up u USING (path)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_licenses": op6_licenses}
ORACLES: dict[str, str] = {"op6_licenses": _oracle()}

"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance down the directory tree.

A passage is any line of a text that speaks of a licence, the block of lines around it (up to blank lines, without comment
marks) and, for a licence file, also the whole text. Passages and
templates are sparse vectors over the templates' terms, weighed by term frequency times inverse document frequency, where
document frequencies are counted over all files; other words of a passage count with weight one in its length. A file's own
licence is the template with the largest cosine, if that reaches ``LEAST_COSINE``.

A directory has the licence of its best licence file. Directories without one take that of the nearest ancestor: each
directory (not each file) is joined with all of its ancestors, and the deepest match wins. A file has its own licence, else
its directory's.

DataFrame functions only. What comes to the driver are the document frequencies of the templates' terms, which are bounded.

Defined cases: null and empty texts have no own licence and may inherit; null paths count as the empty path in the root;
equal cosines go to the template first in the table; of equal licence files the smallest path decides; repeated rows are
judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Usual notices of common licences.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0. Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    *((name, f"SPDX-License-Identifier: {tag}") for name, tag in (
        ("Apache-2.0", "Apache-2.0"), ("MIT", "MIT"), ("GPL-3.0", "GPL-3.0-only"), ("GPL-3.0", "GPL-3.0-or-later"), ("GPL-2.0", "GPL-2.0-only"), ("GPL-2.0", "GPL-2.0-or-later"),
        ("LGPL-3.0", "LGPL-3.0-only"), ("AGPL-3.0", "AGPL-3.0-only"), ("BSD-3-Clause", "BSD-3-Clause"), ("MPL-2.0", "MPL-2.0"), ("CC-BY-4.0", "CC-BY-4.0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"), ("CC0-1.0", "CC0-1.0"),
    )),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved. Proprietary and confidential; no part may be reproduced without written permission."),
]
LEAST_COSINE = 0.6
#: Lines that may be headers.
SPEAKS = r"(?i)licen[sc]e|copyright|©|spdx|all rights reserved|public domain|permission is hereby|creative commons|redistribut"
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)[^/]*$"
_BREAK = r"[^\p{L}\p{N}]+"


def terms(text: str) -> list[str]:
    return [x for x in re.split(r"[\W_]+", text.lower()) if x]


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _BREAK), lambda w: w != "")


def frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of files, and of files that hold each term; partial counts before one small shuffle."""
    known = F.array(*map(F.lit, vocabulary))
    found = files.select(F.explode(F.concat(F.array_intersect(_tokens(F.coalesce(F.col("text").cast("string"), F.lit(""))), known), F.array(F.lit("")))).alias("t"))
    counts = {x["t"]: x["n"] for x in found.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    return counts.get("", 0), counts


def _cosines(tokens: Column, templates: list[tuple[str, str]], idf: dict[str, float]) -> Column:
    """Best ``(cosine, -template number)`` of a token array."""
    weights = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in sorted(idf.items())))
    known = F.array(*map(F.lit, sorted(idf)))

    def best(own: Column) -> Column:  # own: (t, tf * idf) of the terms that the templates know, and the count of other words
        def cosine(number: int, text: str) -> Column:
            tf = {t: terms(text).count(t) for t in set(terms(text))}
            norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in tf.items()))
            template = F.create_map(*(x for t, n in sorted(tf.items()) for x in (F.lit(t), F.lit(n * idf[t] / norm))))
            dot = F.aggregate(own["v"], F.lit(0.0), lambda a, x: a + x["w"] * F.coalesce(F.try_element_at(template, x["t"]), F.lit(0.0)))
            return F.struct((dot / own["norm"]).alias("cosine"), F.lit(-number).alias("number"))

        return F.array_max(F.array(*(cosine(k, text) for k, (_, text) in enumerate(templates))))

    def weighed(inside: Column) -> Column:
        hits = F.filter(weights, lambda x: F.array_contains(inside, x["t"]))
        v = F.transform(hits, lambda x: F.struct(x["t"].alias("t"), (x["w"] * F.size(F.filter(inside, lambda y: y == x["t"]))).alias("w")))
        return _let(v, lambda u: F.struct(u.alias("v"), F.sqrt(F.aggregate(u, F.lit(0.0), lambda a, x: a + x["w"] * x["w"]) + F.size(tokens) - F.size(inside)).alias("norm")))

    inside = F.filter(tokens, lambda w: F.array_contains(known, w))
    return F.when(F.size(F.array_intersect(tokens, known)) == 0, None).otherwise(_let(inside, lambda i: _let(weighed(i), best)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def own_licences(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """``files(file_id, path, text)`` to ``(file_id, path, own_license, own_score)``."""
    vocabulary = sorted({t for _, text in templates for t in terms(text)})
    n, df = frequencies(files, vocabulary)
    idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in vocabulary}
    path = F.coalesce(F.col("path").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(SPEAKS))
    # blocks: runs of lines between blank ones; only those that speak are scored
    blocks = F.filter(F.split(F.regexp_replace(text, r"(?m)^[ \t]*(?:[#*;%]+|//+|/\*+|--+|\*/)?[ \t]*", ""), r"\n\s*\n"), lambda x: x.contains("\n") & x.rlike(SPEAKS))
    passages = F.concat(lines, blocks, F.when(path.rlike(LICENCE_FILE), F.array(text)).otherwise(F.expr("cast(array() as array<string>)")))
    rows = files.select("file_id", path.alias("path"), passages.alias("passages"))
    scored = rows.select("file_id", "path", F.array_max(F.transform("passages", lambda p: _let(_tokens(p), lambda t: _cosines(t, templates, idf)))).alias("best"))
    names = F.array(*(F.lit(name) for name, _ in templates))
    good = F.coalesce(F.col("best.cosine") >= least, F.lit(False))
    return scored.select("file_id", "path", F.when(good, F.element_at(names, 1 - F.col("best.number"))).alias("own_license"), F.when(good, F.round("best.cosine", 6)).alias("own_score"))


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """``files(file_id, path, text)`` to ``(file_id, path, own_license, own_score, licensed_dir, license)``."""
    from .common import written

    own = written(own_licences(files, templates, least).withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)), "licences")
    licensed = own.where(F.col("own_license").isNotNull() & F.col("path").rlike(LICENCE_FILE)).groupBy("dir")
    licensed = licensed.agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_license")).alias("b")).select(F.col("dir").alias("at"), F.col("b.own_license").alias("dir_license"))
    parts = F.split("dir", "/")
    dirs = own.select("dir").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("at"))
    near = dirs.join(licensed, "at").groupBy("dir").agg(F.max(F.struct(F.length("at").alias("depth"), "at", "dir_license")).alias("b")).select("dir", F.col("b.at").alias("licensed_dir"), "b.dir_license")
    return own.join(near, "dir", "left").select("file_id", "path", "own_license", "own_score", "licensed_dir", F.coalesce("own_license", "dir_license").alias("license"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree ``/source/lang/bucket``; every 20th id is a licence file, at one of three depths."""
    source, lang, i = (F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in ("source", "lang", "doc_id"))
    bucket = F.coalesce((F.col("doc_id") % 64).cast("string"), F.lit("none"))
    top, middle, deep = F.concat_ws("/", F.lit(""), source), F.concat_ws("/", F.lit(""), source, lang), F.concat_ws("/", F.lit(""), source, lang, bucket)
    at = F.when(F.col("doc_id") % 400 == 0, top).when(F.col("doc_id") % 100 == 0, middle).otherwise(deep)
    path = F.when(F.col("doc_id") % 20 == 0, F.concat(at, F.lit("/LICENSE-"), i)).otherwise(F.concat(deep, F.lit("/"), i, F.lit(".txt")))
    return docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")


def license_rows(docs: DataFrame) -> DataFrame:
    return scan(document_files(docs)).withColumnRenamed("file_id", "doc_id")


def oracle_sql(templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST_COSINE) -> str:
    """SQL of ``license_rows``."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = sorted({t for _, text in templates for t in terms(text)})
    counted = [(k, t, terms(text).count(t)) for k, (_, text) in enumerate(templates) for t in sorted(set(terms(text)))]
    words = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')".format
    return f"""
WITH voc AS (SELECT unnest([{", ".join(map(quoted, known))}]) AS t), names AS (SELECT unnest(range({len(templates)})) AS k, unnest([{", ".join(quoted(n) for n, _ in templates)}]) AS name),
tf AS (SELECT unnest([{", ".join(str(k) for k, _, _ in counted)}]) AS k, unnest([{", ".join(quoted(t) for _, t, _ in counted)}]) AS t, unnest([{", ".join(str(n) for _, _, n in counted)}]) AS n),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang, coalesce(doc_id::VARCHAR, 'none') AS i, coalesce((doc_id % 64)::VARCHAR, 'none') AS bucket FROM documents),
f AS MATERIALIZED (SELECT r, doc_id, text, CASE WHEN doc_id % 20 = 0 THEN '/' || source || CASE WHEN doc_id % 400 = 0 THEN '' WHEN doc_id % 100 = 0 THEN '/' || lang ELSE '/' || lang || '/' || bucket END || '/LICENSE-' || i ELSE '/' || source || '/' || lang || '/' || bucket || '/' || i || '.txt' END AS path FROM d),
df AS (SELECT t, count(*) AS n FROM (SELECT r, unnest(list_distinct({words("text")})) AS t FROM f) JOIN voc USING (t) GROUP BY t),
idf AS (SELECT voc.t, ln((1 + (SELECT count(*) FROM f)) / (1 + coalesce(n, 0))) + 1 AS w FROM voc LEFT JOIN df USING (t)),
tw AS (SELECT k, t, n * w / sqrt(sum(n * w * n * w) OVER (PARTITION BY k)) AS w FROM tf JOIN idf USING (t)),
ps AS (SELECT r, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{SPEAKS}'))
  || list_filter(regexp_split_to_array(regexp_replace(text, '(?m)^[ \\t]*(?:[#*;%]+|//+|/\\*+|--+|\\*/)?[ \\t]*', '', 'g'), '\\n\\s*\\n'), lambda x: contains(x, chr(10)) AND regexp_matches(x, '{SPEAKS}'))
  || CASE WHEN regexp_matches(path, '{LICENCE_FILE}') THEN [text] ELSE [] END) AS p FROM f),
pt AS (SELECT row_number() OVER () AS q, r, {words("p")} AS w FROM ps),
pc AS (SELECT q, t, count(*) AS n FROM (SELECT q, unnest(w) AS t FROM pt) JOIN voc USING (t) GROUP BY q, t),
pn AS (SELECT q, sqrt(sum(pc.n * idf.w * pc.n * idf.w) + any_value(len(pt.w)) - sum(pc.n)) AS norm, any_value(r) AS r FROM pc JOIN idf USING (t) JOIN pt USING (q) GROUP BY q),
cs AS (SELECT q, k, sum(pc.n * idf.w * tw.w) AS dot FROM pc JOIN idf USING (t) JOIN tw USING (t) GROUP BY q, k),
best AS (SELECT r, dot / norm AS cosine, name FROM cs JOIN pn USING (q) JOIN names USING (k) QUALIFY row_number() OVER (PARTITION BY r ORDER BY round(dot / norm, 12) DESC, k) = 1),
own AS MATERIALIZED (SELECT f.*, CASE WHEN cosine >= {least} THEN name END AS own_license, CASE WHEN cosine >= {least} THEN round(cosine, 6) END AS own_score, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM f LEFT JOIN best USING (r)),
lic AS (SELECT dir AS place, own_license AS dir_license FROM own WHERE own_license IS NOT NULL AND regexp_matches(path, '{LICENCE_FILE}') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, path, own_license) = 1),
up AS (SELECT dir, unnest(list_transform(range(1, len(string_split(dir, '/')) + 1), lambda n: array_to_string(string_split(dir, '/')[1:n], '/'))) AS place FROM (SELECT DISTINCT dir FROM own)),
near AS (SELECT dir, arg_max(place, length(place)) AS licensed_dir, arg_max(dir_license, length(place)) AS dir_license FROM up JOIN lic USING (place) GROUP BY dir)
SELECT doc_id, path, own_license, own_score, licensed_dir, coalesce(own_license, dir_license) AS license FROM own LEFT JOIN near USING (dir)
"""

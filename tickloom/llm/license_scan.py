"""License scans: sparse TF-IDF cosine to licence templates, then inheritance from the nearest directory.

Only DataFrame functions run here. A text's units are its lines (headers), runs of terms as wide as a
template, over line ends and inside lines (wrapped headers, notices in paragraphs), and the text as a
whole (licence files), which is held against full licence texts too. A unit's vector has for each of its terms 1 + ln of its
frequency in the unit, times the inverse document frequency among the
templates (terms of no template have the highest), and a unit is a match if its cosine with a
template is ``least`` or more. Of full texts only the sets of terms are kept, so there frequencies don't count. Only units with an anchor term are scored: the other terms of each
template weigh so little that no unit without an anchor could reach ``least``. A file
without a licence of its own takes that of the licence file in its nearest directory upwards.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, fresh, row_key, spread_join, table
from .license_texts import FULL

TERM = "[a-z0-9]+([.][0-9]+)*"
#: Fixed texts: usual notices of licences.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved."],
}
LEAST = 0.8
#: Stands for a null path in keys; no path has a null character.
NO_PATH = "\x00"
#: Frequent words of English; they are the last to become anchors. Any order of terms gives valid anchors.
FREQUENT = frozenset("a all an and any as at be been by can do either except for found free from has if in into is it its later law license may met not of on one only or other provided that the there they this to under use used was we what will with work you".split())


def terms(text: str) -> set[str]:
    return set(counts(text))


def counts(text: str) -> Counter:
    return Counter(m[0] for m in re.finditer(TERM, text.lower()))


def tf(n: int) -> float:
    """Weight of a term that a unit has ``n`` times."""
    return 1 + math.log(n)


def _model(least: float):
    """(templates as (number, licence, weight of each term by its frequency, norm), squared inverse document frequency of each term, that of others, anchors)."""
    rows = [(name, {t: tf(n) for t, n in sorted(counts(text).items())}) for name, texts in TEMPLATES.items() for text in texts]
    df = Counter(t for _, ts in rows for t in ts)
    weight = lambda n: (1 + math.log((len(rows) + 1) / (n + 1))) ** 2
    squares = {t: weight(df[t]) for t in sorted(df)}
    anchors: set[str] = set()
    for _, ts in rows:
        # the cosine with a unit without anchors is at most the root of the rest's share in the norm, whatever the unit's frequencies are
        total, rest = sum(w * w * squares[t] for t, w in ts.items()), 0.0
        for t in sorted(ts, key=lambda t: (t not in FREQUENT, ts[t] ** 2 * squares[t], t)):
            rest += ts[t] ** 2 * squares[t]
            if math.sqrt(rest / total) >= 0.999 * least:
                anchors.add(t)
    return [(k, name, ts, math.sqrt(sum(w * w * squares[t] for t, w in ts.items()))) for k, (name, ts) in enumerate(rows)], squares, weight(0), sorted(anchors)


def _full_model():
    """(full texts as (number, licence, terms, norm), squared weight of each term, that of others)."""
    first = sum(map(len, TEMPLATES.values()))
    df = Counter(t for text in FULL.values() for t in terms(text))
    weight = lambda n: (1 + math.log((len(FULL) + 1) / (n + 1))) ** 2
    squares = {t: weight(df[t]) for t in sorted(df)}
    rows = [(first + k, name, sorted(terms(text))) for k, (name, text) in enumerate(FULL.items())]
    return [(k, name, ts, math.sqrt(sum(squares[t] for t in ts))) for k, name, ts in rows], squares, weight(0)


def _found(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0))


def _counted(units: DataFrame) -> DataFrame:
    """``terms`` with repeats becomes ``counted``, (term, n) of each distinct one. By sorting, so a text of any length takes n log n steps."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size("sorted"), F.lit(1))), lambda i: (i == 1) | (F.get("sorted", i - 1) != F.get("sorted", i - 2)))
    counted = F.transform("firsts", lambda i, k: F.struct(F.get("sorted", i - 1).alias("term"), (F.coalesce(F.get("firsts", k + 1), F.size("sorted") + 1) - i).alias("n")))
    names = [c for c in units.columns if c != "terms"]
    # each step is a column of its own, so that none is worked out again for each element
    # no filter on terms here: it would be one more search of the text
    some = units.select(*names, F.sort_array("terms").alias("sorted"))
    return some.select(*names, "sorted", at.alias("firsts")).select(*names, counted.alias("counted"))


def _starts(templates, squares, anchors, least: float):
    """``(term, k, q, n, least_terms, terms)``: an anchor's places in each template, the template's width in terms, and the fewest of its terms that a match has."""
    rows, texts = [], [t for ts in TEMPLATES.values() for t in ts]
    for k, _, ts, norm in templates:
        order = [m[0] for m in re.finditer(TERM, texts[k].lower())]
        rest, need = (least * norm) ** 2 * 0.999, 0
        for s in sorted((w * w * squares[t] for t, w in ts.items()), reverse=True):
            if rest > 0:
                rest, need = rest - s, need + 1
        rows += [(t, k, q, len(order), need, sorted(ts)) for q, t in enumerate(order) if t in anchors]
    return rows


#: Texts are searched for runs in segments of so many terms, which overlap by a template's width at both ends.
SEGMENT = 128


def _runs(some: DataFrame, starts: list) -> DataFrame:
    """``uid, line, run, terms`` of the runs of terms that may match: as wide as a template and
    laid over the text so that an anchor has the same place in both. ``line`` is that of the first term.

    Lines are numbered once for each text, and a row for an anchor carries its segment, never the text, so the work grows with the text's length.
    """
    spark, widest = some.sparkSession, max(width for *_, width, _, _ in starts)
    # comment marks that are words; others hold no term
    lines = F.transform(F.split("text", "\n"), lambda x: _found(F.regexp_replace(x, r"(?i)^[ \t]*(dnl|rem)(?=[ \t])", "")))
    by_line = some.select("uid", lines.alias("lines"))
    numbers = F.flatten(F.transform("lines", lambda ts, i: F.array_repeat(i + 1, F.size(ts))))
    flat = by_line.select("uid", F.flatten("lines").alias("all"), numbers.alias("numbers"))
    begin = lambda k: F.greatest(k * SEGMENT - widest, F.lit(0))
    part = lambda c, k: F.slice(c, begin(k) + 1, F.lit(SEGMENT + 2 * widest))
    each = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size("all") - 1, F.lit(0)) / SEGMENT).cast("int")), lambda k: F.struct(k.alias("segment"), begin(k).alias("begin"), part("all", k).alias("all"), part("numbers", k).alias("numbers")))
    # the array of segments is exploded, so that no row holds the whole text; the outer form, as for the other Spark pushes a filter on the array's size
    # below the steps before, which then work their columns out again for each element
    segments = flat.select("uid", each.alias("each")).select("uid", F.explode_outer("each").alias("x")).select("uid", "x.*")
    anchors = sorted({t for t, *_ in starts})
    # an anchor in the overlap is the next segment's
    here = F.filter(F.sequence(F.lit(0), F.greatest(F.size("all") - 1, F.lit(0))), lambda i: F.get("all", i).isin(anchors) & (F.floor((i + F.col("begin")) / SEGMENT) == F.col("segment")))
    at = segments.select("uid", "begin", "all", "numbers", here.alias("here")).select("uid", "begin", "all", "numbers", F.explode_outer("here").alias("pos")).filter("pos IS NOT NULL").withColumn("term", F.get("all", F.col("pos")))
    places = spark.createDataFrame(starts, "term string, k int, q int, width int, need int, ts array<string>")
    first = F.greatest(F.col("pos") - F.col("q"), F.lit(0))
    near = at.join(F.broadcast(places), "term").select("uid", (first + F.col("begin")).alias("first"), F.get("numbers", first).alias("line"), "width", "need", "ts", F.slice("all", first + 1, F.col("width")).alias("terms"))
    near = near.filter(F.size(F.array_intersect("terms", "ts")) >= F.col("need"))
    return near.select("uid", "line", (F.col("first").cast("long") * 1000 + F.col("width")).alias("run"), "terms").distinct()


def own_licences(files: DataFrame, least: float = LEAST) -> DataFrame:
    """``path, rk, licence, score, line, whole_score``: the best match of each file that has one.

    ``line``: number of the matching line from 1 on (of a run, that of its first term), or 0 for the whole text.
    ``whole_score``: that of the whole text, if it matches. The whole text of a licence comes before other matches.
    """
    spark = files.sparkSession
    templates, squares, other, anchors = _model(least)
    text = F.coalesce(F.col("text"), F.lit(""))
    near = "(^|[^a-z0-9])(" + "|".join(re.escape(a) for a in anchors) + r")([^a-z0-9]|\z)"  # a term can have no letter or digit beside it
    some = files.select(F.coalesce("path", F.lit(NO_PATH)).alias("path"), row_key("text").alias("rk"), text.alias("text")).filter(F.lower("text").rlike(near))
    some = cut(some).withColumn("uid", F.monotonically_increasing_id())  # searched once, for lines and for runs; a number keeps equal rows apart
    lines = some.select("uid", F.posexplode(F.concat(F.array("text"), F.split("text", "\n"))).alias("line", "unit"))
    units = lines.filter((F.col("line") == 0) | F.lower("unit").rlike(near)).select("uid", "line", F.lit(0).cast("long").alias("run"), _found(F.col("unit")).alias("terms"))
    runs = _runs(some, _starts(templates, squares, set(anchors), least))
    full, full_squares, full_other = _full_model()
    squared = lambda x: F.pow(1 + F.log(x["n"]), 2)
    total = lambda c, of: F.aggregate(c, F.lit(0.0), lambda a, x: a + of(x))
    known = lambda ws: F.filter("counted", lambda x: x["term"].isin(*ws))
    counted = _counted(units.unionByName(runs))
    counted = counted.select("uid", "line", "run", F.size("counted").cast("double").alias("sets"), total("counted", squared).alias("all_squares"), total(known(squares), squared).alias("known"), F.when(F.col("line") == 0, F.size(known(full_squares))).otherwise(0).alias("known_sets"), "counted")

    def fits(part: Column, all_: Column, ws: dict[str, float], unknown: float) -> Column:
        """A unit's cosine with any template is at most the share of the templates' terms in its norm; the heaviest ones bound it."""
        most = part * max(ws.values())
        # an expression that isn't deterministic keeps the filter above the steps before, which it would work out again for each element
        return F.when(F.monotonically_increasing_id() < 0, False).otherwise(most >= 0.999 * least**2 * (most + (all_ - part) * unknown))

    counted = counted.withColumns({"fits": fits(F.col("known"), F.col("all_squares"), squares, other), "fits_full": fits(F.col("known_sets"), F.col("sets"), full_squares, full_other) & (F.col("line") == 0)}).filter("fits OR fits_full")
    # the sums come first: beside the generator they would be worked out for each of its rows. Outer: see _runs
    words = counted.select("uid", "line", "run", "sets", "all_squares", "fits", "fits_full", F.explode_outer("counted").alias("x"))
    words = words.select("uid", "line", "run", "sets", "all_squares", "fits", "fits_full", "x.term", (1 + F.log("x.n")).alias("tf"))
    # the two kinds of templates have weights of their own; numbers of full texts come after the others'
    weigh = lambda rows, ws, of: [(t, w, [(k, of(ts, t)) for k, _, ts, _ in rows if t in ts]) for t, w in ws.items()]
    weights = [(t, w, ks, False) for t, w, ks in weigh(templates, squares, lambda ts, t: ts[t])] + [(t, w, ks, True) for t, w, ks in weigh(full, full_squares, lambda ts, t: 1.0)]
    weights = spark.createDataFrame(weights, "term string, square double, ks array<struct<k:int,w:double>>, full boolean")
    norms = spark.createDataFrame([(k, name, norm) for k, name, _, norm in templates + full], "k int, licence string, norm double")
    unit = ["uid", "line", "run", "full"]
    # both broadcast tables hold the fixed templates' terms only; the texts are read once for both sums below
    own = F.when(F.col("full"), 1.0).otherwise(F.col("tf"))  # of full texts the sets only
    able = F.when(F.col("full"), F.col("fits_full")).otherwise(F.col("fits"))
    hit = cut(words.join(F.broadcast(weights.drop("ks")), "term").filter(able).select(*unit, F.when(F.col("full"), F.col("sets")).otherwise(F.col("all_squares")).alias("all_squares"), own.alias("tf"), "square", "term"))
    rest = F.greatest(F.first("all_squares") - F.sum(F.col("tf") * F.col("tf")), F.lit(0.0))
    size = hit.groupBy(*unit).agg((F.sum(F.col("tf") * F.col("tf") * F.col("square")) + rest * F.when(F.col("full"), full_other).otherwise(other)).alias("square_norm"))
    dots = hit.join(F.broadcast(weights.drop("square")), ["term", "full"]).select(*unit, "tf", "square", F.explode("ks").alias("of")).groupBy(*unit, F.col("of.k").alias("k")).agg(F.sum(F.col("tf") * F.col("of.w") * F.col("square")).alias("dot"))
    scored = dots.join(size, unit).join(F.broadcast(norms), "k").withColumn("score", F.round(F.col("dot") / (F.sqrt("square_norm") * F.col("norm")), 6))
    best = F.max_by(F.struct("licence", "score", "line"), F.struct("full", "score", -F.col("k"), F.col("run") == 0, -F.col("line"))).alias("best")
    whole = F.max(F.when(F.col("line") == 0, F.col("score"))).alias("whole_score")
    found = scored.filter(F.col("score") >= least).join(some.select("uid", "path", "rk"), "uid")  # equal rows meet again here
    return found.groupBy("path", "rk").agg(best, whole).select(F.nullif("path", F.lit(NO_PATH)).alias("path"), "rk", "best.*", "whole_score")


def scan(files: DataFrame, least: float = LEAST) -> DataFrame:
    """One row for each row of ``files`` (path, text), all columns and licence, score, line, origin.

    ``origin``: 'own', 'inherited' (from the licence file in the nearest directory upwards) or 'none'.
    A licence file is one whose whole text matches a template, or one named LICENSE, LICENCE, COPYING,
    NOTICE or UNLICENSE (with any extension) that has a match; of a directory's several the best score counts, then
    the first path. Of a file's equal matches the first template counts, then a line before a run, then the first line. Null and empty
    texts match nothing but can inherit; a null path has no directory. Equal rows give equal results. Input
    columns of the four names are replaced, others pass through. An empty table gives an empty result.
    """
    files = files.drop("licence", "score", "line", "origin")
    own = cut(own_licences(files, least))
    directory, found, path, rk, own_path, own_rk, mine, file_dir, depth = fresh(files, "__dir", "__up", "__path", "__rk", "__own_path", "__own_rk", "__own", "__file_dir", "__depth")
    up = F.regexp_replace("path", "[^/]*$", "")
    named = F.upper(F.regexp_extract("path", "([^/]*)$", 1)).rlike(r"^(LICENSE|LICENCE|COPYING|NOTICE|UNLICENSE)([.]|\z)")
    declared = own.filter(F.col("path").isNotNull() & (F.col("whole_score").isNotNull() | named))
    dirs = declared.groupBy(up.alias(directory)).agg(F.min_by(F.struct("licence", "score"), F.struct(-F.col("score"), F.col("path"))).alias(found))
    base = files.withColumns({path: F.col("path"), rk: row_key("text")})
    matched = own.select(F.col("path").alias(own_path), F.col("rk").alias(own_rk), F.struct("licence", "score", "line").alias(mine))
    out = base.join(matched, F.col(path).eqNullSafe(F.col(own_path)) & (F.col(rk) == F.col(own_rk)), "left").drop(own_path, own_rk)
    # directories are joined once each, not once for each file
    paths = files.filter("path IS NOT NULL").select(up.alias(file_dir)).distinct()
    parts = F.split(file_dir, "/")
    ancestors = paths.select(file_dir, F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))))).alias(depth, directory))
    nearest = ancestors.join(dirs, directory).groupBy(file_dir).agg(F.max_by(found, depth).alias(found))
    # a directory may hold a third of all files
    out = spread_join(out.withColumn(file_dir, up), nearest, [file_dir], [path, rk], "left", keys_of=files.select(up.alias(file_dir)))
    pick = lambda c: F.coalesce(F.col(f"{mine}.{c}"), F.when(F.col(mine).isNull(), F.col(f"{found}.{c}")))
    origin = F.when(F.col(mine).isNotNull(), "own").when(F.col(found).isNotNull(), "inherited").otherwise("none")
    return out.select(*files.columns, pick("licence").alias("licence"), pick("score").alias("score"), F.col(f"{mine}.line").cast("long").alias("line"), origin.alias("origin"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id``."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return scan(files).select("doc_id", "path", "licence", "score", "line", "origin")


def _sql() -> str:
    templates, squares, other, _ = _model(LEAST)
    weights = ", ".join(f"('{t}', CAST({w!r} AS DOUBLE))" for t, w in squares.items())
    rows = ", ".join(f"({k}, '{name}', '{t}', CAST({w!r} AS DOUBLE), CAST({norm!r} AS DOUBLE))" for k, name, ts, norm in templates for t, w in ts.items())
    return rf"""
WITH f AS (SELECT doc_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, coalesce(text, '') AS text FROM documents),
weight(term, square) AS (VALUES {weights}),
template(k, licence, term, tw, norm) AS (VALUES {rows}),
u AS (SELECT doc_id, path, 0 AS line, text AS unit FROM f
      UNION ALL SELECT doc_id, path, generate_subscripts(str_split(text, chr(10)), 1), unnest(str_split(text, chr(10))) FROM f),
w AS (SELECT doc_id, path, line, term, 1 + ln(count(*)) AS tf
      FROM (SELECT doc_id, path, line, unnest(regexp_extract_all(lower(unit), '{TERM}')) AS term FROM u) GROUP BY ALL),
size AS (SELECT doc_id, path, line, sum(tf * tf * coalesce(square, CAST({other!r} AS DOUBLE))) AS sq FROM w LEFT JOIN weight USING (term) GROUP BY ALL),
dots AS (SELECT doc_id, path, line, k, licence, norm, sum(tf * tw * square) AS dot FROM w JOIN weight USING (term) JOIN template USING (term) GROUP BY ALL),
scored AS (SELECT doc_id, path, line, k, licence, round(dot / (sqrt(sq) * norm), 6) AS score FROM dots JOIN size USING (doc_id, path, line)),
good AS (SELECT * FROM scored WHERE score >= {LEAST}),
own AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k, line) = 1),
dirs AS (SELECT regexp_replace(path, '[^/]*$', '') AS dir, licence, score FROM own
         WHERE doc_id IN (SELECT doc_id FROM good WHERE line = 0)
         QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '[^/]*$', '') ORDER BY score DESC, path) = 1),
up AS (SELECT f.doc_id, dirs.licence, dirs.score FROM f JOIN dirs ON starts_with(f.path, dirs.dir)
       QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(dirs.dir) DESC) = 1)
SELECT f.doc_id, f.path, coalesce(own.licence, up.licence) AS licence, coalesce(own.score, up.score) AS score,
       CAST(own.line AS BIGINT) AS line,
       CASE WHEN own.doc_id IS NOT NULL THEN 'own' WHEN up.doc_id IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin
FROM f LEFT JOIN own USING (doc_id) LEFT JOIN up USING (doc_id)
"""


SQL = _sql()

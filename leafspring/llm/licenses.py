"""License notices in documents, by MinHash bands over overlapping windows.

DataFrame functions only. Templates fall into classes by length; a class has its
own window and stride, chosen so that every stretch of as many words as its
longest template lies wholly in some window. A band is one MinHash value of a
window's five-word shingles. If a window holds 0.8 of a template's shingles their
Jaccard similarity is at least 1/5 by the choice of windows (checked below), so
64 bands miss it with probability under 0.8^64 = 7e-7."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

SHINGLE, BANDS = 5, 64
CONTAIN = (4, 5)

# Standard notices as their owners publish them.
NOTICES = {
    "MIT-line": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-part": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Boost-1.0": "Distributed under the Boost Software License, Version 1.0.",
}


def notices() -> dict[str, str]:
    """All templates: the fixed ones, and the short lines that differ only in
    their terms and versions."""
    out = dict(NOTICES)
    for v in ("1.1", "2.0"):
        out[f"Apache-{v}-line"] = f"Licensed under the Apache License, Version {v}."
    for v in ("2", "3"):
        for name, words in (("GPL", "GNU General Public License"), ("LGPL", "GNU Lesser General Public License"), ("AGPL", "GNU Affero General Public License")):
            out[f"{name}-{v}-line"] = f"This work is licensed under the {words}, version {v}."
    for terms in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            out[f"CC-{terms}-{v}"] = f"Licensed under CC {terms} {v}."
    return out


def words_of_notice(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def shingles_of(words: list[str]) -> list[str]:
    n = max(1, len(words) - SHINGLE + 1)
    return list(dict.fromkeys(" ".join(words[i : i + SHINGLE]) for i in range(n)))


def window_class(n_words: int) -> tuple[int, int]:
    """(window, stride) in words for templates of n_words."""
    most = 8
    while most < n_words:
        most *= 2
    stride = max(1, most // 8)
    return most + stride - 1, stride


def template_table() -> list[tuple]:
    """(license, shingles, window, stride) of every template; those of fewer
    words than a shingle can't be used."""
    rows = []
    for name, text in notices().items():
        words = words_of_notice(text)
        if len(words) < SHINGLE:
            raise ValueError(f"template {name} is shorter than a shingle")
        rows.append((name, shingles_of(words), *window_class(len(words))))
    for name, shingles, window, _ in rows:
        least = -(-len(shingles) * CONTAIN[0] // CONTAIN[1])
        if least / (window - SHINGLE + 1 + len(shingles) - least) < 0.2:
            raise ValueError(f"template {name} is too short for its window")
    return rows


_MINHASH = f"transform(sequence(1, {BANDS}), k -> array_min(transform(shingles, s -> xxhash64(s, k))))"


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per (document, template) whose best window holds at least 0.8 of
    the template's distinct five-word shingles: doc_id, license, found (shingles
    in that window), total, first_word (its first word's number).

    Words are alphanumeric ASCII runs, lower-cased. Windows without any template
    shingle share no band with a template, so they are left out before bands are
    computed; the rest, a few words around a notice, are all that moves. Templates
    are a fixed list, so broadcasting them is bounded. Whole texts; null or empty
    texts hold nothing; rows that repeat an id give one result a template; ties
    between windows go to the first; other columns are not read."""
    spark = docs.sparkSession
    table = template_table()
    known = sorted({s for r in table for s in r[1]})
    templates = spark.createDataFrame(table, "license string, wanted array<string>, window int, stride int")
    hashed = [r[0] for r in spark.createDataFrame([(s,) for s in known], "s string").select(F.xxhash64(F.split("s", " "))).collect()]

    words = F.filter(F.split(F.lower(F.col(text_col)), "[^a-z0-9]+"), lambda w: w != "")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), words.alias("words"))
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (SHINGLE - 1)))
    hits = F.filter(at, lambda i: F.xxhash64(F.slice("words", i, SHINGLE)).isin(hashed))
    rows = rows.withColumn("hits", F.transform(hits, lambda i: i - 1))
    classes = sorted({(r[2], r[3]) for r in table})
    starts = [
        f"""transform(array_distinct(flatten(transform(hits, p -> sequence(
            int(greatest(0, p - {w - SHINGLE} + {s - 1}) div {s} * {s}), int(p div {s} * {s}), {s})))),
            x -> named_struct('window', {w}, 'stride', {s}, 'start', x))"""
        for w, s in classes
    ]
    windows = rows.select("doc_id", "words", F.explode(F.expr(f"case when size(hits) > 0 then concat({', '.join(starts)}) end")).alias("w"))
    cut = windows.select("doc_id", "w.window", "w.start", F.expr("slice(words, w.start + 1, w.window)").alias("words"))
    shingled = cut.select(
        "doc_id", "window", "start",
        F.expr(f"array_distinct(transform(sequence(1, greatest(1, size(words) - {SHINGLE - 1})), i -> array_join(slice(words, i, {SHINGLE}), ' ')))").alias("shingles"),
    )
    banded = shingled.select("doc_id", "window", "start", "shingles", F.posexplode(F.expr(_MINHASH)).alias("band", "value"))
    own = templates.select("license", "window", "wanted", F.col("wanted").alias("shingles")).select("license", "window", "wanted", F.posexplode(F.expr(_MINHASH)).alias("band", "value"))
    met = banded.join(F.broadcast(own), ["window", "band", "value"])
    found = F.size(F.array_intersect("shingles", "wanted"))
    checked = met.select("doc_id", "license", found.alias("found"), F.size("wanted").alias("total"), "start").where(f"{CONTAIN[1]} * found >= {CONTAIN[0]} * total")
    best = checked.groupBy("doc_id", "license").agg(F.max(F.struct("found", (-F.col("start")).alias("back"), "total")).alias("b"))
    return best.select("doc_id", "license", F.col("b.found").cast("long").alias("found"), F.col("b.total").cast("long").alias("total"), (-F.col("b.back")).cast("long").alias("first_word"))


def oracle_sql() -> str:
    """The same in DuckDB, without MinHash: windows counted shingle by shingle."""
    rows = ", ".join(f"('{name}', '{s}', {len(sh)}, {w}, {st})" for name, sh, w, st in template_table() for s in sh)
    return f"""
with t(license, shingle, total, win, stride) as (values {rows}),
d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') as words from documents where text is not null),
s as (select doc_id, unnest(range(0, greatest(1, len(words) - {SHINGLE - 1}))) as p, words from d),
h as (select s.doc_id, s.p, t.* from s join t on array_to_string(list_slice(s.words, s.p + 1, s.p + {SHINGLE}), ' ') = t.shingle),
w as (select doc_id, license, total, shingle, unnest(range((greatest(0, p - win + {SHINGLE} + stride - 1) // stride) * stride, (p // stride) * stride + 1, stride)) as start from h),
c as (select doc_id, license, total, start, count(distinct shingle) as found from w group by all),
b as (select *, row_number() over (partition by doc_id, license order by found desc, start) as rn from c where {CONTAIN[1]} * found >= {CONTAIN[0]} * total)
select doc_id, license, found::bigint as found, total::bigint as total, start::bigint as first_word from b where rn = 1
"""

"""License scans with DataFrame functions only: MinHash bands over overlapping windows, then exact containment.

A text is cut into words (lower case, at white space) and 5-word shingles.  Windows of a few words overlap
along it; a window's band keys are the least and the greatest of its shingle hashes under two hash functions,
each of which two windows of Jaccard J share with probability J.  Templates give the keys of their windows at
every offset, so a window that lies in a verbatim copy of a template meets it in every band; with four bands a
window of Jaccard 0.7 is found with probability 0.99, and a copy holds many windows.  Templates too short for
a long window use shorter ones, down to one shingle.  What a text's keys retrieve is verified: at least
``percent`` of the template's distinct shingles must be in the text.

All of it is one projection without a shuffle; templates are a small, fixed list (``MAX_TEMPLATES``), whose
keys are literals of the plan.  Null and empty texts, and texts of fewer than five words, match nothing.
Repeated rows get equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
#: (words of a window, words between windows); a template uses the longest that a copy surely holds.
WINDOWS = ((16, 8), (8, 4))
MAX_TEMPLATES = 1000

# Notices by which licenses are named or granted.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(found: Column) -> Column:
    """Hashes of the 5-word shingles of an array of words, in order."""
    starts = F.when(F.size(found) >= SHINGLE, F.sequence(F.lit(0), F.size(found) - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*(F.get(found, i + k) for k in range(SHINGLE))))


def bands(hashes: Column, window: int, step: int) -> Column:
    """The band keys of all windows; none if the text is shorter than one."""
    size = window - SHINGLE + 1
    starts = F.when(F.size(hashes) >= size, F.sequence(F.lit(1), F.size(hashes) - size + 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    other = F.transform(hashes, lambda h: F.xxhash64(h, F.lit(window)))
    two = lambda x: lambda i: let(F.slice(x, i, size), lambda s: F.array(F.array_min(s), F.array_max(s)))
    return F.concat(F.flatten(F.transform(starts, two(hashes))), let(other, lambda o: F.flatten(F.transform(starts, two(o)))))


def _window_of(n_words: int) -> int:
    return next((w for w, step in WINDOWS if n_words >= w + step - 1), SHINGLE)


def prepared(spark: SparkSession, templates: dict[str, str]) -> list[tuple[str, int, list[int], list[int]]]:
    """(name, words of its windows, distinct shingles, band keys at every offset) of each template with a shingle."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    df = spark.createDataFrame(sorted(templates.items()), "name string, text string").select("name", words(F.col("text")).alias("w")).select("name", "w", shingles(F.col("w")).alias("s"))
    keys = {w: F.array_distinct(bands(F.col("s"), w, 1)) for w, _ in WINDOWS}
    rows = df.select("name", F.size("w").alias("n"), F.array_distinct("s").alias("s"), *(k.alias(f"k{w}") for w, k in keys.items())).collect()
    return [(r["name"], w := _window_of(r["n"]), r["s"], r["s"] if w == SHINGLE else r[f"k{w}"]) for r in rows if r["s"]]


def scan(df: DataFrame, templates: dict[str, str] | None = None, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, licenses array<string> (names, ascending)."""
    known = prepared(df.sparkSession, TEMPLATES if templates is None else templates)
    used = {w for _, w, _, _ in known}
    longs = lambda values: F.lit([int(v) for v in values]).cast("array<bigint>")
    every = longs(sorted({k for *_, keys in known for k in keys}))

    def keys_of(s: Column) -> Column:
        parts = [s] if SHINGLE in used else []
        return F.concat(*parts, *(bands(s, w, step) for w, step in WINDOWS if w in used)) if used else F.array().cast("array<bigint>")

    def verdict(s: Column, keys: Column) -> Column:
        each = [F.when(F.arrays_overlap(keys, longs(k)) & (F.size(F.array_intersect(longs(t), s)) * 100 >= percent * len(t)), F.lit(name)) for name, _, t, k in known]
        return F.when(F.arrays_overlap(keys, every), F.array_compact(F.array(*each))).otherwise(F.array().cast("array<string>"))

    found = let(F.col("w"), lambda w: let(shingles(w), lambda s: let(keys_of(s), lambda k: verdict(s, k)))) if known else F.array().cast("array<string>")
    cut = df.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    return cut.select("doc_id", F.size("w").cast("long").alias("n_words"), found.alias("licenses"))


def oracle(templates: dict[str, str] | None = None, percent: int = 80) -> str:
    """The same by exact containment of every template in every document, as SQL."""
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted((TEMPLATES if templates is None else templates).items()))
    cut = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    grams = "list_distinct(list_transform(range(1, greatest(len({0}) - 3, 1)), lambda i: list_aggregate({0}[i:i+4], 'string_agg', ' ')))"
    return f"""
WITH t(name, text) AS (VALUES {rows}),
     tw AS (SELECT name, {cut.format('text')} AS w FROM t),
     ts AS (SELECT name, {grams.format('w')} AS s FROM tw),
     dw AS (SELECT row_number() OVER () AS r, doc_id, {cut.format('text')} AS w FROM documents),
     ds AS (SELECT r, unnest({grams.format('w')}) AS g FROM dw),
     tg AS (SELECT name, len(s) AS n, unnest(s) AS g FROM ts),
     hit AS (SELECT r, name FROM ds JOIN tg USING (g) GROUP BY r, name, n HAVING count(*) * 100 >= {percent} * n)
SELECT dw.doc_id, CAST(len(any_value(dw.w)) AS BIGINT) AS n_words,
       coalesce(string_agg(hit.name, ',' ORDER BY hit.name), '') AS licenses
FROM dw LEFT JOIN hit USING (r) GROUP BY dw.r, dw.doc_id"""

"""License notices in documents: winnowed template fingerprints pick candidates, alignment finds spans."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsmith.llm.base import query, table
from gridsmith.llm.kernels import banded_alignment, chain_band, gram_chains, token_spans
from gridsmith.session import staged

GRAM = 3
WINDOW = 3  # any shared run of WINDOW + GRAM - 1 words holds a fingerprint
BAND = 6
COVERAGE = 0.8

# Customary notices of public licenses.
TEMPLATES = {
    "agpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version."),
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "bsd-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:"),
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "lgpl-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at "
        "your option) any later version."),
    "mit-line": "Released under the MIT License.",
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so."),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
}


def gram_hashes(word_array: Column) -> Column:
    """One hash per run of GRAM words, in order; none for shorter texts."""
    hashed = F.transform(word_array, lambda w: F.xxhash64(F.lower(w)))
    n = F.size(word_array) - GRAM
    starts = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    # The words are hashed once, before the runs.
    return F.transform(F.array(hashed), lambda h: F.transform(
        starts, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(GRAM)])))[0]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def inverted_index(spark: SparkSession, templates: Mapping[str, str]) -> DataFrame:
    """``h, template, at``: of every window of neighbouring template grams the one of least hash.

    Templates are a parameter of the job; their fingerprints are a staged table whose size Spark
    knows, so it is broadcast only while it is small.
    """
    short = [name for name, text in templates.items() if len(token_spans(text)[0]) < GRAM + WINDOW - 1]
    if short:
        raise ValueError(f"templates of fewer than {GRAM + WINDOW - 1} words: {short}")
    rows = spark.createDataFrame([(k, v) for k, v in sorted(templates.items())], "template string, text string")
    grams = rows.select("template", F.posexplode(gram_hashes(tokens(F.col("text")))).alias("at", "h"))
    lists = grams.groupBy("template").agg(F.array_sort(F.collect_list(F.struct("at", "h"))).alias("g"))
    first = F.sequence(F.lit(0), F.size("g") - WINDOW)
    pick = F.transform(first, lambda i: F.array_min(F.transform(
        F.slice("g", i + 1, WINDOW), lambda x: F.struct(x["h"].alias("h"), x["at"].alias("at")))))
    return staged(lists.select("template", F.explode(F.array_distinct(pick)).alias("p")).select(
        "p.h", "template", "p.at"), "license-index")


def scan(docs: DataFrame, templates: Mapping[str, str] | None = None, coverage: float = COVERAGE,
         band: int = BAND, every: bool = False) -> DataFrame:
    """``docs`` with ``template, matched, length, coverage, span_start, span_end`` per notice found.

    ``matched`` of the template's ``length`` words stand in order in the text between the code
    points ``span_start`` and ``span_end``; each place with at least ``coverage`` is a row. Every
    run of GRAM words of whole texts is looked up in the index, so no shared run of
    GRAM + WINDOW - 1 words is missed. Shared runs are chained and the alignment follows the chain:
    between two of them a copy may have ``band`` words more or fewer, in all as many as it likes. Places of
    one template share no words. Where places of different templates do, the one with the most
    matched words is the notice (then the better covered, then the first name); ``every`` gives all.
    Equal texts are aligned on the same hits, found once.
    NULL and empty texts hold nothing; repeated rows give repeated results; other columns stay,
    but for those that the result names.
    """
    spark = docs.sparkSession
    templates = dict(TEMPLATES if templates is None else templates)
    index = inverted_index(spark, templates)
    keys = [F.xxhash64("text").alias("_t1"), F.xxhash64(F.lit(1), "text").alias("_t2")]
    probes = docs.where("text IS NOT NULL").select(*keys, F.posexplode(gram_hashes(tokens(F.col("text")))).alias("place", "h"))
    hits = probes.join(index, "h").groupBy("_t1", "_t2").agg(
        F.collect_set(F.struct("template", "place", "at")).alias("_hits"))
    words = {name: token_spans(text)[0] for name, text in templates.items()}
    found = T.ArrayType(T.StructType([
        T.StructField("template", T.StringType()), T.StructField("matched", T.IntegerType()),
        T.StructField("length", T.IntegerType()), T.StructField("coverage", T.DoubleType()),
        T.StructField("span_start", T.IntegerType()), T.StructField("span_end", T.IntegerType())]))
    names = [f.name for f in found.elementType.fields]

    @F.arrow_udf(found)
    def align(texts: pa.Array, hit_lists: pa.Array) -> pa.Array:
        out = []
        for text, hit_list in zip(texts, hit_lists, strict=True):
            here, starts, ends = token_spans(text.as_py())
            places = notices(here, hit_list.as_py(), words, coverage, band)
            if not every:
                places = without_overlap(places, words)
            rows = sorted((starts[first], name, ends[last], n) for name, n, first, last in places)
            out.append([dict(zip(names, (name, n, len(words[name]), n / len(words[name]), start, end), strict=True))
                        for start, name, end, n in rows])
        return pa.array(out, pa.list_(pa.struct([
            ("template", pa.string()), ("matched", pa.int32()), ("length", pa.int32()), ("coverage", pa.float64()),
            ("span_start", pa.int32()), ("span_end", pa.int32())])))

    rest = [c for c in docs.columns if c not in names]
    rows = docs.select(F.struct(*rest).alias("doc"), "text", *keys).join(staged(hits, "license-hits"), ["_t1", "_t2"])
    return rows.select("doc", F.explode(align("text", "_hits")).alias("found")).select("doc.*", "found.*")


def notices(here: list[str], hits: list[dict], words: Mapping[str, list[str]], coverage: float,
            band: int) -> list[tuple[str, int, int, int]]:
    """``(template, matched, first, last)`` of a text's words: each chain aligned to the words not matched before."""
    grouped: dict[str, list[tuple[int, int]]] = {}
    for hit in hits:
        grouped.setdefault(hit["template"], []).append((hit["place"], hit["at"]))
    out = []
    for name in sorted(grouped):
        left: list[str | None] = here
        for chain in gram_chains(grouped[name], band):
            n, first, last = banded_alignment(words[name], left, *chain_band(chain, len(words[name]), band))
            if n and n >= coverage * len(words[name]):
                out.append((name, n, first, last))
                left = here[:] if left is here else left
                left[first:last + 1] = [None] * (last + 1 - first)
    return out


def without_overlap(places: list[tuple[str, int, int, int]], words: Mapping[str, list[str]]) -> list[tuple[str, int, int, int]]:
    """Of places that share words of the text the one with the most matched words."""
    held: set[int] = set()
    out = []
    for place in sorted(places, key=lambda p: (-p[1], -p[1] / len(words[p[0]]), p)):
        own = range(place[2], place[3] + 1)
        if held.isdisjoint(own):
            held.update(own)
            out.append(place)
    return out


@query("op4_license_scan")
def op4_license_scan(spark, sf_dir):
    """License notices held by documents, with matched words and spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).drop("text")

"""License scan: MinHash bands over overlapping windows, then exact containment.

Semantics.  A template of L words has the set T of its word 3-grams (shingles, see textcore).
The containment of a template in a document is the greatest share of T that occurs within
L consecutive words of the document.  A row (doc_id, license, containment, word) reports each
containment of at least ``CONTAINMENT``, with the first place (in words, from 0) of a window
that has it and begins with a shingle of T.

Retrieval.  Templates of more than m/2 and at most m shingles (m a power of two) are sought in
windows of 3m/2 shingles that begin every m/2, so every run of m shingles lies whole in a
window.  A window that holds the share c of T has a Jaccard similarity of at least c/(4-c)
with T (less than m/2 * c over 2m - m/2 * c, at worst), and the number of bands, of one row each, is chosen so that such a window shares
a band with probability ``RECALL``.  Window minima of all sizes come from one pyramid of
block minima for each hash function.  Documents with a candidate are then measured exactly.

Cases.  Null and empty texts and texts of fewer than three words match nothing.  Rows with a
null doc_id are scanned and reported under null.  Repeated doc_ids give one row for each
license, the greatest containment (ties: least word).  Templates need three words or more.
Other columns are not read.  Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .common import table

SHINGLE = 3
CONTAINMENT = 0.8
RECALL = 0.9999
U64 = np.uint64

TEMPLATES = {
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense-notice": "This is free and unencumbered software released into the public domain.",
}


def bands_for(containment: float, recall: float) -> int:
    """Bands of one row that a window with so much of a template shares one of with the given probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - containment / (4 - containment))))


class Index:
    """Shingles of the templates and their minima by window size and hash function."""

    def __init__(self, templates: dict[str, str], containment: float = CONTAINMENT, recall: float = RECALL):
        self.names, self.least = list(templates), containment
        w = tc.Words(list(templates.values()))
        self.size = np.diff(w.bound)
        if len(self.size) and self.size.min() < SHINGLE:
            raise ValueError("a template needs three words or more")
        grams = [tc.ngram_hashes(w.hash[a:z], SHINGLE) for a, z in zip(w.bound, w.bound[1:])]
        self.sets = [np.unique(g) for g in grams]
        self.all = np.unique(np.concatenate(grams)) if grams else np.zeros(0, U64)
        self.level = [max(0, (len(s) - 1).bit_length() - 1) for s in self.sets]  # blocks of 2**level shingles, m two of them
        bands = bands_for(containment, recall)
        g = np.random.default_rng(41)
        self.a = g.integers(0, 2**32, bands, dtype=np.uint32) | np.uint32(1)
        self.b = g.integers(0, 2**32, bands, dtype=np.uint32)
        self.low = [[int(((s >> U64(32)).astype(np.uint32) * a + b).min()) for s in self.sets] for a, b in zip(self.a, self.b)]

    def candidates(self, grams: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """(texts, templates) matrix of who shares a band somewhere."""
        texts, top = len(bound) - 1, max(self.level, default=0)
        found = np.zeros((texts, len(self.names)), bool)
        per = np.diff(bound)
        if not len(grams):
            return found
        unit = 1 << top
        room = (per + unit - 1) // unit * unit
        edge = np.concatenate(([0], np.cumsum(room)))
        place = np.arange(len(grams)) + np.repeat(edge[:-1] - bound[:-1], per)
        half = (grams >> U64(32)).astype(np.uint32)
        owner = np.repeat(np.arange(texts), room // unit)
        owners = [np.repeat(owner, unit >> k) for k in range(top + 1)]
        blank = np.uint32(0xFFFFFFFF)
        for a, b, low in zip(self.a, self.b, self.low):
            level = np.full(int(edge[-1]), blank, np.uint32)
            level[place] = half * a + b
            for k in range(top + 1):
                if k:
                    level = np.minimum(level[::2], level[1::2])
                mine = [i for i, own in enumerate(self.level) if own == k]
                if not mine:
                    continue
                o = owners[k]
                for i in mine:  # a window's minimum is one of its blocks' minima
                    at = np.flatnonzero(level == np.uint32(low[i]))
                    for first in (at, at - 1, at - 2):
                        first = np.maximum(first, 0)
                        window = level[first]
                        for step in (1, 2):
                            nxt = np.minimum(first + step, len(level) - 1)
                            window = np.minimum(window, np.where(o[nxt] == o[first], level[nxt], blank))
                        found[o[first[(window == np.uint32(low[i])) & (o[first] == o[at])]], i] = True
        return found

    def measure(self, grams: np.ndarray, i: int) -> tuple[float, int]:
        """Exact containment of template i in a text's shingles, and where."""
        own, span = self.sets[i], int(self.size[i]) - SHINGLE + 1
        at = np.searchsorted(own, grams)
        at[at == len(own)] = 0
        pos = np.flatnonzero(own[at] == grams)
        kind = at[pos].tolist()
        count = [0] * len(own)
        best, where, many, right = 0, -1, 0, 0
        place = pos.tolist()
        for left, p in enumerate(place):
            while right < len(place) and place[right] < p + span:
                many += count[kind[right]] == 0
                count[kind[right]] += 1
                right += 1
            if many > best:
                best, where = many, p
            count[kind[left]] -= 1
            many -= count[kind[left]] == 0
        return best / len(own), where


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, recall: float = RECALL) -> DataFrame:
    """(doc_id, license, containment, word): see the module's text."""
    sent = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates, containment, recall))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for part, texts in tc.batches(it):
            w = tc.Words(texts)
            per = np.maximum(np.diff(w.bound) - SHINGLE + 1, 0)
            bound = np.concatenate(([0], np.cumsum(per)))
            grams = tc.ngram_hashes(w.hash, SHINGLE)
            shift = w.bound[:-1] - bound[:-1]
            grams = grams[np.arange(bound[-1]) + np.repeat(shift, per)]
            rows = []
            for d, i in zip(*np.nonzero(index.candidates(grams, bound))):
                share, where = index.measure(grams[bound[d] : bound[d + 1]], i)
                if share >= index.least:
                    rows.append((int(d), index.names[i], round(share, 6), where))
            if rows:
                d, name, share, where = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), pa.array(name), pa.array(share), pa.array(where, pa.int32())], ["doc_id", "license", "containment", "word"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = slim.mapInArrow(run, "doc_id long, license string, containment double, word int")
    best = F.max(F.struct("containment", (-F.col("word")).alias("w"))).alias("x")
    return found.groupBy("doc_id", "license").agg(best).select("doc_id", "license", "x.containment", (-F.col("x.w")).alias("word"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


_TOK = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
SQL = rf"""
WITH t AS (SELECT license, {_TOK} AS w FROM (VALUES {_VALUES}) AS v(license, text)),
ts AS (SELECT DISTINCT license, len(w) - {SHINGLE - 1} AS span, unnest(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) AS g FROM t),
tn AS (SELECT license, count(*) AS n FROM ts GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, {_TOK} AS w FROM documents),
dg AS (SELECT r, doc_id, list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) AS gs FROM d WHERE len(w) >= {SHINGLE}),
ds AS (SELECT r, doc_id, unnest(gs) AS g, generate_subscripts(gs, 1) - 1 AS p FROM dg),
hit AS (SELECT r, doc_id, license, span, p, ts.g FROM ds JOIN ts ON ds.g = ts.g),
win AS (SELECT a.r, a.doc_id, a.license, a.p, count(DISTINCT b.g) AS c FROM hit a JOIN hit b ON a.r = b.r AND a.license = b.license AND b.p >= a.p AND b.p < a.p + a.span GROUP BY ALL),
best AS (SELECT doc_id, win.license, c / n AS share, p, row_number() OVER (PARTITION BY doc_id, win.license ORDER BY c DESC, p) AS k FROM win JOIN tn ON win.license = tn.license WHERE c / n >= {CONTAINMENT})
SELECT doc_id, license, round(share, 6) AS containment, p AS word FROM best WHERE k = 1
"""

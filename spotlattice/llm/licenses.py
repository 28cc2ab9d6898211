"""Operator 2, license scans: MinHash bands over overlapping windows retrieve templates.

A template is found in a text when 75 % or more of its distinct shingles are in
it. Words are runs of ASCII letters, digits and other code points beyond ASCII, so
punctuation does not matter. Shingles have five words; a shorter template has
one of all its words, and texts are cut into shingles of that length for it.

Templates are partitioned by their number of shingles; for a class of ``2^c`` to
``2^(c+1) - 1`` a text becomes windows of ``4 * 2^c`` shingles that start every
``2 * 2^c``, so a license passage lies whole in one of them, with a Jaccard
similarity to its template of ``3/17`` at least. ``BANDS`` bands of one row
each collide with probability ``1 - (14/17)^64``, above 0.99999. The sorted MinHash
values of a band are its index: a window looks its own value up among those of all
templates of the class, so the cost grows with the logarithm of their number. The
templates retrieved are verified by exact containment in the text. (The bound holds for a
passage in one piece; shingles scattered over a text that is far longer than the template
may fall in windows of too little similarity.)

The templates are a query set of the caller, a dictionary or a table of names and texts,
whole license texts if wanted; they are sent with the tasks. Texts are read in place,
without a shuffle.

Defined cases: null and wordless texts hold no license; very long texts are read whole;
repeated rows are judged alike; several licenses are joined in alphabetical order; two
templates of one text are both found; an empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlattice.llm.common import SHINGLE, shingle_sets, shingles, table

# License lines and the opening words of public license texts.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-header": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
}

BANDS = 64
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SEEDS = np.random.default_rng(20240229).integers(1, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _words(text: str) -> int:
    (_, found, _), = shingles(pa.array([text]), 1, _IS_WORD)
    return len(found)


class Index:
    """Templates by shingle length and size class, with their MinHash values by band."""

    def __init__(self, templates: dict[str, str]):
        #: by shingle length: the sets of the templates, and by size class their names and, for each band, sorted values and owners
        self.sets: dict[int, dict[str, np.ndarray]] = {}
        self.classes: dict[int, dict[int, tuple[list[str], np.ndarray, np.ndarray]]] = {}
        members: dict[tuple[int, int], list[tuple[str, np.ndarray]]] = {}
        for name, text in sorted(templates.items()):
            k = min(SHINGLE, _words(text))
            if k == 0:
                raise ValueError(f"template {name!r} has no words")
            ((_, s),) = shingle_sets(pa.array([text]), k, _IS_WORD)
            self.sets.setdefault(k, {})[name] = s
            members.setdefault((k, int(np.log2(len(s)))), []).append((name, np.min(s[None, :] * _SEEDS[:, None], axis=1)))
        for (k, c), some in members.items():
            mins = np.stack([m for _, m in some])
            owner = np.argsort(mins, axis=0, kind="stable")
            self.classes.setdefault(k, {})[c] = [n for n, _ in some], np.take_along_axis(mins, owner, 0).T.copy(), owner.T

    def candidates(self, k: int, hashes: np.ndarray, counts: np.ndarray) -> set[tuple[int, str]]:
        """(text, template) pairs that collide in a band of a window; ``hashes`` in text order."""
        out: set[tuple[int, str]] = set()
        if not len(hashes):
            return out
        place = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
        text = np.repeat(np.arange(len(counts)), counts)
        for c, (names, keys, owners) in self.classes[k].items():
            edge = np.flatnonzero(place % (2 << c) == 0)  # blocks of half a window; a block never crosses texts
            joined = np.concatenate([text[edge[1:]] == text[edge[:-1]], [False]])
            for band, seed in enumerate(_SEEDS):
                low = np.minimum.reduceat(hashes * seed, edge)
                window = np.where(joined, np.minimum(low, np.append(low[1:], low[-1])), low)
                first = np.searchsorted(keys[band], window, "left")
                hit = np.flatnonzero((first < len(names)) & (keys[band][np.minimum(first, len(names) - 1)] == window))
                last = np.searchsorted(keys[band], window[hit], "right")
                for t, low, high in zip(text[edge[hit]].tolist(), first[hit].tolist(), last.tolist(), strict=True):
                    out |= {(t, names[i]) for i in owners[band, low:high].tolist()}
        return out


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame = TEMPLATES, share: float = 0.75) -> DataFrame:
    """Per row: doc_id, licenses (names, comma-joined), n_licenses, n_common (shingles shared with them in all).

    ``templates`` maps names to texts, or is a table ``(name, text)`` of the same.
    """
    percent = round(100 * share)
    if isinstance(templates, DataFrame):
        templates = {r.name: r.text for r in templates.select("name", "text").collect()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            names: list[list[tuple[str, int]]] = [[] for _ in range(batch.num_rows)]
            for k, sets in index.sets.items():
                for row, hashes, counts in shingles(batch.column(1), k, _IS_WORD):
                    ends = np.cumsum(counts)
                    for t, name in index.candidates(k, hashes, counts):
                        s = sets[name]
                        common = int(np.isin(s, hashes[ends[t] - counts[t] : ends[t]]).sum())
                        if 100 * common >= percent * len(s):
                            names[row + t].append((name, common))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([",".join(sorted(n for n, _ in x)) for x in names], pa.string()),
                    pa.array([len(x) for x in names], pa.int64()),
                    pa.array([sum(c for _, c in x) for x in names], pa.int64()),
                ],
                ["doc_id", "licenses", "n_licenses", "n_common"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, licenses string, n_licenses long, n_common long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(TEMPLATES.items()))
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH t AS (SELECT name, w, least({SHINGLE}, len(w)) AS k FROM (SELECT name, {words} AS w FROM (VALUES {values}) AS v(name, text))),
ts AS (SELECT DISTINCT name, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM t)),
n AS (SELECT name, count(*) AS n FROM ts GROUP BY name),
d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
ds AS (SELECT DISTINCT r, k, array_to_string(w[i:i + least(k, len(w)) - 1], ' ') AS s
  FROM (SELECT r, w, k, unnest(range(1, greatest(2, len(w) - k + 2))) AS i FROM d, (SELECT DISTINCT k FROM t) WHERE len(w) > 0)),
m AS (SELECT r, name, count(*) AS common FROM ds JOIN ts USING (k, s) JOIN n USING (name) GROUP BY r, name HAVING 100 * count(*) >= 75 * any_value(n.n))
SELECT doc_id, coalesce(string_agg(name, ',' ORDER BY name), '') AS licenses, count(name)::BIGINT AS n_licenses, coalesce(sum(common), 0)::BIGINT AS n_common
FROM d LEFT JOIN m USING (r) GROUP BY r, doc_id"""


QUERIES = {"op2_license_scan": query}
SQL = {"op2_license_scan": oracle()}

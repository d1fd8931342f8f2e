"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment confirms them.

A window is a quarter longer than a template and begins every quarter of its length, so an
occurrence lies whole inside one. With at least ``containment`` of a template inside, the
similarity of window and template is at least c / (9/4 - c), and the bands are set for that:
two rows, as many bands as the wanted recall needs. Only windows that hold a template's
shingle at all are looked at, which loses none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import text_bytes
from keelson.llm.shingles import FOLD, Members, mix, randoms, shingle_hashes, word_hashes

# fixed values: public license notices and the opening words of license texts
TEMPLATES: dict[str, str] = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT notice": "Released under the MIT License.",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "BSD text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ISC text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense text": "This is free and unencumbered software released into the public domain.",
}


@dataclass(frozen=True)
class Settings:
    """Words of a shingle, share of a template's shingles that must occur, wanted recall of the bands."""

    words: int = 3
    containment: float = 0.8
    recall: float = 0.9999
    rows: int = 2

    @property
    def least_similarity(self) -> float:
        return self.containment / (2.25 - self.containment)

    @property
    def bands(self) -> int:
        return ceil(log(1 - self.recall) / log(1 - self.least_similarity**self.rows))


class Scanner:
    """Templates indexed by band keys; ``scan`` gives the matches of one text."""

    def __init__(self, templates: dict[str, str], s: Settings) -> None:
        self.s = s
        self.factors = randoms(s.bands * s.rows, 31) | np.uint64(1)
        self.shifts = randoms(s.bands * s.rows, 32)
        self.names: list[str] = []
        self.sets: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.keys: dict[int, dict[int, list[int]]] = {}
        for name, text in sorted(templates.items()):
            words = word_hashes(text.encode(), FOLD)[0]
            shingles = np.unique(shingle_hashes(words, s.words))
            if len(shingles):
                t = len(self.names)
                self.names.append(name)
                self.sets.append(shingles)
                self.lengths.append(len(words))
                for key in self.band_keys(shingles):
                    self.keys.setdefault(len(words), {}).setdefault(key, []).append(t)
        self.members = Members(np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64))

    def band_keys(self, shingles: np.ndarray) -> list[int]:
        best = (shingles[:, None] * self.factors + self.shifts).min(axis=0).reshape(self.s.bands, self.s.rows)
        keys = np.arange(self.s.bands, dtype=np.uint64)
        for column in best.T:
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) ^ column)
        return keys.tolist()

    def scan(self, text: bytes) -> list[tuple[int, int, int, float]]:
        """(template, first byte, end byte, containment) of each match, one per place."""
        words, starts, ends = word_hashes(text, FOLD)
        k = self.s.words
        shingles = shingle_hashes(words, k)
        near = self.members.positions(shingles)
        if not len(near):
            return []
        found: dict[tuple[int, int], tuple[int, int, int, float]] = {}
        for n, table in self.keys.items():
            step = max(1, n // 4)
            width = n + step
            # every window that covers one of the positions
            firsts = np.unique(np.concatenate([(near // step - j) * step for j in range(-(-width // step) + 1)]))
            firsts = firsts[(firsts >= 0) & (firsts < len(shingles))]
            for first in firsts.tolist():
                window = shingles[first : first + max(1, width - k + 1)]
                distinct = np.unique(window)
                candidates = {t for key in self.band_keys(distinct) for t in table.get(key, ())}
                for t in candidates:
                    share = float(np.isin(self.sets[t], distinct, assume_unique=True).mean())
                    if share >= self.s.containment:
                        inside = np.flatnonzero(np.isin(window, self.sets[t]))
                        a, b = first + int(inside[0]), first + int(inside[-1]) + k - 1
                        match = (t, int(starts[a]), int(ends[b]), share)
                        old = found.get((t, a))
                        if old is None or old[3] < share:
                            found[t, a] = match
        # of overlapping matches of one template the fullest stays
        kept: list[tuple[int, int, int, float]] = []
        for match in sorted(found.values(), key=lambda m: (m[0], -m[3], m[1])):
            if not any(m[0] == match[0] and m[1] < match[2] and match[1] < m[2] for m in kept):
                kept.append(match)
        return sorted(kept, key=lambda m: (m[1], m[0]))


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per match: id, ``license``, ``start``, ``end`` (bytes in the UTF-8 text), ``containment``.

    Words are folded to lower case and ASCII punctuation separates them. A template of fewer than
    three words is not searched. Documents without a match, null and empty texts give no row;
    repeated rows give their matches each; a null id stays null; an empty table gives an empty
    result; other columns are not read. Templates are a list kept by hand and travel with the tasks.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, settings)
        for batch in batches:
            out = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                out += [(row, scanner.names[t], a, b, share) for t, a, b, share in scanner.scan(text)]
            at, *rest = list(zip(*out)) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(rest, kinds))],
                ["id", "license", "start", "end", "containment"],
            )

    return rows.mapInArrow(run, f"id {kind}, license string, start long, end long, containment double").withColumnRenamed("id", id_col)

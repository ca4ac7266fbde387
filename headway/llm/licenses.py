"""Licence scanning: a trained paragraph classifier, confirmed by templates.

A paragraph is a run of lines that hold words, so comment marks, wrapping and blank comment lines do not matter.  Each
line and, in paragraphs of several lines, each stretch of ``SPAN`` words that begins ``STEP`` after the last is turned
into hashed word 1- to 3-grams.  A sparse multinomial logistic regression knows each licence family and the class of
other text; its confidences are calibrated on held-out paragraphs by one temperature.  Where it sees a licence, the
words around are laid against the family's templates, and the best place is classified again by itself: a family counts
where both are sure; where the calibrated class of other text is unlikely and a template matches by half only, the
licence is unknown.

Training takes the templates below, altered by a seeded generator, against a bounded sample of the corpus's own lines,
in one task; scoring reads every paragraph of every text in one pass without a shuffle, by arrays.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import released, slices

#: SPDX identifier of the family, and its usual notices.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "MIT": ["Released under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "Proprietary": ["All rights reserved.", "Copyright 2020. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
}
OTHER = "other"
#: Sentences that speak of licences without giving one.
NEAR_MISSES = ["The driver lost his license after the accident.", "A fishing license is required in this area.", "The public library is free for everyone.", "The license of the pub was renewed for another year.", "Version 3 of the software was released in general.", "General terms of the public work are under review.", "Copyright law is a difficult subject.", "She licensed the song to a film studio.", "No rights were reserved for the public."]
BUCKETS = 1 << 16
#: Words of a stretch, and from the start of one to that of the next.
SPAN, STEP = 48, 24
#: A stretch of which the classifier gives less to all families together is not looked at again.
GLANCE = 0.05
_WORD = re.compile(r"[^\W_]+")
_BREAK = r"[^\pL\pN]+"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def words(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def _hashes(found: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in found), np.uint64, len(found))


def _buckets(h: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each word."""
    m = max(len(h) - n + 1, 0)
    total = np.full(m, n, np.uint64)
    for k in range(n):
        total += h[k : m + k] * _ODD[k]
    total = (total ^ (total >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((total ^ (total >> np.uint64(29))) & np.uint64(buckets - 1)).astype(np.int64)


def grams(found: list[str], buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of a paragraph's word 1- to 3-grams; repeats count."""
    h = _hashes(found)
    return np.concatenate([_buckets(h, n, buckets) for n in (1, 2, 3)])


@dataclass
class Model:
    families: list[str]
    weights: np.ndarray  # buckets x classes
    bias: np.ndarray
    temperature: float = 1.0

    def chances(self, found: list[str]) -> np.ndarray:
        at = grams(found, len(self.weights))
        return self._softmax(self.weights[at].sum(0)[None], np.array([len(at)]))[0]

    def _softmax(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = (self.bias + sums / np.sqrt(np.maximum(n, 1))[:, None]) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _altered(rng: random.Random, found: list[str], filler: list[str]) -> list[str]:
    """A paragraph as it may occur: some words lost or replaced, some text around it."""
    out = [w for w in found if rng.random() > 0.06]
    out = [rng.choice(filler) if rng.random() < 0.03 else w for w in out]
    around = lambda: [rng.choice(filler) for _ in range(rng.choice([0, 0, 0, 2, 6, 15]))]
    return around() + out + around()


def fit(texts: list[str], *, per_template: int = 40, epochs: int = 12, rate: float = 0.5, decay: float = 1e-4, seed: int = 11) -> Model:
    """Stochastic gradient descent with adaptive steps; a fifth of the examples only sets the temperature."""
    rng = random.Random(seed)
    families = [*TEMPLATES, OTHER]
    others = []
    for t in texts:
        lines = [w for w in map(words, t.split("\n")) if w]
        whole = [w for x in lines for w in x]
        others += lines + [whole[k : k + SPAN] for k in range(0, len(whole), SPAN)]
    heads = {w for f in TEMPLATES for t in TEMPLATES[f] for w in words(t)}
    others = [w for w in others if 2 * sum(x in heads for x in w) < len(w) or not any(2 * _best(w, f)[0] >= 1 for f in TEMPLATES)]
    pool = sorted({w for x in others for w in x})[:50_000] or ["text"]
    data = [(_altered(rng, words(t), pool), k) for k, f in enumerate(TEMPLATES) for t in TEMPLATES[f] for _ in range(per_template)]
    data += [(w, len(families) - 1) for w in [*others, *map(words, NEAR_MISSES * 20)]]
    rng.shuffle(data)
    rows = [(grams(w), k) for w, k in data]
    held, rows = rows[: len(rows) // 5], rows[len(rows) // 5 :]
    w, b = np.zeros((BUCKETS, len(families))), np.zeros(len(families))
    gw, gb = np.full((BUCKETS, 1), 1e-2), 1e-2
    for _ in range(epochs):
        rng.shuffle(rows)
        for at, k in rows:
            if not len(at):
                continue
            s = 1 / np.sqrt(len(at))
            z = b + w[at].sum(0) * s
            p = np.exp(z - z.max())
            p /= p.sum()
            p[k] -= 1
            g = p * s
            gw[at] += (g * g).sum()
            gb += (p * p).sum()
            w[at] -= rate * (g + decay * w[at]) / np.sqrt(gw[at])
            b -= rate * p / np.sqrt(gb)
    model = Model(families, w.astype(np.float32), b)
    scores = [(b + w[at].sum(0) / np.sqrt(max(len(at), 1)), k) for at, k in held]

    def loss(t: float) -> float:
        return sum(np.logaddexp.reduce(z / t) - z[k] / t for z, k in scores) / max(len(scores), 1)

    model.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    return model


def _best(found: list[str], family: str) -> tuple[float, int, int]:
    """(share, start, end): the largest share of a template's words, repeats counted, in a stretch of the words as long
    as the template, and where it is; the first of several, the longest template first."""
    best = (0.0, 0, 0)
    for t in sorted(TEMPLATES[family], key=len, reverse=True):
        want = Counter(words(t))
        n = sum(want.values())
        have: Counter = Counter()
        shared = 0
        for i, w in enumerate(found):
            if w in want:
                shared += have[w] < want[w]
                have[w] += 1
            if i >= n and (old := found[i - n]) in want:
                have[old] -= 1
                shared -= have[old] < want[old]
            if shared / n > best[0]:
                best = (shared / n, max(i - n + 1, 0), i + 1)
    return best


def template_match(found: list[str], family: str) -> float:
    return _best(found, family)[0]


def _sample(docs: DataFrame, max_rows: int) -> DataFrame:
    """``text`` of at most ``max_rows`` documents in the order of a hash of their id, each once: of several rows with one
    doc_id the one whose text has the smallest hash."""
    ids = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h", "doc_id").limit(max_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # max_rows rows of two numbers
    one = texts.groupBy("doc_id", "h").agg(F.min(F.struct(F.xxhash64("text").alias("k"), "text")).alias("t"))
    return one.select("h", "doc_id", "t.text").repartition(1).sortWithinPartitions("h", "doc_id").select("text")


def train(docs: DataFrame, *, max_rows: int = 300, max_chars: int = 4_000_000, **params) -> Model:
    """Fits in one task on at most ``max_rows`` documents and ``max_chars`` of their text; a text that does not fit into
    what is left is skipped, those after it are not.  Only the model, whose size is fixed, comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, left = [], max_chars
        for b in batches:
            for t in b.column(0).to_pylist():
                if t and len(t) <= left:
                    texts.append(t)
                    left -= len(t)
        m = fit(texts, **params)
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.astype(np.float32).tobytes()], pa.binary()), pa.array([m.bias.tobytes()], pa.binary()), pa.array([m.temperature])], names=["w", "b", "t"])

    r = _sample(docs, max_rows).mapInArrow(released(run), "w binary, b binary, t double").first()
    if r is None:
        return fit([], **params)
    return Model([*TEMPLATES, OTHER], np.frombuffer(r.w, np.float32).reshape(BUCKETS, -1), np.frombuffer(r.b, np.float64), r.t)


class Reader:
    """Finds licences in arrays of texts."""

    def __init__(self, model: Model, least: float, confirm: float):
        self.model, self.least, self.confirm = model, least, confirm

    def find(self, texts: pa.Array) -> list[tuple[int, int, str, float, float]]:
        """(text, paragraph, family, confidence, matched), in order."""
        lines = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
        of = pc.list_parent_indices(lines).to_numpy().astype(np.int64)
        parts = pc.split_pattern_regex(pc.utf8_lower(pc.list_flatten(lines)), _BREAK)
        flat = pc.list_flatten(parts)
        real = pc.not_equal(flat, "")
        line = pc.list_parent_indices(parts).filter(real).to_numpy().astype(np.int64)
        coded = flat.filter(real).dictionary_encode()
        if not len(coded):
            return []
        spelt, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        h = _hashes(spelt)[code]
        # a paragraph begins at a line with words after one without, and with each text
        has = np.bincount(line, minlength=len(of)) > 0
        begins = has & np.concatenate([[True], ~has[:-1] | (of[1:] != of[:-1])])
        paragraph = np.cumsum(begins) - 1
        para = paragraph[line]
        first_paragraph = np.searchsorted(of[begins], np.arange(len(texts)))
        # stretches: lines, and windows of paragraphs of several lines
        heads = np.flatnonzero(np.diff(line, prepend=-1))
        start, end = [heads], [np.append(heads[1:], len(line))]
        p_heads = np.flatnonzero(np.diff(para, prepend=-1))
        p_ends = np.append(p_heads[1:], len(para))
        several = np.diff(np.searchsorted(heads, np.append(p_heads, len(para)))) > 1
        long_line = p_ends - p_heads > SPAN
        for a, z in zip(p_heads[several | long_line], p_ends[several | long_line], strict=True):
            k = np.arange(a, max(z - STEP, a + 1), STEP)
            start.append(k)
            end.append(np.minimum(k + SPAN, z))
        start, end = np.concatenate(start), np.concatenate(end)
        model = self.model
        sums = np.zeros((len(h) + 1, len(model.families)))
        for n in (1, 2, 3):
            at = _buckets(h, n, len(model.weights))
            same = para[: len(at)] == para[n - 1 :]
            sums[1 : len(at) + 1][same] += model.weights[at[same]]
        np.cumsum(sums, axis=0, out=sums)
        size = end - start
        p = model._softmax(sums[end] - sums[start], np.maximum(3 * size - 3, 1))
        places: dict[tuple[int, int], list[tuple]] = {}
        seen: set[tuple] = set()
        for i in np.flatnonzero(1 - p[:, -1] >= GLANCE):
            a, z = int(start[i]), int(end[i])
            own = int(para[a])
            for k in np.argsort(-p[i, :-1], kind="stable")[:2]:
                family = model.families[k]
                reach = max(len(words(t)) for t in TEMPLATES[family])
                lo, hi = max(a - reach, int(p_heads[own])), min(z + reach, int(p_ends[own]))
                if (lo, hi, family) in seen:
                    continue
                seen.add((lo, hi, family))
                found = [spelt[c] for c in code[lo:hi]]
                match, x, y = _best(found, family)
                if match < 0.5:
                    continue
                chance = model.chances(found[x:y])
                key = int(of[line[a]]), own - int(first_paragraph[of[line[a]]])
                if match >= self.confirm and chance[k] >= self.least:
                    name, value = family, float(chance[k])
                elif 1 - chance[-1] >= self.least and y - x > 3:
                    name, value = "unknown", float(1 - chance[-1])
                else:
                    continue
                places.setdefault(key, []).append((name == "unknown", -match * (y - x), name, lo + x, lo + y, value, match))
        return [(*key, *r) for key in sorted(places) for r in _apart(places[key])]


def _apart(places: list[tuple]) -> list[tuple[str, float, float]]:
    """(family, confidence, matched), one for each family: of places that overlap the one with most words matched, a
    known family before an unknown one, and that only in a paragraph without a known one."""
    taken, out = [], {}
    for unknown, _, name, a, z, value, match in sorted(places):
        if not (unknown and out.keys() - {"unknown"}) and all(z <= x or a >= y for x, y in taken):
            taken.append((a, z))
            out.setdefault(name, (name, value, match))
    return sorted(out.values())


def scan(docs: DataFrame, model: Model, *, least: float = 0.6, confirm: float = 0.7) -> DataFrame:
    """``doc_id, paragraph, family, confidence, matched``: one row for each licence family that a paragraph gives.

    ``paragraph`` is its number from 0 among the text's paragraphs.  A paragraph that is a licence for the classifier but
    that no template confirms, is reported as 'unknown'.  Null and empty texts give no rows; repeated rows repeat theirs;
    long texts are read whole; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model, least, confirm)
        for b in (part for whole in batches for part in slices(whole, 1, 1 << 20)):
            out = reader.find(b.column(1))
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.float64()]
            at = pa.array([r[0] for r in out], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), *(pa.array([r[k + 1] for r in out], t) for k, t in enumerate(kinds))], names=["doc_id", "paragraph", "family", "confidence", "matched"])

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(released(run), f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, paragraph long, family string, confidence double, matched double")

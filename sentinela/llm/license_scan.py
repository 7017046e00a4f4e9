"""License scans: passages of a text against license templates, by the Dice coefficient of their sets of word bigrams.

Text is normalised to words of a-z and 0-9. Passages are the lines of a text, its paragraphs (lines between blank ones) and
the text as a whole. A passage of a bigrams and a template of t can have a Dice coefficient of at most 2 min(a, t) / (a + t),
so only templates of t * D / (2 - D) to t * (2 - D) / D bigrams are candidates for a threshold D, and of these only those
that the number of template bigrams in the passage still allows.

Notices also lie within a line, or run over blank lines. So each run of words of a text, wherever its line breaks are, that
begins and ends with a bigram of a template and has at most t * (2 - D) / D bigrams, is a passage for that template, unless
all of it lies in such runs of larger templates: a sentence of a longer notice is that notice. Runs start where enough
template bigrams follow within that length, so their number grows with the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.llm.common import passes
from sentinela.llm.tokens import window_hashes, word_bounds, word_hashes

THRESHOLD = 0.8

# Notices and texts of common licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "bsd": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."),
    "mit": "Released under the MIT License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software."),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

_NORMAL = np.full(256, 32, np.uint8)
_NORMAL[48:58] = np.arange(48, 58)
_NORMAL[97:123] = np.arange(97, 123)
_NORMAL[65:91] = np.arange(97, 123)


def bigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of the first word, start of the second, and hash of each bigram of normalised words within one text."""
    data = _NORMAL[data]
    starts, ends, first = word_bounds(data, at)
    where, hashes = window_hashes(word_hashes(data, starts, ends), first, 2)
    return starts[where], starts[where + 1] if len(where) else where, hashes


def _templates(templates: dict[str, str]) -> tuple[list[str], list[set[int]]]:
    names = sorted(templates)
    sets = []
    for name in names:
        data = np.frombuffer(templates[name].encode(), np.uint8)
        sets.append(set(bigrams(data, np.array([0, len(data)]))[2].tolist()))
    return names, sets


def _passages(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Bounds that cut all texts into lines, into paragraphs, and not at all."""
    breaks = np.flatnonzero(data == 10)
    lines = np.unique(np.concatenate([at, breaks + 1]))
    yield lines
    word = np.concatenate([[0], np.cumsum(_NORMAL[data] != 32)])
    blank = word[lines[1:]] == word[lines[:-1]]
    yield np.unique(np.concatenate([at, lines[:-1][blank]]))
    yield np.unique(at)


def _runs(hashes: np.ndarray, ends: np.ndarray, places: np.ndarray, template: set[int], threshold: float) -> Iterator[tuple[int, int, float]]:
    """(first bigram, end, Dice coefficient) of the best run from each of `places` that reaches the threshold.

    `places` are the bigrams of the template, in order, and `ends` the end of the text of each of them.
    """
    size = len(template)
    longest = int(size * (2 - threshold) / threshold + 1e-9)
    limits = np.minimum(places + longest, ends)
    enough = np.searchsorted(places, limits) - np.arange(len(places)) >= size * threshold / (2 - threshold) - 1e-9
    for first, limit in zip(places[enough].tolist(), limits[enough].tolist(), strict=True):
        own, common, best, end = set(), 0, 0.0, first
        for i, x in enumerate(hashes[first:limit].tolist(), first + 1):
            if x not in own:
                own.add(x)
                common += x in template
            if x in template and 2 * common > best * (len(own) + size):
                best, end = 2 * common / (len(own) + size), i
        if best >= threshold:
            yield first, end, best


def _scan(templates: dict[str, str], threshold: float):
    names, sets = _templates(templates)
    known = np.array(sorted(set().union(*sets)), np.uint64)
    sizes = np.array([len(s) for s in sets])
    hashed = [np.array(sorted(s), np.uint64) for s in sets]
    larger_first = [int(t) for t in np.argsort(-sizes, kind="stable") if sizes[t]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in passes(batch):
                found: list[dict[str, float]] = [{} for _ in range(rows.num_rows)]
                one, two, hashes = bigrams(data, at)
                covered = np.zeros(len(hashes), np.int64)  # bigrams of the largest template with a run there
                hit = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes if len(known) else np.zeros(0, bool)
                for bounds in _passages(data, at) if hit.any() else ():
                    of = np.searchsorted(bounds, one, "right") - 1
                    inside = of == np.searchsorted(bounds, two, "right") - 1
                    count = np.bincount(of[inside & hit], minlength=len(bounds))
                    all_of = np.searchsorted(of, np.arange(len(bounds) + 1))
                    for k in np.flatnonzero(2 * count >= threshold * (sizes.min() + 1)):
                        mine = slice(all_of[k], all_of[k + 1])
                        own = set(hashes[mine][inside[mine]].tolist())
                        near = np.flatnonzero((sizes * (2 - threshold) >= threshold * len(own)) & (sizes * threshold <= (2 - threshold) * len(own)))
                        text = int(np.searchsorted(at, bounds[k], "right")) - 1
                        for t in near:
                            dice = 2 * len(own & sets[t]) / (len(own) + len(sets[t]))
                            if dice >= threshold:
                                found[text][names[t]] = max(dice, found[text].get(names[t], 0.0))
                places = np.flatnonzero(hit)
                text_of = np.searchsorted(at, one[places], "right") - 1
                text_end = np.searchsorted(one, at[text_of + 1])
                of_passages = [set(f) for f in found]
                for t in larger_first if len(places) else ():
                    own = np.isin(hashes[places], hashed[t])
                    for first, end, dice in _runs(hashes, text_end[own], places[own], sets[t], threshold):
                        if covered[first:end].min() > sizes[t]:
                            continue
                        covered[first:end] = np.maximum(covered[first:end], sizes[t])
                        text = int(np.searchsorted(at, one[first], "right")) - 1
                        if names[t] not in of_passages[text]:
                            found[text][names[t]] = max(dice, found[text].get(names[t], 0.0))
                best = [min(f.items(), key=lambda x: (-x[1], x[0])) if f else (None, 0.0) for f in found]
                yield pa.RecordBatch.from_arrays([
                    rows.column("doc_id"), pa.array([b[0] for b in best], pa.string()), pa.array([round(b[1], 6) for b in best], pa.float64()),
                    pa.array([",".join(sorted(f)) for f in found], pa.string())], ["doc_id", "license", "score", "licenses"])
    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, score, licenses) of every row of `docs` (doc_id, text; other columns are ignored).

    `licenses` lists the templates that some passage reaches the threshold for, `license` is the one of highest coefficient
    (of equal ones the first name) and `score` its coefficient. A template that a line, a paragraph or the text reaches has
    the coefficient of the best of these, another that of its best run of words. Without any, and so for null and empty texts and texts of one
    word, they are '', null and 0. Repeated rows are scanned each, null ids stay null, an empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run = _scan(TEMPLATES if templates is None else templates, threshold)
    return docs.mapInArrow(run, "doc_id bigint, license string, score double, licenses string")

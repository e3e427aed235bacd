"""License notices in texts.

Texts are cut into overlapping windows of words. MinHash bands of a window retrieve the templates
that share a band's value with it; enough bands are taken that a template whose containment
reaches ``CONTAINED`` is retrieved but for one time in a million. What is retrieved is checked by
the exact containment of the template's shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .texts import mix, schema_of, separators, shingle_hashes, slices, text_rows, utf8, word_hashes

SHINGLE = 3
CONTAINED = 0.8
MISSED = 1e-6
SHORTEST = 8

# What licenses are called after any verb. A template has a few words only, all of
# which are needed, so it tells versions apart and the words around it may be any.
CALLED = {
    "MIT": ("the MIT License", "under MIT License", "an MIT license", "the MIT/X11 License"),
    "Apache-2.0": ("Apache License Version 2.0", "Apache License 2.0", "Apache License v2.0", "the Apache 2.0 License"),
    "GPL": ("the GNU General Public License", "under the GNU GPL"),
    "GPL-3.0": ("GNU General Public License version 3", "GNU General Public License v3", "GNU GPL version 3",
                "GNU GPL v3", "under the GPLv3", "the GNU GPLv3"),
    "GPL-2.0": ("GNU General Public License version 2", "GNU General Public License v2", "GNU GPL version 2",
                "GNU GPL v2", "under the GPLv2", "the GNU GPLv2"),
    "LGPL": ("GNU Lesser General Public License", "GNU Library General Public License", "under the LGPL"),
    "LGPL-3.0": ("Lesser General Public License version 3", "Lesser General Public License v3", "under the LGPLv3"),
    "LGPL-2.1": ("General Public License version 2.1", "General Public License v2.1", "under the LGPL 2.1"),
    "AGPL": ("GNU Affero General Public License", "under the AGPL"),
    "AGPL-3.0": ("Affero General Public License version 3", "Affero General Public License v3", "under the AGPLv3"),
    "MPL-2.0": ("Mozilla Public License Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License v2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License version 2.0"),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License v1.0", "Eclipse Public License version 1.0"),
    "BSD": ("the BSD License", "under BSD License", "a BSD-style license"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License terms"),
    "ISC": ("the ISC License", "under ISC License"),
    "BSL-1.0": ("Boost Software License Version 1.0", "Boost Software License 1.0"),
    "Zlib": ("the zlib License", "under zlib License"),
    "CC0-1.0": ("CC0 1.0 Universal", "under CC0 1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0"),
    "CC-BY-3.0": ("CC BY 3.0", "Creative Commons Attribution 3.0"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Commons Attribution ShareAlike 4.0", "Commons Attribution Share Alike 4.0"),
    "CC-BY-SA-3.0": ("CC BY-SA 3.0", "Commons Attribution ShareAlike 3.0", "Commons Attribution Share Alike 3.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Commons Attribution NonCommercial 4.0"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Commons Attribution NoDerivatives 4.0"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Attribution NonCommercial ShareAlike 4.0"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Attribution NonCommercial NoDerivatives 4.0"),
}
IDENTIFIERS = (
    "MIT 0BSD ISC Zlib Unlicense BSL-1.0 Apache-2.0 GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 MPL-2.0 EPL-1.0 EPL-2.0 "
    "BSD-2-Clause BSD-3-Clause CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-3.0 CC-BY-SA-3.0"
).split()

# Longer wordings by which texts say what license they are under.
WORDINGS = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "MIT permission",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "Apache-2.0 header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:",
    ),
    (
        "GPL-3.0 header",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
        "License.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "MIT warranty",
        'The Software is provided "as is", without warranty of any kind, express or implied, including '
        "but not limited to the warranties of merchantability, fitness for a particular purpose and "
        "noninfringement. In no event shall the authors or copyright holders be liable for any claim, "
        "damages or other liability, whether in an action of contract, tort or otherwise, arising from, "
        "out of or in connection with the Software or the use or other dealings in the Software.",
    ),
    (
        "BSD source clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions "
        "and the following disclaimer.",
    ),
    (
        "BSD binary clause",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
        "and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
    ),
    (
        "BSD-3-Clause endorsement",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
        "or promote products derived from this software without specific prior written permission.",
    ),
    (
        "Apache-2.0 warranty",
        "Unless required by applicable law or agreed to in writing, software distributed under the License "
        'is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
        "or implied. See the License for the specific language governing permissions and limitations "
        "under the License.",
    ),
    (
        "Apache-2.0 grant",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a "
        "perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to "
        "reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and "
        "distribute the Work and such Derivative Works in Source or Object form.",
    ),
    (
        "GPL warranty",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    (
        "GPL preamble",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but "
        "changing it is not allowed.",
    ),
)

# Every template has a name of its own, which begins with the license's.
TEMPLATES = (
    *WORDINGS,
    *((f"{name}: {called}", called) for name, some in CALLED.items() for called in some),
    *((f"{name}: SPDX", f"SPDX-License-Identifier: {name}") for name in IDENTIFIERS),
)


def templates_of(catalog: DataFrame) -> list[tuple[str, str]]:
    """The templates of a table with ``license`` and ``wording``, for ``scan``; rows that lack one
    are left out. Wordings of one license make one row for each text, with the best of them. The
    table is collected: it is a catalog, not data."""
    rows = catalog.select("license", "wording").where("license is not null and wording is not null")
    return sorted(tuple(row) for row in rows.distinct().collect())


_WORD = [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]
PARTING = separators(bytes(b for b in range(256) if b not in _WORD))


def window_of(words: int) -> tuple[int, int]:
    """Length and step of the windows for a template: any of its occurrences is whole in one."""
    length = SHORTEST
    while length < words:
        length *= 2
    return length + length // 2, length // 2


def bands_for(words: int) -> int:
    """Bands of one value each that retrieve a template of so many words, if contained."""
    own = max(words - SHINGLE + 1, 1)
    shared = math.ceil(CONTAINED * own)
    window = max(window_of(words)[0] - SHINGLE + 1, 1)
    likeness = shared / (own + window - shared)
    return math.ceil(math.log(MISSED) / math.log(1 - likeness))


def _shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``SHINGLE`` words, or of all words if they are fewer."""
    return shingle_hashes(words, min(SHINGLE, max(len(words), 1)))


@dataclass(frozen=True)
class _Class:
    """The templates that are sought in windows of one length."""

    length: int
    step: int
    seeds: np.ndarray
    names: tuple[str, ...]
    sets: tuple[np.ndarray, ...]
    band_keys: np.ndarray
    band_owners: np.ndarray
    known: np.ndarray


def _least(shingles: np.ndarray, starts: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Per segment and band: the least hash, with the band's number mixed in."""
    out = np.empty((len(starts), len(seeds)), dtype=np.uint64)
    for band, seed in enumerate(seeds):
        out[:, band] = np.minimum.reduceat(mix(shingles ^ seed), starts) ^ seed
    return out


class Scanner:
    """Finds the templates given as (name, wording). All of them are held by every worker, so
    they are a catalog of bounded size; a wording without words is left out."""

    def __init__(self, templates: Sequence[tuple[str, str]]):
        by_window: dict[tuple[int, int], list[tuple[str, np.ndarray, int]]] = {}
        for name, wording in templates:
            words, _ = word_hashes(*utf8(pa.array([wording])), PARTING)
            if len(words):
                kept = by_window.setdefault(window_of(len(words)), [])
                kept.append((name, np.unique(_shingles(words)), len(words)))
        self.classes = []
        random = np.random.default_rng(17)
        for (length, step), held in sorted(by_window.items()):
            bands = max(bands_for(n) for _, _, n in held)
            seeds = random.integers(1, 2**63, bands, dtype=np.uint64)
            keys = np.concatenate([_least(s, np.array([0]), seeds)[0] for _, s, _ in held])
            owners = np.repeat(np.arange(len(held)), bands)
            order = np.argsort(keys, kind="stable")
            known = np.unique(np.concatenate([s for _, s, _ in held]))
            names, sets, _ = zip(*held, strict=True)
            self.classes.append(
                _Class(length, step, seeds, names, sets, keys[order], owners[order], known)
            )

    def scan(self, texts: pa.Array) -> list[tuple[int, str, float, int]]:
        """Text, template, its largest containment, and the word where the first window with
        that begins; only containments of ``CONTAINED`` and more."""
        words, first = word_hashes(*utf8(texts), PARTING)
        best: dict[tuple[int, str], tuple[float, int]] = {}
        shingles = shingle_hashes(words, SHINGLE)
        for kind in self.classes:
            for text in self._texts_with(kind, words, shingles, first):
                own = words[first[text] : first[text + 1]]
                for name, share, start in self._matches(kind, own):
                    held = best.get((text, name))
                    if held is None or (-share, start) < (-held[0], held[1]):
                        best[text, name] = (share, start)
        return [(text, name, *found) for (text, name), found in sorted(best.items())]

    @staticmethod
    def _texts_with(kind: _Class, words: np.ndarray, shingles: np.ndarray, first: np.ndarray) -> list[int]:
        """Texts with any shingle of any template: without one, no band can agree. Texts and
        templates of fewer words than a shingle are let through."""
        place = np.searchsorted(kind.known, shingles)
        hit = kind.known[np.minimum(place, len(kind.known) - 1)] == shingles
        at = np.flatnonzero(hit)
        texts = np.searchsorted(first, at, side="right") - 1
        sizes = np.diff(first)
        few = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
        return np.unique(np.concatenate([texts, few])).tolist()

    @staticmethod
    def _matches(kind: _Class, words: np.ndarray) -> Iterator[tuple[str, float, int]]:
        shingles = _shingles(words)
        span = max(kind.length - SHINGLE + 1, 1)
        starts = np.arange(0, max(len(words) - kind.length + kind.step, 1), kind.step)
        starts = starts[starts < len(shingles)]
        known = np.isin(shingles, kind.known)
        near = [s for s in starts.tolist() if known[s : s + span].any()]
        for start in near:
            window = shingles[start : start + span]
            keys = _least(window, np.array([0]), kind.seeds)[0]
            place = np.searchsorted(kind.band_keys, keys)
            place = np.minimum(place, len(kind.band_keys) - 1)
            # Equal keys lie together; each names a template to check.
            for i in np.unique(place[kind.band_keys[place] == keys]).tolist():
                stop = np.searchsorted(kind.band_keys, kind.band_keys[i], side="right")
                for owner in set(kind.band_owners[i:stop].tolist()):
                    sought = kind.sets[owner]
                    share = np.isin(sought, window).sum() / len(sought)
                    if share >= CONTAINED:
                        yield kind.names[owner], float(share), start


def scan(
    docs: DataFrame, *keys: str, templates: Sequence[tuple[str, str]] = TEMPLATES
) -> DataFrame:
    """License notices in whole texts: ``keys``, ``license``, ``containment`` and ``first_word``,
    one row for each document and template found in it.

    ``containment`` is the largest share of the template's shingles in any window, 0.8 or more;
    ``first_word`` is where the first window with it begins. Null and empty texts have no words
    and no row. Each row is scanned by itself: repeated rows and null keys come out as they are,
    and other columns are not read.
    """
    rows = text_rows(docs, *keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            for start, stop in slices(batch.column(len(keys))):
                part = batch.slice(start, stop - start)
                found = scanner.scan(part.column(len(keys)))
                places, names, shares, begins = zip(*found, strict=True) if found else ((),) * 4
                at = pa.array(places, pa.int64())
                columns = [
                    *[column.take(at) for column in part.columns[: len(keys)]],
                    pa.array(names, pa.string()),
                    pa.array(shares, pa.float64()),
                    pa.array(begins, pa.int64()),
                ]
                made = [*keys, "license", "containment", "first_word"]
                yield pa.RecordBatch.from_arrays(columns, names=made)

    made = {"license": "string", "containment": "double", "first_word": "long"}
    return rows.mapInArrow(run, schema_of(rows, keys, **made))

"""Licence notices in release files, by Dice coefficient over word bigrams."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flightframe.llm.store import column, type_of
from flightframe.llm.words import U, hash_of_text, pieces, runs, words_of

# Notices by which common licences are stated, and the paragraphs of short licences.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution.",
    ),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.",),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission.",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0 Universal.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0",),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "WTFPL": ("Do What The Fuck You Want To Public License, Version 2, December 2004",),
    "Zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions",
    ),
}

#: Normalised words are runs of ASCII letters, digits and all bytes beyond ASCII; A-Z are lower-cased.
BETWEEN = np.array([not (chr(b).isalnum() or b >= 128) if b < 128 else False for b in range(256)])


@dataclass(frozen=True)
class LicensePolicy:
    """A notice is reported from ``percent`` of the Dice coefficient on."""

    percent: int = 85

    def __post_init__(self) -> None:
        if not 0 < self.percent <= 100:
            raise ValueError("percent must be within (0, 100]")


LICENSES = LicensePolicy()
Templates = tuple[tuple[str, tuple[int, ...], int], ...]
COLUMNS = ("unit", "line", "license", "shared", "bigrams", "template_bigrams", "dice")


def compiled(templates: Mapping[str, Sequence[str]]) -> Templates:
    """(licence, bigrams, places) of every template with a bigram, sorted; places count repeated bigrams."""
    out = []
    for name, texts in templates.items():
        for text in texts:
            pairs = runs(hash_of_text(text, True, BETWEEN), 2)
            if len(pairs):
                out.append((name, tuple(int(b) for b in np.unique(pairs)), len(pairs)))
    return tuple(sorted(out))


@lru_cache(maxsize=4)
def _index(templates: Templates) -> tuple[np.ndarray, list[tuple[str, np.ndarray]]]:
    own = [(name, np.array(bigrams, U)) for name, bigrams, _ in templates]
    return np.unique(np.concatenate([b for _, b in own]) if own else np.zeros(0, U)), own


def best_match(bigrams: np.ndarray, templates: Templates, percent: int) -> tuple[str, int, int] | None:
    """Licence, shared bigrams and template size of the best template for a set of bigrams.

    2 * shared <= 2 * min(sizes), so a template is compared only if its size allows the
    wanted coefficient; of equal coefficients the first name wins.
    """
    best = None
    for name, other in _index(templates)[1]:
        both = len(bigrams) + len(other)
        if 200 * min(len(bigrams), len(other)) < percent * both:
            continue
        shared = len(np.intersect1d(bigrams, other, assume_unique=True))
        if 200 * shared >= percent * both and (best is None or 2 * shared / both > best[0]):
            best = (2 * shared / both, name, shared, len(other))
    return best and best[1:]


def _windows(pairs: np.ndarray, hit: np.ndarray, ends: np.ndarray, templates: Templates, policy: LicensePolicy) -> dict[int, list[tuple]]:
    """Windows as long as a template that begin with a bigram of it, by their first place: ``hit`` are places of known
    bigrams, ``ends`` where their texts end. A window can only reach the coefficient with enough places of the
    template's bigrams in it, so others are not looked at."""
    known, own = _index(templates)
    where, found = np.searchsorted(known, pairs[hit]), {}
    for (name, bigrams), (_, _, length) in zip(own, templates):
        member = np.isin(known, bigrams)[where]
        starts, stops = hit[member], np.minimum(hit[member] + length, ends[member])
        inside = np.searchsorted(starts, stops) - np.arange(len(starts))
        # Of a window with n bigrams, shared ones are n at most: 200 * shared >= percent * (n + m) asks for this many.
        for i in np.flatnonzero(inside * (200 - policy.percent) >= policy.percent * len(bigrams)):
            window = np.unique(pairs[starts[i] : stops[i]])
            shared = len(np.intersect1d(window, bigrams, assume_unique=True))
            if 200 * shared >= policy.percent * (len(window) + len(bigrams)):
                dice = 2 * shared / (len(window) + len(bigrams))
                found.setdefault(int(ends[member][i]), []).append((-dice, -len(bigrams), int(starts[i]), name, int(stops[i]), shared, len(window)))
    chosen = {}
    for end, listed in found.items():
        taken: list[tuple[int, int]] = []
        for window in sorted(listed):
            if all(window[4] < a or window[2] > b for a, b in taken):
                taken.append((window[2], window[4]))
                chosen.setdefault(end, []).append(window)
    return chosen


def _units(words, d: int, lines: np.ndarray, blank: np.ndarray, touched: np.ndarray) -> Iterator[tuple[str, int, int, int]]:
    """Units of text d that hold a touched word: (unit, first line, first word, end). ``lines`` are the first words of its
    lines, the end included; ``blank`` marks lines without a word."""
    first, last = words.first[d], words.first[d + 1]
    own = np.unique(np.searchsorted(lines, touched, "right") - 1)
    for i in own:
        yield "line", int(i) + 1, int(lines[i]), int(lines[i + 1])
    paragraph = np.cumsum(blank)  # lines of a paragraph share the number of blank lines before
    for p in np.unique(paragraph[own]):
        inside = np.flatnonzero((paragraph == p) & ~blank)
        if len(inside) > 1:
            yield "paragraph", int(inside[0]) + 1, int(lines[inside[0]]), int(lines[inside[-1] + 1])
    filled = np.flatnonzero(~blank)
    if len(np.unique(paragraph[filled])) > 1:
        yield "text", int(filled[0]) + 1, int(first), int(last)


def _scanned(batches: Iterator[pa.RecordBatch], templates: Templates, policy: LicensePolicy) -> Iterator[pa.RecordBatch]:
    known, sized = _index(templates)
    sizes = [len(b) for _, b in sized] or [0]
    most = max(sizes) * (200 - policy.percent) // policy.percent + 1
    for batch in pieces(batches):
        words = words_of(batch.column(1), True, BETWEEN)
        pairs = runs(words.hash, 2)
        at = np.searchsorted(known, pairs)
        hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == pairs) if len(known) and len(pairs) else np.zeros(0, int)
        hit = hit[np.searchsorted(words.first, hit, "right") == np.searchsorted(words.first, hit + 1, "right")]
        rows, out = [], {c: [] for c in COLUMNS}
        windows = _windows(pairs, hit, words.first[np.searchsorted(words.first, hit, "right")] - 1, templates, policy) if len(hit) else {}
        owners = np.searchsorted(words.first, hit, "right") - 1
        for d in np.unique(owners):
            begin, stop = words.text[d], words.text[d + 1]
            feeds = begin + np.flatnonzero(words.data[begin:stop] == 10)
            lines = np.concatenate([[words.first[d]], np.searchsorted(words.start, feeds), [words.first[d + 1]]])
            blank = lines[1:] == lines[:-1]
            for unit, line, a, b in _units(words, int(d), lines, blank, hit[owners == d]):
                if b - a < 2:
                    continue
                # A unit has no fewer distinct bigrams than one in as many places, so longer ones are told apart after counting.
                bigrams = np.unique(pairs[a : b - 1])
                if len(bigrams) > most or (match := best_match(bigrams, templates, policy.percent)) is None:
                    continue
                name, shared, other = match
                rows.append(int(d))
                for c, value in zip(COLUMNS, (unit, line, name, shared, len(bigrams), other, 2 * shared / (len(bigrams) + other))):
                    out[c].append(value)
            for dice, size, begin_at, name, _, shared, n in sorted(windows.get(int(words.first[d + 1]) - 1, ()), key=lambda w: w[2]):
                rows.append(int(d))
                line = int(np.searchsorted(lines, begin_at, "right"))
                for c, value in zip(COLUMNS, ("window", line, name, shared, n, -size, -dice)):
                    out[c].append(value)
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(out[c], k) for c, k in zip(COLUMNS, kinds)]], ["path", *COLUMNS])


def scan_licenses(
    files: DataFrame, path: str = "path", text: str = "text", templates: Mapping[str, Sequence[str]] = TEMPLATES, policy: LicensePolicy = LICENSES,
) -> DataFrame:
    """Licence notices in release files, one row per notice.

    Units are every line, every paragraph of several lines (blank lines part them) and the whole text
    if it has several paragraphs. A unit is reported with its best template if the Dice coefficient of
    their sets of word bigrams reaches the policy's percentage. So is, whatever stands around it, every window
    as long as a template that begins with a bigram of it; of overlapping windows the one of the highest
    coefficient stays, then the longer template's, then the first. Returns ``path``, ``unit``, ``line`` (of
    its beginning, from 1), ``license``, ``shared``, ``bigrams``, ``template_bigrams``, ``dice``.

    ``templates`` is a setting: licence names with their notices, shipped to every task. Bigrams are
    compared by 64-bit hashes. Null and empty texts and units of one word have no bigram and no row; each row
    of the input is scanned alone, so repeated rows report repeatedly and null paths stay null. Other
    columns are ignored. An empty table gives an empty result.
    """
    ready = compiled(templates)
    source = files.select(column(path).alias("path"), column(text).cast("string").alias("text"))
    return source.mapInArrow(
        lambda batches: _scanned(batches, ready, policy),
        f"path {type_of(files, path)}, unit string, line long, license string, shared long, bigrams long, template_bigrams long, dice double")

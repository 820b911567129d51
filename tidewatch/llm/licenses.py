"""Operator 5: licence scans by MinHash bands over overlapping text windows.

Texts are cut into windows of a few sizes, each half a window on; a template lies whole in a window at most four
times its size. Windows and templates that agree in a band of their MinHash signatures are candidates. With
one row a band, a template whose shingles are at least 0.8 in a window has a Jaccard similarity of about 0.2 or
more to it, so 64 bands miss it with a probability under 1e-6. Candidates are verified by exact shingle
containment around the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import WordHasher, grams, mix, slices

SHINGLE = 5
BANDS = 64
CHUNK = 1 << 20

# Notices by which texts name their licence, the whole short licences, and the openings of the long ones.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-clause": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    "apache-2.0-disclaimer": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-2.0-text": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-disclaimer": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-text-preamble": "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works.",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc0-1.0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost-1.0-notice": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "wtfpl": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION",
}


def _hasher() -> WordHasher:
    """Words are runs of letters, digits and non-ASCII bytes; A-Z lower-cased."""
    separators = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
    fold = np.arange(256)
    fold[65:91] += 32
    return WordHasher(separators, fold)


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


class Scanner:
    """Templates by window size, with their signatures."""

    def __init__(self, templates: dict[str, str], bands: int = BANDS):
        self.hash, self.seeds, self.tiers = _hasher(), _seeds(bands), {}
        every = []
        for name, text in templates.items():
            words, *_ = self.hash([text.encode()])
            shingles = np.unique(grams(words, min(SHINGLE, len(words))) if len(words) else np.zeros(0, np.uint64))
            if not len(shingles) or len(words) < SHINGLE:
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            size = 16
            while size < 2 * len(words):
                size *= 2
            own = mix(shingles[:, None] ^ self.seeds)
            self.tiers.setdefault(size, []).append((name, shingles, own.min(axis=0), len(words)))
            every.append(shingles[np.unique(own.argmin(axis=0))])
        # A window agrees in a band only if it has the shingle that gives the template its least hash there.
        self.marks = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)

    def scan(self, words: np.ndarray) -> list[tuple[str, float, int]]:
        """(template, containment, first word) of the templates of one text, the best place of each."""
        shingles = grams(words, SHINGLE)
        if not len(shingles) or not len(self.marks):
            return []
        at = np.minimum(np.searchsorted(self.marks, shingles), len(self.marks) - 1)
        spots = np.flatnonzero(self.marks[at] == shingles)
        best: dict[str, tuple[float, int]] = {}
        for size, templates in self.tiers.items() if len(spots) else ():
            half = size // 2
            for w in {x for s in (spots // half).tolist() for x in (s - 1, s) if x >= 0}:
                low, high = w * half, min(len(shingles), w * half + size - SHINGLE + 1)
                if low >= high:
                    continue
                signature = mix(shingles[low:high, None] ^ self.seeds).min(axis=0)
                for name, own, theirs, n in templates:
                    if not (signature == theirs).any():
                        continue
                    low2, high2 = max(0, low - half), min(len(shingles), high + half)
                    near = shingles[low2:high2]
                    inside = np.flatnonzero(np.isin(near, own))
                    # the n words on from each shingle of the template that is found
                    for first in inside.tolist():
                        got = len(np.unique(near[inside[(inside >= first) & (inside < first + n + n // 4)]])) / len(own)
                        if name not in best or (got, -(low2 + first)) > (best[name][0], -best[name][1]):
                            best[name] = got, low2 + first
        return [(name, got, at) for name, (got, at) in best.items()]


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """One row per document and template found: (id, template, containment, first_word).

    containment is the share of the template's distinct five-word shingles found near one place; `least` of
    it makes a match. Null and empty texts have none; rows that repeat an id are scanned each.
    """
    templates = TEMPLATES if templates is None else templates
    Scanner(templates)  # fails here, not in a task

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates)
        for pdf in frames:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in pdf["t"]]
            ids, rows = pdf["id"].tolist(), []
            for a, b in slices([len(t) for t in texts], CHUNK):
                words, _, _, owner, _ = scanner.hash(texts[a:b])
                bounds = np.searchsorted(owner, np.arange(b - a + 1)).tolist()
                rows += [(ids[a + i], name, got, at) for i in range(b - a) for name, got, at in scanner.scan(words[bounds[i] : bounds[i + 1]]) if got >= least]
            out = pd.DataFrame(rows, columns=["id", "template", "containment", "first_word"])
            yield out.astype({"containment": "float64", "first_word": "int64"})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInPandas(run, "id long, template string, containment double, first_word long")

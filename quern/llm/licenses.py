"""Operator 7, licence scan by a generalised suffix automaton of licence tokens.

Files stream through the automaton of all templates; its matching statistics give maximal matches with each template, which are chained, in
order in file and template, into spans of one template. A span counts if it covers ``limit_coverage`` of its
template, or ``limit_words`` words of it. Words that templates share count for each of them; of spans that overlap the one with
most words of its template is reported, then the one that covers most of it, then the template that comes first. So a notice is named by its own
name and not by a licence whose notice it contains or nearly is.

``TEMPLATES`` holds notices and short licences; ``from_folder`` reads whole licence texts, a file each.

Defined results: null and empty texts have no span; very long texts count whole; a template that is printed twice is reported twice;
repeated rows are reported each; ids may be of any type, null ones included; other columns, whatever their names, aren't read; a template without words is never found; an empty table
or no templates give no span.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._automaton import Matcher, chain
from quern.llm._util import text_views
from quern.llm._words import chars, words

#: Words of the shortest match.
SEED = 3
#: Part of a template that a span covers.
LIMIT_COVERAGE = 0.8
#: Words of a template that are enough by themselves.
LIMIT_WORDS = 40
#: Words between two matches of a span, such as names and years.
GAP = 12

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
#: (name, text) of the templates; short notices first.
TEMPLATES: list[tuple[str, str]] = [
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-style", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Apache-2.0",
        'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _WARRANTY,
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. " + _BSD_TAIL,
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_TAIL,
    ),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
]

SPANS = "doc_id {0}, license string, start_char bigint, end_char bigint, n_words int, coverage double"


def from_folder(path: str) -> list[tuple[str, str]]:
    """Templates of whole licence texts: each file's name and content, in order of names."""
    return [(p.stem if p.suffix in (".txt", ".md") else p.name, p.read_text("utf8", "replace")) for p in sorted(Path(path).iterdir()) if p.is_file()]


def spans_of(m: Matcher, w, limit_coverage: float, limit_words: int, gap: int) -> list[tuple[int, int, int, int, int]]:
    """(row, first word, end word, template, covered words) of a batch's spans, no two of which overlap."""
    found = m.matches(w.hash, w.ptr)
    by: dict[int, list] = {}
    for r, f in zip((np.searchsorted(w.ptr, [f[0] for f in found], side="right") - 1).tolist(), found, strict=True):
        by.setdefault(r, []).append(f)
    for a, n, k in m.whole(w.hash, w.ptr, 1):
        by.setdefault(int(np.searchsorted(w.ptr, a, side="right") - 1), []).append((a, n, k, 0))
    out = []
    for r, fs in sorted(by.items()):
        spans = [(x, y, k, n) for x, y, k, n in chain(fs, gap) if n >= limit_coverage * m.sizes[k] or n >= limit_words]
        spans.sort(key=lambda s: (-s[3], -s[3] / m.sizes[s[2]], s[2], s[0]))
        taken: list[tuple[int, int]] = []
        for x, y, k, n in spans:
            i = bisect_left(taken, (x, y))
            if (i and taken[i - 1][1] > x) or (i < len(taken) and taken[i][0] < y):
                continue
            taken.insert(i, (x, y))
            out.append((r, x, y, k, n))
    return sorted(out)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None, limit_coverage: float = LIMIT_COVERAGE, limit_words: int = LIMIT_WORDS, gap: int = GAP) -> DataFrame:
    """One row for each covered template span: doc_id, license, start_char, end_char, n_words, coverage."""
    templates = TEMPLATES if templates is None else templates
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = [n for n, _ in templates]
    m = docs.sparkSession.sparkContext.broadcast(Matcher([(i, t) for i, (_, t) in enumerate(templates)], SEED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for first, view in text_views(b["text"]):
                w = words(view)
                for r, x, y, k, n in spans_of(m.value, w, limit_coverage, limit_words, gap):
                    a, e = chars(w.raw, int(w.offs[r]), [w.start[x], w.end[y - 1]]).tolist()
                    rows.append((first + r, names[k], a, e, n, n / int(m.value.sizes[k])))
            if rows:
                at, *cols = zip(*rows, strict=True)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(at)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "license", "start_char", "end_char", "n_words", "coverage"])

    return docs.mapInArrow(run, SPANS.format(docs.schema["doc_id"].dataType.simpleString()))

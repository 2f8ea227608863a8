"""License scan: winnowed fingerprints of templates in an inverted index, then banded alignment.

Texts and templates become alphanumeric words in lower case. A template of L words matches a span of the text that
is within E = floor((1 - COVERAGE) L) word edits of it: words exchanged, left out or put in. Such a span shares a run
of at least ceil((L - E) / (E + 1)) words with the template, so each template gets a gram of k words and a
winnowing window of w grams with k + w - 1 words no longer than that run: text and template then choose at least one
equal fingerprint inside the run, and no match is lost. The inverted index leads from fingerprints to (template, place);
places of one diagonal band that hold enough of the template's words are aligned by edit distance in the band,
with free ends in the text.

Coverage is 1 - edits / L, so foreign words inside the span count against it. Decisive words (version numbers of
templates that have one, and DECISIVE) decide: a span with one that the template lacks is no match, nor is one
where such a word is missing and no foreign word stands for it. Of spans that overlap the one with most matched words (L - edits)
stays, then of the highest coverage, then the earliest; templates that fit a span equally well are all reported.

What stands just behind a span counts where the template ends in a version or is exact: the words of OR_LATER, or a plus
sign, make a GNU license "-or-later" and belong to the span; a further number after a point, or a word after a hyphen, makes
it another version or identifier, so there is no match. EXACT templates (SPDX lines, notices by identifier, titles)
match word for word; behind an SPDX line further identifiers joined by OR or AND are matches of their own.

Null and empty texts match nothing. Rows are independent of each other: ties and repeated rows need no care. Other
columns are left out, ids of any type are carried along. A text of any length is one chunk of a task's memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import col
from .textkernel import BASE, U64, mix, text_chunks, word_bounds, word_hashes

COVERAGE = 0.8
#: Words that set one license of a family apart.
DECISIVE = ("nc", "noncommercial", "sa", "sharealike", "nd", "noderivatives", "noderivs", "lesser", "library", "affero")
#: Fixed: what makes a version of a GNU license the least one.
OR_LATER = ("or later", "or newer", "or any later version", "or at your option any later version", "or later version", "or later versions")
#: Fixed parts of whole texts.
AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
)
BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ZLIB_HEAD = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"
)
BSL_HEAD = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") "
    "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"
)
UNLICENSE_HEAD = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
    "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
DEALINGS = "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
#: Fixed: GNU licenses with their kind and number.
GNU_NOTICES = (("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3"))
GNU = tuple(name for name, _, _ in GNU_NOTICES)


def _gnu_notice(what: str, kind: str, version: str) -> str:
    license = f"the GNU {kind} Public License as published by the Free Software Foundation"
    return f"This {what} is free software: you can redistribute it and/or modify it under the terms of {license}, either version {version} of the License, or (at your option) any later version."


#: Fixed notices and texts: name and text. Of the long licenses there are notices and openings, no whole bodies.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Zlib", ZLIB_HEAD),
    ("BSL-1.0", BSL_HEAD),
    ("Unlicense", UNLICENSE_HEAD),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    (
        "LGPL",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    (
        "AGPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    ("BSD-2-Clause", BSD_HEAD + BSD_DISCLAIMER),
    ("BSD-3-Clause", BSD_HEAD + BSD_THIRD + BSD_DISCLAIMER),
    ("BSD", BSD_DISCLAIMER),
    (
        "Zlib",
        ZLIB_HEAD + ": The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "This notice may not be removed or altered from any source distribution.",
    ),
    (
        "BSL-1.0",
        BSL_HEAD + ", all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included "
        "in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code "
        "generated by a source language processor. " + AS_IS + ", TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN CONTRACT, TORT OR OTHERWISE, " + DEALINGS,
    ),
    (
        "Unlicense",
        UNLICENSE_HEAD + " In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity "
        "of all present and future rights to this software under copyright law. " + AS_IS + "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, " + DEALINGS,
    ),
    *((f"{name}-or-later", _gnu_notice("library" if kind.startswith("Lesser") else "program", kind, number)) for name, kind, number in GNU_NOTICES),
    *((name, f"Licensed under the GNU {kind} Public License, version {number}") for name, kind, number in GNU_NOTICES),
    *((name, "Licensed under either of Apache License, Version 2.0 or MIT license at your option.") for name in ("Apache-2.0", "MIT")),
    *((name, "Licensed under either of Apache License, Version 2.0 (LICENSE-APACHE or http://www.apache.org/licenses/LICENSE-2.0) or MIT license (LICENSE-MIT or http://opensource.org/licenses/MIT) at your option.")
      for name in ("Apache-2.0", "MIT")),
    (
        "GPL-2.0",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change "
        "free software--to make sure the software is free for all its users.",
    ),
    (
        "GPL-3.0",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom "
        "to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
    ),
    (
        "LGPL-3.0",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    ),
    (
        "AGPL-3.0",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    ),
    (
        "Apache-2.0",
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "
        "\"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.",
    ),
    (
        "EPL",
        "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
    ),
    (
        "CC0-1.0",
        "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an \"owner\") "
        "of an original work of authorship and/or a database (each, a \"Work\").",
    ),
    ("Artistic-2.0", "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
)
#: Fixed: SPDX identifiers, and older or longer ones with the name they are reported by.
IDENTIFIERS = (
    "0BSD", "AFL-3.0", "AGPL-3.0", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-4.0",
    "CC0-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "NCSA", "OFL-1.1", "PostgreSQL", "Python-2.0",
    "Unlicense", "WTFPL", "Zlib",
)
KNOWN = (*((i, i) for i in IDENTIFIERS), *((i, f"{i}-only") for i in GNU))
SPDX = "SPDX-License-Identifier:"
#: Templates that match word for word.
EXACT = (
    *((name, f"{before} {i}{after}") for name, i in KNOWN for before, after in ((SPDX, ""), ("released under the", " license"), ("licensed under the", " license"), ("distributed under the", " license"))),
    *((f"{name}-or-later", f"{before} {name}-or-later license") for name in GNU for before in ("released under the", "licensed under the", "distributed under the")),
    *((name, f"Licensed under the GNU {kind} Public License v{number}{tail}") for name, kind, number in GNU_NOTICES for tail in ("", ".0")[: 2 - number.count(".")]),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
)
PLAIN = np.ones(256, bool)
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
FACTORS = [U64(pow(BASE, 2 * j + 3, 1 << 64)) for j in range(8)]


def allowed_edits(words: int, coverage: float) -> int:
    return int((1 - coverage) * words + 1e-9)


def gram_and_window(words: int, edits: int) -> tuple[int, int]:
    """Words of a gram and grams of a window that any span within `edits` edits must share a fingerprint at."""
    run = -(-(words - edits) // (edits + 1))
    gram = min(3, (run + 2) // 2)
    return gram, min(run - gram + 1, 4)


def winnow(words: np.ndarray, first: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the winnowed fingerprints of rows of words laid end to end."""
    n = len(words) - gram + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    h = np.zeros(n, U64)
    for j in range(gram):
        h += words[j : j + n] * FACTORS[j]
    h = mix(h)
    row = np.searchsorted(first, np.arange(len(words)), "right")
    m = n - window + 1
    whole = row[:m] == row[window + gram - 2 : window + gram - 2 + m]
    best, least = np.arange(m), h[:m]
    for j in range(1, window):
        lower = h[j : j + m] <= least
        best, least = np.where(lower, np.arange(m) + j, best), np.where(lower, h[j : j + m], least)
    at = np.unique(best[whole])
    return at, h[at]


def align(template: np.ndarray, words: np.ndarray, low: int, high: int, edits: int) -> list[tuple[int, int, int]]:
    """(edits, first, last) of spans of `words` within `edits` edits of the template, in a band of diagonals low .. high.

    For each end the fewest edits, of these the latest start. Rows of the edit table are held as
    edits * scale - start, so a minimum picks both.
    """
    n = len(words)
    scale, far = n + 2, (len(template) + n + 2) * (n + 2)
    row = -np.arange(n + 1)
    steps = np.arange(n + 1) * scale
    for i, w in enumerate(template):
        new = row + scale
        new[1:] = np.minimum(new[1:], row[:-1] + scale * (words != w))
        out = np.minimum.accumulate(new - steps) + steps
        a, b = max(0, i + 1 + low), min(n, i + 1 + high)
        row = np.full(n + 1, far)
        row[a : b + 1] = out[a : b + 1]
    cost = -(-row // scale)
    good = np.flatnonzero(cost <= edits)
    return sorted((int(cost[j]), int(cost[j] * scale - row[j]), int(j) - 1) for j in good if cost[j] * scale - row[j] < j)


def _word_hashes(raw: np.ndarray, offs: np.ndarray):
    s, e, first = word_bounds(raw, offs, PLAIN)
    return s, e, first, word_hashes(raw, s, e) if len(s) else np.zeros(0, U64)


class Templates:
    """Words, decisive words and the inverted index of fingerprints by gram and window."""

    def __init__(self, templates, coverage: float, exact=()):
        hashes = lambda text: _word_hashes(raw := np.frombuffer(text.encode(), np.uint8), np.array([0, len(raw)]))[3]
        self.names = [name for name, _ in (*templates, *exact)]
        self.words = [hashes(text) for _, text in (*templates, *exact)]
        self.first_exact = len(templates)
        self.edits = [allowed_edits(len(w), coverage) if n < self.first_exact else 0 for n, w in enumerate(self.words)]
        self.vocabulary = [np.unique(w) for w in self.words]
        decisive = hashes(" ".join(DECISIVE))
        digits, later = hashes(" ".join(f"{k} v{k}" for k in range(100))), hashes("later")
        self.decisive = [np.concatenate([decisive, *(d for d in (digits, later) if np.isin(w, d).any())]) for w in self.words]
        #: Whether what stands behind a match counts.
        self.open_end = [n >= self.first_exact or (len(w) > 0 and bool(np.isin(w[-1], digits))) for n, w in enumerate(self.words)]
        self.or_later = [hashes(t) for t in sorted(OR_LATER, key=len, reverse=True)]
        self.joints, self.joints_later = hashes("or and").tolist(), hashes("or later")
        spdx = hashes(SPDX)
        self.spdx = [n >= self.first_exact and np.array_equal(w[: len(spdx)], spdx) for n, w in enumerate(self.words)]
        self.identifiers = sorted(((name, hashes(i)) for name, i in KNOWN), key=lambda k: -len(k[1]))
        self.marks = [w[np.isin(w, d)].tolist() for w, d in zip(self.words, self.decisive, strict=True)]
        index: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for n, w in enumerate(self.words):
            if len(w):
                kind = gram_and_window(len(w), self.edits[n])
                index.setdefault(kind, []).extend((int(h), n, int(at)) for at, h in zip(*winnow(w, np.array([0, len(w)]), *kind), strict=True))
        #: For each (gram, window) the sorted fingerprints with their template and place.
        self.index = {kind: tuple(np.array(c, t) for c, t in zip(zip(*sorted(rows), strict=True), (U64, np.int64, np.int64), strict=True)) for kind, rows in index.items()}

    def places(self, words: np.ndarray, first: np.ndarray):
        """(row, template, diagonal) that share a fingerprint, sorted; a diagonal is a place in the words less one in the template."""
        found = []
        for (gram, window), (prints, template, place) in self.index.items():
            at, h = winnow(words, first, gram, window)
            a, b = np.searchsorted(prints, h), np.searchsorted(prints, h, "right")
            hit = np.flatnonzero(b > a)
            times = (b - a)[hit]
            if len(hit):
                slot = np.repeat(a[hit] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
                where = np.repeat(at[hit], times)
                found.append(np.stack([np.searchsorted(first, where, "right") - 1, template[slot], where - place[slot]]))
        return np.unique(np.concatenate(found, 1), axis=1).T if found else np.zeros((0, 3), np.int64)

    def fits(self, n: int, decisive: list[int], foreign: int) -> bool:
        """Whether the decisive words of a span agree with the template's; `foreign` counts the words that it lacks."""
        rest = list(self.marks[n])
        for w in decisive:
            if w not in rest:
                return False
            rest.remove(w)
        return len(rest) <= foreign

    def spans(self, words: np.ndarray, first: np.ndarray):
        """(row, template, first word, last word, edits) of all matches, before overlaps are settled."""
        known: dict[int, tuple[np.ndarray, np.ndarray, list[int]]] = {}
        rows = self.places(words, first)
        if not len(rows):
            return
        gap = np.array([e + 1 for e in self.edits])
        fresh = np.ones(len(rows), bool)
        fresh[1:] = np.any(rows[1:, :2] != rows[:-1, :2], axis=1) | (rows[1:, 2] - rows[:-1, 2] > gap[rows[1:, 1]])
        begin = np.flatnonzero(fresh)
        for x, y in zip(begin, np.r_[begin[1:], len(rows)], strict=True):
            d, n, low = rows[x].tolist()
            high, e, size = int(rows[y - 1, 2]), self.edits[n], len(self.words[n])
            a, b = max(int(first[d]), low - e), min(int(first[d + 1]), high + size + e)
            if e == 0:
                for at in rows[x:y, 2].tolist():
                    if a <= at <= b - size and (words[at : at + size] == self.words[n]).all():
                        yield d, n, at, at + size - 1, 0
                continue
            if n not in known:
                at = np.flatnonzero(np.isin(words, self.decisive[n]))
                known[n] = (np.flatnonzero(np.isin(words, self.vocabulary[n])), at, words[at].tolist())
            near, marked, marks = known[n]
            # Places where enough of the template's words lie close enough together.
            mine, need = near[np.searchsorted(near, a) : np.searchsorted(near, b)], size - e
            if len(mine) < need:
                continue
            starts = mine[: len(mine) - need + 1]
            starts = starts[mine[need - 1 :] - starts < size + e]
            for part in np.split(starts, np.flatnonzero(np.diff(starts) > size + e) + 1) if len(starts) else ():
                left, right = max(a, int(part[0]) - e), min(b, int(part[-1]) + size + e)
                taken = np.zeros(right - left, bool)
                for cost, s, t in align(self.words[n], words[left:right], low - e - left, high + e - left, e):
                    if taken[s : t + 1].any():
                        continue
                    x, y = np.searchsorted(marked, [left + s, left + t + 1]).tolist()
                    inside = int(np.searchsorted(near, left + t + 1) - np.searchsorted(near, left + s))
                    if self.fits(n, marks[x:y], t - s + 1 - inside):
                        taken[s : t + 1] = True
                        yield d, n, left + s, left + t, cost


    def behind(self, n: int, last: int, end: int, raw, s, e, words):
        """(name, last word) of a match by what stands behind it, of a row whose words end at `end`; None if that makes it no match."""
        name = self.names[n]
        if not self.open_end[n] or (last + 1 >= end and e[last] >= len(raw)):
            return name, last
        mark = chr(raw[e[last]]) if e[last] < len(raw) else ""
        if name in GNU:
            if mark == "+":
                return f"{name}-or-later", last
            for more in self.or_later:
                if last + len(more) < end and np.array_equal(words[last + 1 : last + 1 + len(more)], more):
                    return f"{name}-or-later", last + len(more)
        joined = last + 1 < end and s[last + 1] - e[last] == 1
        if joined and (mark == "-" or (mark == "." and 48 <= raw[s[last + 1]] <= 57)):
            return None
        return name, last

    def joined_identifiers(self, last: int, end: int, raw, s, e, words):
        """(name, first word, last word) of the identifiers that OR and AND join to an SPDX line that ends at word `last`."""
        while last + 2 < end and int(words[last + 1]) in self.joints and not (raw[e[last] : s[last + 2]] == 10).any():
            for name, want in self.identifiers:
                stop = last + 2 + len(want)
                if stop <= end and np.array_equal(words[last + 2 : stop], want):
                    break
            else:
                return
            begin, last = last + 2, stop - 1
            if name in GNU:
                if last + 2 < end and np.array_equal(words[last + 1 : last + 3], self.joints_later) and raw[e[last]] == ord("-"):
                    name, last = f"{name}-or-later", last + 2
            yield name, begin, last


def settle(matches: list[tuple[int, int, int, float, str]]) -> list[tuple[int, int, int, float, str]]:
    """Of (first, last, words of the template, coverage, name) those that stay where spans overlap."""
    owner: dict[int, tuple] = {}
    kept: set[tuple[int, int, int, float, str]] = set()
    for m in sorted(matches, key=lambda m: (-round(m[2] * m[3]), -m[3], m[0], m[4])):
        if all(owner.get(w, m[:4]) == m[:4] for w in range(m[0], m[1] + 1)):
            owner.update(dict.fromkeys(range(m[0], m[1] + 1), m[:4]))
            kept.add(m)
    return sorted(kept)


def _scan(templates, coverage, exact):
    match = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))
    held: list[Templates] = []

    def run(batches):
        if not held:
            held.append(Templates(templates, coverage, exact))
        table = held[0]
        for batch in batches:
            out = []
            for _, raw, offs in text_chunks(batch.column(1)):
                s, e, first, w = _word_hashes(raw, offs)
                found: list[list] = [[] for _ in range(len(offs) - 1)]
                for d, n, a, b, edits in table.spans(w, np.asarray(first)) if len(w) else ():
                    size, end = len(table.words[n]), int(first[d + 1])
                    row = raw[: offs[d + 1]]
                    kept = table.behind(n, b, end, row, s, e, w)
                    if kept:
                        found[d].append((a, kept[1], size, 1 - edits / size, kept[0]))
                        if table.spdx[n]:
                            found[d] += [(x, y, y - x + 1, 1.0, name) for name, x, y in table.joined_identifiers(kept[1], end, row, s, e, w)]
                points = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)] if any(found) else None
                for d, matches in enumerate(found):
                    rows = []
                    for a, b, _, share, name in settle(matches):
                        start, end = (int(points[x] - points[offs[d]]) for x in (s[a], e[b]))
                        rows.append({"license": name, "start": start, "end": end, "coverage": round(share, 4)})
                    out.append(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, match)], ["doc_id", "matches"])

    return run


def license_scan(spark: SparkSession, docs: DataFrame, templates=TEMPLATES, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", exact=EXACT) -> DataFrame:
    """One row per row: doc_id and matches, an array of license, start, end (code points), coverage."""
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scan(tuple(templates), coverage, tuple(exact)), f"doc_id {kind}, matches array<struct<license:string,start:bigint,end:bigint,coverage:double>>")

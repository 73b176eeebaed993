"""License scan (operator 6): matching statistics over a suffix automaton of license templates.

The templates' word sequences, joined by separators that no text holds, form one suffix automaton,
which is thereby generalised over all of them. A text's words stream through it: at each word the
automaton gives the longest template passage that ends there. Maximal passages of ``min_match``
words or more are chained per template, in order in both text and template, into covered template
spans. Of spans that lie over each other the one that covers most words stays, so that a license
which holds another's clauses, or names it and adds to it, gives its own label alone. A template
covered to ``min_coverage`` or more gives its label. Base phrases give theirs wherever their words
stand consecutively.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import text_column_udf

#: Base phrases and labels: fixed values.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Public license texts and notices with their labels: fixed values.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "This project is licensed under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache-2", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. Licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
)

MIN_MATCH = 4
MIN_COVERAGE = 0.6
MAX_GAP = 8

#: Bytes outside words become spaces; A-Z become a-z.
_TABLE = bytes((c + 32) if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def license_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class Automaton:
    """Suffix automaton over word numbers, with the template places of each state."""

    templates: list[tuple[str, list[bytes]]]
    number: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def __post_init__(self):
        last = 0
        for t, (_, words) in enumerate(self.templates):
            for k, w in enumerate(words):
                last = self._add(self.number.setdefault(w, len(self.number)), last)
                self.ends[last].append((t, k + 1))
            last = self._add(-1 - t, last)  # a separator
        for s in sorted(range(1, len(self.length)), key=lambda x: -self.length[x]):
            self.ends[self.link[s]].extend(self.ends[s])

    def _new(self, step: dict[int, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.step) - 1

    def _add(self, word: int, last: int) -> int:
        made = self._new({}, 0, self.length[last] + 1)
        at = last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = made
            at = self.link[at]
        if at >= 0:
            to = self.step[at][word]
            if self.length[to] == self.length[at] + 1:
                self.link[made] = to
            else:
                copy = self._new(dict(self.step[to]), self.link[to], self.length[at] + 1)
                while at >= 0 and self.step[at].get(word) == to:
                    self.step[at][word] = copy
                    at = self.link[at]
                self.link[to] = self.link[made] = copy
        return made

    def passages(self, ids: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
        """(first word, words, state) of each passage that the next word does not prolong."""
        out = []
        known = ids >= 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        for start, stop in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if stop - start < min_match:
                continue
            state = held = 0
            for at, w in enumerate(ids[start:stop].tolist(), start):
                grown = self.step[state].get(w)
                if grown is None:
                    if held >= min_match:
                        out.append((at - held, held, state))
                    while grown is None and state:
                        state = self.link[state]
                        held = self.length[state]
                        grown = self.step[state].get(w)
                if grown is None:
                    held = 0
                else:
                    state, held = grown, held + 1
            if held >= min_match:
                out.append((stop - held, held, state))
        return out


@dataclass
class Scanner:
    phrases: tuple = PHRASES
    templates: tuple = TEMPLATES
    min_match: int = MIN_MATCH
    min_coverage: float = MIN_COVERAGE
    max_gap: int = MAX_GAP

    def __post_init__(self):
        self.automaton = Automaton([(label, license_words(t)) for label, t in self.templates])
        self.base = [(b" " + b" ".join(license_words(p)) + b" ", label) for p, label in self.phrases]

    def spans(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """Covered template spans: (template, first word, word after the last, share of the template covered)."""
        auto = self.automaton
        get = auto.number.get
        found = auto.passages(np.fromiter((get(w, -1) for w in words), np.int64, len(words)), self.min_match)
        open_at: dict[int, list[int]] = {}  # template -> [first, end, template end, covered]
        out = []

        def close(t: int) -> None:
            first, end, _, covered = open_at.pop(t)
            out.append((t, first, end, covered / len(auto.templates[t][1])))

        for first, n, state in found:
            best: dict[int, tuple[int, int]] = {}  # template -> (words added to its chain, template end)
            for t, end in auto.ends[state]:
                chain = open_at.get(t)
                if chain and first - chain[1] <= self.max_gap:
                    # a passage may overlap the one before it by a few words, in text or template
                    added = min(n, first + n - chain[1], end - chain[2])
                    if added > best.get(t, (0, 0))[0]:
                        best[t] = (added, end)
            for t in {t for t, _ in auto.ends[state]}:
                if t in best:
                    added, end = best[t]
                    chain = open_at[t]
                    chain[1:] = [first + n, end, chain[3] + added]
                else:
                    if t in open_at:
                        close(t)
                    open_at[t] = [first, first + n, min(e for x, e in auto.ends[state] if x == t), n]
        for t in list(open_at):
            close(t)
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))

    def row(self, text: str | None) -> dict:
        words = license_words(text)
        joined = b" " + b" ".join(words) + b" "
        n_base, starts, base = 0, [], set()
        for phrase, label in self.base:
            at = joined.find(phrase)
            if at < 0:
                continue
            base.add(label)
            starts.append(joined.count(b" ", 0, at))
            last = at
            while at >= 0:
                n_base, last = n_base + 1, at
                at = joined.find(phrase, at + 1)
            starts.append(joined.count(b" ", 0, last))
        spans = best_cover(self.spans(words), [len(w) for _, w in self.automaton.templates], len(words))
        labels = base | {self.templates[t][0] for t, _, _, share in spans if share >= self.min_coverage}
        score = 1.0 if base else min(1.0, max((share for *_, share in spans), default=0.0))
        return {
            "n_words": len(words), "n_base": n_base, "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score,
            "spans": [{"label": self.templates[t][0], "first_word": a, "end_word": b, "coverage": c} for t, a, b, c in spans],
        }


def best_cover(spans: list[tuple[int, int, int, float]], lengths: list[int], n_words: int) -> list[tuple[int, int, int, float]]:
    """Spans that explain a text of ``n_words`` best: by template words covered, then by share of the template,
    each only where at most half of it lies under those taken before. A template inside a longer one thus
    gives way to it."""
    taken: list[tuple[int, int, int, float]] = []
    under = bytearray(n_words)
    for span in sorted(spans, key=lambda x: (-round(x[3] * lengths[x[0]]), -x[3], x[1], x[0])):
        _, first, end, _ = span
        if 2 * under.count(1, first, end) <= end - first:
            taken.append(span)
            under[first:end] = b"\1" * (end - first)
    return sorted(taken, key=lambda x: (x[1], x[2], x[0]))


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,end_word:long,coverage:double>>"


def license_columns(text: Column, **settings) -> Column:
    """Struct of a text column; see SCHEMA. ``settings`` are Scanner's."""

    def make():
        scanner = Scanner(**settings)

        def run(texts: list[str | None]) -> dict[str, list]:
            rows = [scanner.row(t) for t in texts]
            return {k: [r[k] for r in rows] for k in (rows[0] if rows else ())}

        return run

    return text_column_udf(SCHEMA, make)(text)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per document: id and the columns of SCHEMA.

    n_base counts all places of all phrases; first_word and last_word are the smallest and largest
    start among them, null where there is none. score is 1 with a base phrase, else the largest
    share of a template that one chain covers. Null text counts as empty: no words, empty labels,
    score 0. spans are those of best_cover. The automaton's size depends on the templates only; a text streams through it whole,
    in time linear in its words. No shuffle, so hot groups, repeated rows and ties do not matter;
    an empty table gives no rows; other columns are ignored.
    """
    return docs.select(F.col(id_col), license_columns(F.col(text_col), **settings).alias("x")).select(id_col, "x.*")

"""Licence scan: normalised text against licence templates by Dice coefficient of word bigrams.

Units are the single lines, the paragraphs (lines between blank lines), the whole text and runs of
consecutive lines, blank ones included.  A unit of n bigrams can reach Dice t only with templates
of t/(2-t) n to (2-t)/t n bigrams, so the size alone rules out most templates; an index from bigram
to templates then counts the common bigrams of the rest, and units without any are done at once.
At least t/(2-t) of a unit's bigrams are known to some template, so runs are only looked for where
known bigrams lie that close; of overlapping runs the best one counts.  One pass, nothing moves.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, text_or_empty

def _gnu(work: str, name: str, version: str, end: str) -> str:
    """The notice that the GNU licences ask for."""
    return (f"This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as "
            f"published by the Free Software Foundation, either version {version} of the License, or (at your option) any "
            f"later version. This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
            f"even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more "
            f"details. You should have received a copy of the GNU {name} along with this {work}{end}")


_SEE = ". If not, see <https://www.gnu.org/licenses/>."
_WRITE = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
    "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. ")
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. ")
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")


def _family(one_line: str, work: str, name: str, version: str) -> list[str]:
    """The one-line form, the notice without its closing paragraph and with either one in use."""
    both = [_gnu(work, name, version, end) for end in (_SEE, _WRITE)]
    return [one_line, both[0][:both[0].index(" You should have")], *both]


# FIXED VALUES: public licence notices; [...] stands for a holder's name or a year and matches nothing.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."],
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "GPL-3.0": _family("This work is licensed under the GNU General Public License, version 3.",
                       "program", "General Public License", "3"),
    "GPL-2.0": _family("This work is licensed under the GNU General Public License, version 2.",
                       "program", "General Public License", "2"),
    "LGPL-2.1": _family("This work is licensed under the GNU Lesser General Public License, version 2.1.",
                        "library", "Lesser General Public License", "2.1"),
    "LGPL-3.0": _family("This work is licensed under the GNU Lesser General Public License, version 3.",
                        "library", "Lesser General Public License", "3"),
    "AGPL-3.0": _family("This work is licensed under the GNU Affero General Public License, version 3.",
                        "program", "Affero General Public License", "3"),
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "BSD-2-Clause": [_BSD_HEAD, _BSD_HEAD + _BSD_END],
    "BSD-3-Clause": [_BSD_HEAD + _BSD_THIRD, _BSD_HEAD + _BSD_THIRD + _BSD_END],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
}

MATCH = T.StructType([T.StructField("license", T.StringType()), T.StructField("dice", T.DoubleType()),
                      T.StructField("first_line", T.IntegerType()), T.StructField("last_line", T.IntegerType())])

_WORD = re.compile(r"\w+")


def normalise(text: str) -> list[str]:
    """Lower-cased words; punctuation and white space only separate them."""
    return _WORD.findall(text.lower())


class TemplateIndex:
    """Templates by size, and by each of their bigrams."""

    def __init__(self, templates: dict[str, list[str]], threshold: float):
        items = []
        for name, texts in templates.items():
            for text in texts:
                words = normalise(text)
                items.append((len(words) - 1, name, Counter(zip(words, words[1:]))))
        self.items = sorted((x for x in items if x[0] > 0), key=lambda x: (x[0], x[1]))
        self.sizes = [x[0] for x in self.items]
        self.threshold = threshold
        self.bigrams: dict[tuple[str, str], list[int]] = {}
        self.most: Counter = Counter()  # how often a bigram can count
        for i, (_, _, grams) in enumerate(self.items):
            for g in grams:
                self.bigrams.setdefault(g, []).append(i)
            self.most |= grams

    def best(self, words: list[str]) -> tuple[str, float] | None:
        """The licence with the highest Dice of at least the threshold; of equals the first by name."""
        n, t = len(words) - 1, self.threshold
        if n < 1:
            return None
        lo = bisect_left(self.sizes, t / (2 - t) * n - 1e-9)
        hi = bisect_right(self.sizes, (2 - t) / t * n + 1e-9)
        if lo == hi:
            return None
        index = self.bigrams
        hits = [g for g in zip(words, words[1:]) if g in index]
        if 2 * len(hits) < t * (n + self.sizes[lo]) - 1e-9:
            return None  # too few bigrams known to any template
        have = Counter(hits)
        best = None
        for i in sorted({i for g in have for i in index[g] if lo <= i < hi}):
            size, name, grams = self.items[i]
            dice = 2 * sum(min(k, grams[g]) for g, k in have.items() if g in grams) / (n + size)
            if dice >= t and (best is None or (-dice, name) < best):
                best = (-dice, name)
        return best and (best[1], -best[0])

    def runs(self, lines: list[list[str]]) -> list[tuple[str, float, int, int]]:
        """Runs of lines that reach the threshold: licence, Dice, first and last line.  Of runs that
        overlap the best Dice counts for each template, then the most common bigrams times Dice."""
        t = self.threshold
        flat = [w for line in lines for w in line]
        if len(flat) < 2:
            return []
        index, share = self.bigrams, t / (2 - t)
        known = np.fromiter(map(index.__contains__, zip(flat, flat[1:])), bool, len(flat) - 1)
        if not known.any():
            return []
        # Places that lie in some stretch with at least that share of known bigrams.
        sums = np.append(0, np.cumsum(known - share))
        live = np.maximum.accumulate(sums[::-1])[::-1][1:] >= np.minimum.accumulate(sums)[:-1] - 1e-6
        edges = np.flatnonzero(np.diff(np.concatenate(([0], live.view(np.int8), [0])))).reshape(-1, 2)
        hits = np.append(0, np.cumsum(known))
        edges = edges[hits[edges[:, 1]] - hits[edges[:, 0]] >= share * self.sizes[0] - 1e-9]
        if not len(edges):
            return []
        numbers = [i for i, w in enumerate(lines) if w]
        ends = np.cumsum([len(lines[i]) for i in numbers]).tolist()
        starts = [0, *ends[:-1]]
        longest = self.sizes[-1] / share + 1e-9
        best: dict[tuple[int, int], tuple[float, int, int]] = {}  # by template and first line
        for p, q in edges.tolist():
            for a in range(bisect_left(starts, p), bisect_left(starts, q)):
                if ends[a] > q + 1 or hits[min(ends[a], q)] == hits[starts[a]]:
                    continue  # a run that begins with no known bigram is better without that line
                have, common, at, spare = {}, {}, starts[a], (1 - share) * longest
                for b in range(a, len(ends)):
                    n = ends[b] - starts[a] - 1
                    if n > longest or ends[b] > q + 1 or spare < 0:
                        break
                    for k in range(at, ends[b] - 1):
                        g = flat[k], flat[k + 1]
                        seen = have.get(g, 0) + 1
                        if seen > self.most[g]:
                            spare -= 1  # so many bigrams may be of no use to a run
                            continue
                        have[g] = seen
                        for i in index[g]:
                            if seen <= self.items[i][2][g]:
                                common[i] = common.get(i, 0) + 1
                    at = ends[b] - 1
                    for i, m in common.items():
                        dice = 2 * m / (n + self.sizes[i])
                        if dice >= t and ((i, a) not in best or dice > best[i, a][0]):
                            best[i, a] = dice, m, b
        found: list[tuple[float, float, int, int, int]] = []
        taken: dict[int, list[tuple[int, int]]] = {}
        for (i, a), (dice, m, b) in sorted(best.items(), key=lambda x: (-x[1][0], x[1][2] - x[0][1], x[0])):
            if _free(taken.setdefault(i, []), a, b):
                found.append((-dice * m, -dice, i, a, b))
        every: list[tuple[int, int]] = []
        return [(self.items[i][1], -dice, numbers[a], numbers[b])
                for _, dice, i, a, b in sorted(found, key=lambda x: (*x[:2], self.items[x[2]][1], x[3])) if _free(every, a, b)]


def _free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Adds the range to the sorted ones unless it overlaps one of them."""
    k = bisect_left(taken, (a, b))
    if (k and taken[k - 1][1] >= a) or (k < len(taken) and taken[k][0] <= b):
        return False
    taken.insert(k, (a, b))
    return True


def scan_text(text: str, index: TemplateIndex) -> list[dict]:
    """Matches of a text by line, paragraph, run of lines and as a whole, each range of lines once; a
    range that lies inside another with the same licence and no better Dice is left out."""
    lines = [normalise(line) for line in text.split("\n")]
    alone = [(i, i) for i, w in enumerate(lines) if len(w) > 1]
    paragraphs, start = [], None
    for i in range(len(lines) + 1):
        if i < len(lines) and lines[i]:
            start = i if start is None else start
        elif start is not None:
            paragraphs.append((start, i - 1))
            start = None
    whole = [(paragraphs[0][0], paragraphs[-1][1])] if paragraphs else []
    found = {}
    for a, b in dict.fromkeys(alone + paragraphs + whole):
        words = lines[a] if a == b else [w for line in lines[a:b + 1] for w in line]
        if hit := index.best(words):
            found[a, b] = hit
    runs = []
    for name, dice, a, b in index.runs(lines):
        runs.append((a, b))
        found.setdefault((a, b), (name, dice))
    # Ranges of one kind never overlap, so one of each kind at most holds a line.
    kinds = [sorted(r for r in kind if r in found) for kind in (paragraphs, runs, whole)]

    def holds(kind: list[tuple[int, int]], a: int, b: int) -> bool:
        k = bisect_right(kind, (a, len(lines))) - 1
        if k < 0 or kind[k] == (a, b) or kind[k][1] < b:
            return False
        return found[kind[k]][0] == found[a, b][0] and found[kind[k]][1] >= found[a, b][1]

    return [{"license": found[a, b][0], "dice": found[a, b][1], "first_line": a, "last_line": b}
            for a, b in sorted(found) if not any(holds(kind, a, b) for kind in kinds)]


def scan_licenses(docs: DataFrame, text_col: str = "text", out_col: str = "licenses", threshold: float = 0.8,
                  templates: dict[str, list[str]] | None = None) -> DataFrame:
    """``docs`` plus ``out_col``: an array of matches (license, dice, first and last line from 0).

    Texts are read whole; null and empty ones have no match, nor have units of one word.  Every
    row is returned once, whatever repeats.  A column of ``docs`` named ``out_col`` is replaced.
    """
    chosen = TEMPLATES if templates is None else templates
    others = [c for c in docs.columns if c != out_col]
    rows = docs.select(*[column(c) for c in others], text_or_empty(text_col).alias(out_col))
    at = len(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(chosen, threshold)
        kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_line", pa.int32()), ("last_line", pa.int32())]))
        for b in batches:
            found = pa.array([scan_text(t.as_py(), index) for t in b.column(at)], kind)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], found], names=b.schema.names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:at], T.StructField(out_col, T.ArrayType(MATCH))]))


def main_license(matches: str = "licenses") -> F.Column:
    """The best match of an array: highest Dice, then licence name, then line."""
    key = F.transform(matches, lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("l"),
                                                  m["first_line"].alias("f"), m["last_line"].alias("t")))
    return F.array_min(key)

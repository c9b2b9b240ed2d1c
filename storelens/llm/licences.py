"""Licence notices in texts: Dice coefficient of word bigrams against templates.

Units of a text are its lines, its paragraphs and the whole. A template of n distinct bigrams can only reach
a coefficient t with a unit that has between t/(2-t)*n and (2-t)/t*n of them, so a unit is only compared
with templates of about its own size.

With ``anywhere`` every run of words of a template's size counts, wherever it begins or ends. The best run begins
and ends with bigrams of the template, needs t/(2-t)*n of them, and may have (2-2t)/t*n others at most; only runs
that begin where so many follow in reach are counted out.
"""
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.textbytes import NOT_ALNUM, WHITE, chained, texts_in, words

#: Notices by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    # Paragraphs of the licences and of the headers they ask for. One that two licences share stands for both.
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
            "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
            "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
            "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
            "OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                   "implied. See the License for the specific language governing permissions and limitations under the "
                   "License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the License, "
                "or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version."),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at "
                "https://mozilla.org/MPL/2.0/."),
    *((name, text) for name in ("BSD-2-Clause", "BSD-3-Clause") for text in (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.")),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission."),
)


@dataclass(frozen=True)
class LicenceScan:
    """``least``: the coefficient that counts as a find. ``anywhere``: whether runs of words within a line, or over
    several, are compared too."""
    least: float = 0.9
    templates: tuple[tuple[str, str], ...] = field(default=TEMPLATES)
    anywhere: bool = False


def _bigrams(hashes: np.ndarray) -> np.ndarray:
    """Distinct word pairs; a single word stands for itself."""
    return np.unique(chained(hashes, 2)) if len(hashes) != 1 else chained(hashes, 1)


class _Templates:
    def __init__(self, scan: LicenceScan):
        self.names, self.sets, pairs = [], [], []
        for name, text in scan.templates:
            data = np.frombuffer(text.lower().encode(), np.uint8)
            self.names.append(name)
            hashes = words(data, np.array([0, len(data)]), NOT_ALNUM)[2]
            self.sets.append(_bigrams(hashes))
            pairs.append(len(hashes) - 1)
        self.sizes = np.array([len(s) for s in self.sets])
        t = scan.least
        self.low, self.high = np.ceil(self.sizes * t / (2 - t) - 1e-9), np.floor(self.sizes * (2 - t) / t + 1e-9)
        self.known = np.unique(np.concatenate(self.sets))
        self.least = t
        #: Pairs of a run, with those that repeat, and pairs in it that the template does not have.
        self.reach = np.maximum(self.high, np.floor(np.array(pairs) * (2 - t) / t + 1e-9)).astype(int)
        self.strange = self.sizes * (2 - 2 * t) / t + 1e-9
        self.members = [frozenset(own.tolist()) for own in self.sets]

    def best(self, unit: np.ndarray) -> Iterator[tuple[str, float]]:
        own = _bigrams(unit)
        for k in np.flatnonzero((self.low <= len(own)) & (len(own) <= self.high)):
            common = len(np.intersect1d(own, self.sets[k], assume_unique=True))
            dice = 2 * common / (len(own) + self.sizes[k])
            if dice >= self.least:
                yield self.names[k], dice


    def runs(self, pairs: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, str, int, int, float]]:
        """(text, licence, first pair, end, coefficient): for each pair that begins a find the best run from it on.

        ``text`` is the text of each pair, -1 for a pair of words of different texts.
        """
        places = np.flatnonzero(np.isin(pairs, self.known) & (text >= 0))
        values = pairs[places]
        for k, members in enumerate(self.members):
            least, reach, size = int(self.low[k]), int(self.reach[k]), int(self.sizes[k])
            own = places[np.isin(values, self.sets[k])]
            if reach < 1 or len(own) < least:
                continue
            ahead = own[least - 1:]
            begin = own[:len(ahead)]
            for at in begin[(ahead - begin < reach) & (text[begin] == text[ahead])].tolist():
                end = at + reach
                seen, common, best, stop = set(), 0, 0.0, at
                for i, (pair, owner) in enumerate(zip(pairs[at:end].tolist(), text[at:end].tolist()), at):
                    if owner != text[at]:
                        break
                    if pair in seen:
                        continue
                    seen.add(pair)
                    if pair in members:
                        common += 1
                        dice = 2 * common / (len(seen) + size)
                        if dice > best:
                            best, stop = dice, i + 1
                    elif len(seen) - common > self.strange[k]:
                        break
                if best >= self.least:
                    yield int(text[at]), self.names[k], at, stop, best


def _apart(finds: list[tuple[int, int, float]]) -> int:
    """How many finds do not overlap, when the best are taken first."""
    begins, ends = [], []
    for a, b, _ in sorted(set(finds), key=lambda x: (-x[2], x[1] - x[0], x[0])):
        k = bisect_left(begins, a)
        if (k == 0 or ends[k - 1] <= a) and (k == len(begins) or b <= begins[k]):
            begins.insert(k, a)
            ends.insert(k, b)
    return len(begins)


def _edges(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lines begin, and where paragraphs do (after a blank line), in addition to the texts."""
    line = np.flatnonzero(data == 10) + 1
    seen = np.append(0, np.cumsum(~WHITE[data]))
    blank = line[1:][seen[line[1:]] == seen[line[:-1]]]
    return np.union1d(starts, line), np.union1d(starts, blank)


def licences(docs: DataFrame, scan: LicenceScan = LicenceScan(), id_column: str = "doc_id",
             text: str = "text") -> DataFrame:
    """(doc_id, licence, dice, n_units): one row per text and licence found in it.

    dice is the best coefficient of any unit with any template of that licence, n_units the number of
    distinct units that reach ``least`` (a line that is a paragraph or the whole text counts once). With
    ``anywhere``, any run of words is a unit, and n_units counts those that do not overlap, the best first. Words are
    runs of letters and digits in lower case, any byte beyond ASCII counts as a letter. Null and empty texts
    and texts without a notice have no row; a null id is kept; repeated rows give repeated rows. Other
    columns are not read.
    """
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = _Templates(scan)
        smallest, largest = templates.low.min() + 1, templates.high.max() + 1
        for batch in batches:
            lower = pa.RecordBatch.from_arrays([pc.utf8_lower(batch.column("text"))], names=["text"])
            rows = []
            for first, last, data, starts in texts_in(lower, "text"):
                begin, _, hashes, at = words(data, starts, NOT_ALNUM)
                pair_known = np.append(0, np.cumsum(np.isin(chained(hashes, 2), templates.known)))
                units = []
                for edges in (*_edges(data, starts), starts):
                    bound = np.searchsorted(begin, edges)
                    units.append(np.stack([bound[:-1], bound[1:]], axis=1))
                units = np.unique(np.concatenate(units), axis=0)
                # A unit of m words has m - 1 pairs at most, and repeats only lower the number of distinct ones.
                many = units[:, 1] - units[:, 0]
                units, many = units[many >= smallest - 1], many[many >= smallest - 1]
                end = np.maximum(units[:, 1] - 1, units[:, 0])
                share = pair_known[end] - pair_known[units[:, 0]]
                # At least t/(2-t) of a template's pairs, hence of the smallest template's, must be in the unit.
                likely = (share >= templates.low.min()) | (many == 1)
                found: dict[tuple[int, str], list] = {}
                finds: dict[tuple[int, str], list] = {}
                for a, b in units[likely]:
                    own = chained(hashes[a:b], 2)
                    if len(np.unique(own)) > largest:
                        continue
                    i = int(np.searchsorted(at, a, "right")) - 1
                    for name, dice in dict(sorted(templates.best(hashes[a:b]), key=lambda x: x[1])).items():
                        entry = found.setdefault((first + i, name), [0.0, 0])
                        entry[0] = max(entry[0], dice)
                        entry[1] += 1
                        finds.setdefault((first + i, name), []).append((int(a), int(b), dice))
                if scan.anywhere and len(hashes) > 1:
                    owner = np.repeat(np.arange(last - first), np.diff(at))
                    inner = np.where(owner[1:] == owner[:-1], owner[1:], -1)
                    for i, name, a, b, dice in templates.runs(chained(hashes, 2), inner):
                        finds.setdefault((first + i, name), []).append((a, b + 1, dice))
                    found = {key: [max(d for _, _, d in own), _apart(own)] for key, own in finds.items()}
                rows += [(i, name, d, n) for (i, name), (d, n) in sorted(found.items())]
            if rows:
                i, name, dice, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(i, pa.int64())), pa.array(name), pa.array(dice, pa.float64()),
                     pa.array(n, pa.int64())], names=["doc_id", "licence", "dice", "n_units"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        per_task, f"doc_id {kind}, licence string, dice double, n_units bigint")

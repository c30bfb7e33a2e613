"""License scans by conditional compression.

Words that speak of licensing open a candidate block.  For every template that
has such words the block is laid around them, as far as a match that differs in
few enough words can reach.  It is compressed with the template as a raw
dictionary; every template that saves bytes is compared with it word for word,
and the one with most words in common is the block's license.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.common import pick, sliced

# Wordings of public licenses and notices.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "spdx-bsd-3-clause": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-gpl-3.0": "SPDX-License-Identifier: GPL-3.0-only",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."
    ),
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
}
CUE = re.compile(r"licen[cs]|copyright|all\s+rights\s+reserved|permission\s+(?:is\s+hereby|to\s+use)|redistribution\s+and\s+use|free\s+software|creative\s+commons", re.IGNORECASE)
WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
MOST_DIFFERENT = 0.15

SCHEMA = (
    "doc_id long, n_blocks long, n_confirmed long, licenses array<string>, "
    "matches array<struct<start:long,end:long,license:string,saved_bytes:int,reduction:double,missing:int,extra:int,wording:string>>"
)


def _words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = [(m.group().lower(), m.span()) for m in WORD.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]


def _cues(text: str, spans: list[tuple[int, int]]) -> list[tuple[str, int, int, int]]:
    """Kind, number of its first word, start and end of every cue."""
    starts = [a for a, _ in spans]
    return [("".join(m.group().lower().split())[:5], bisect_right(starts, m.start()) - 1, *m.span()) for m in CUE.finditer(text)]


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...]):
        import zstandard

        self.plain = zstandard.ZstdCompressor(level=3)
        self.templates = []
        for name, text in templates:
            data = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words, spans = _words(text)
            places = {(kind, k) for kind, k, _, _ in _cues(text, spans)}
            self.templates.append((name, words, Counter(words), places, zstandard.ZstdCompressor(level=3, dict_data=data)))

    def _differences(self, words: list[str], spans: list[tuple[int, int]], template: list[str]):
        """Missing and extra words of the best stretch of the block, its place, and the wording of the difference."""
        ops = difflib.SequenceMatcher(None, template, words, autojunk=False).get_opcodes()
        same = [o for o in ops if o[0] == "equal"]
        if not same:
            return None

        def cost(part):
            common = sum(o[2] - o[1] for o in part)
            return len(template) + part[-1][4] - part[0][3] - 2 * common

        # Words before and after the notice may be in the template by chance.
        while len(same) > 1 and min(cost(same[1:]), cost(same[:-1])) < cost(same):
            same = min(same[1:], same[:-1], key=cost)
        (_, i0, _, low, _), (_, _, i1, _, high) = same[0], same[-1]
        missing, extra, told = i0, 0, [f"-{w}" for w in template[:i0]]
        for tag, i, j, k, m in ops:
            if tag != "equal" and i0 <= i and j <= i1 and low <= k and m <= high:
                missing += j - i
                extra += m - k
                told += [f"-{w}" for w in template[i:j]] + [f"+{w}" for w in words[k:m]]
        missing += len(template) - i1
        told += [f"-{w}" for w in template[i1:]]
        return missing, extra, spans[low][0], spans[high - 1][1], " ".join(told)

    def block(self, text: str, words: list[str], spans: list[tuple[int, int]], kind: str, at: int, least: int):
        """The license of the block around the cue in word ``at``, from word ``least`` on, or None."""
        best, sizes = None, {}
        for name, template, counts, places, compressor in self.templates:
            slack = int(MOST_DIFFERENT * len(template))
            # A template without cues may lie anywhere around.
            reach = {(k + slack, len(template) - k + slack) for cue, k in places if cue == kind} if places else {(len(template) + slack, len(template) + slack)}
            for before, after in sorted(reach):
                low, high = max(least, at - before), min(len(words), at + after)
                # So many words of the template at least must be there.
                if sum((Counter(words[low:high]) & counts).values()) < len(template) - slack:
                    continue
                # White space does not count.
                data = " ".join(text[spans[low][0] : spans[high - 1][1]].split()).encode()
                if (low, high) not in sizes:
                    sizes[low, high] = len(self.plain.compress(data))
                saved = sizes[low, high] - len(compressor.compress(data))
                diff = self._differences(words[low:high], spans[low:high], template)
                if saved > 0 and diff and diff[0] + diff[1] <= MOST_DIFFERENT * len(template):
                    reduction = saved / max(sizes[low, high], 1)
                    rank = (len(template) - diff[0] - diff[1], reduction)
                    if best is None or rank > best[0]:
                        best = rank, {"start": diff[2], "end": diff[3], "license": name, "saved_bytes": saved, "reduction": reduction, "missing": diff[0], "extra": diff[1], "wording": diff[4]}
        return best and best[1]

    def scan(self, text: str) -> tuple[int, list[dict]]:
        """Number of candidate blocks, and the confirmed matches in order of place."""
        if not CUE.search(text):
            return 0, []
        blocks, out, done, least = 0, [], -1, 0
        words, spans = _words(text)
        ends = [e for _, e in spans]
        for kind, at, start, end in _cues(text, spans):
            if start < done:
                continue
            blocks += 1
            if match := self.block(text, words, spans, kind, at, least):
                out.append(match)
                done = match["end"]
                least = bisect_right(ends, done)
            else:
                done = end
        return blocks, out


@lru_cache(maxsize=4)
def scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(templates)


def license_scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs``: candidate blocks, confirmed ones, license names, and each match.

    A match has its place in code points, the bytes saved, their share, and the
    exact differences in wording.  Null and empty texts have no block; equal rows
    are scanned each on its own; whole texts are scanned.
    """
    chosen = tuple((templates or TEMPLATES).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(chosen)
        kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("saved_bytes", pa.int32()), ("reduction", pa.float64()), ("missing", pa.int32()), ("extra", pa.int32()), ("wording", pa.string())])
        for batch in sliced(batches, "text"):
            found = [scan.scan(x) if x else (0, []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([len(f[1]) for f in found], pa.int64()),
                    pa.array([sorted({m["license"] for m in f[1]}) for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.list_(kind)),
                ],
                names=["doc_id", "n_blocks", "n_confirmed", "licenses", "matches"],
            )

    return pick(docs, doc_id=doc_id, text=text).mapInArrow(run, SCHEMA)

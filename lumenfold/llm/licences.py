"""Licence scan: windows of the normalised text against licence templates by Dice coefficient over word bigrams.

A template of m bigrams meets the windows of m bigrams (fewer at a text's end) that begin where one of its bigrams does, whatever lines the words are on.
The coefficient is 2 * shared / (window's size + m), both being multisets. Sizes prune: it reaches t only if the window has at least t / (2 - t) * m
bigrams, of which at least as many are the template's, so a template whose bigrams a text hits less often is not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import table

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_CC = "Licensed under CC BY{} 4.0."
#: Licences and notices as their stewards word them, without names and years.
TEMPLATES = {
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "bsd-2-clause": f"{_BSD_TWO} {_BSD_END}",
    "bsd-3-clause": f"{_BSD_TWO} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0-notice": _CC.format(""),
    "cc-by-nc-4.0-notice": _CC.format("-NC"),
    "cc-by-nc-nd-4.0-notice": _CC.format("-NC-ND"),
    "cc-by-nc-sa-4.0-notice": _CC.format("-NC-SA"),
    "cc-by-nd-4.0-notice": _CC.format("-ND"),
    "cc-by-sa-4.0-notice": _CC.format("-SA"),
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit": f"{_MIT_GRANT} {_AS_IS} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-notice": "Released under the MIT License.",
    "mit-permission": _MIT_GRANT,
    "unlicense": f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_AS_IS}",
}
THRESHOLD = 0.85

#: A run of letters and digits; a dot between digits belongs to it.
_WORDS = re.compile(r"[^\W_]+(?:(?<=[0-9])\.(?=[0-9])[^\W_]+)*")


def words(text: str | None) -> list[str]:
    """The normalised text: its words in lower case."""
    return _WORDS.findall((text or "").lower())


class Templates:
    """Templates by bigram: (template, how often the template has the bigram), and their sizes."""

    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold, self.size = threshold, {}
        self.holding: dict[tuple[str, str], list[tuple[str, int]]] = defaultdict(list)
        for name, text in sorted(templates.items()):
            w = words(text)
            if len(w) > 1:
                self.size[name] = len(w) - 1
                for pair, n in Counter(zip(w, w[1:], strict=False)).items():
                    self.holding[pair].append((name, n))
        self.least = {k: math.ceil(threshold / (2 - threshold) * m - 1e-9) for k, m in self.size.items()}

    def scan(self, text: str | None) -> Iterator[tuple[str, float, int, int]]:
        """(licence, best coefficient, first word of that window, windows that reach the threshold) of a text."""
        w = words(text)
        hits: dict[str, list[tuple[int, tuple[str, str], int]]] = defaultdict(list)
        for at, pair in enumerate(zip(w, w[1:], strict=False)):
            if pair in self.holding:
                for name, n in self.holding[pair]:
                    hits[name].append((at, pair, n))
        for name, found in sorted(hits.items()):
            m = self.size[name]
            if len(found) < self.least[name]:
                continue
            held: Counter[tuple[str, str]] = Counter()
            shared, end, best, reach = 0, 0, (0.0, 0), 0
            for at, pair, n in found:  # a window begins at each hit; both its ends move on
                while end < len(found) and found[end][0] < at + m:
                    held[found[end][1]] += 1
                    shared += held[found[end][1]] <= found[end][2]
                    end += 1
                dice = 2 * shared / (min(m, len(w) - 1 - at) + m)
                reach += dice >= self.threshold
                best = max(best, (dice, -at))
                shared -= held[pair] <= n
                held[pair] -= 1
            if reach:
                yield name, best[0], -best[1], reach


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) as (doc_id, licence, dice, first_word, n_windows): every template that a window of the document reaches threshold with.

    dice is the best window's coefficient, first_word its first word (from 0, the first on ties), n_windows how many reach threshold. Null, empty and
    clean texts give no row, nor do texts of one word; rows that share a doc_id count as one document. Other columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, threshold)
        for batch in batches:
            rows = [(i, *hit) for i, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True) for hit in known.scan(text.as_py())]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "licence", "dice", "at", "n"])

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, licence string, dice double, at long, n long")
    best = F.min(F.struct((-F.col("dice")).alias("d"), "at")).alias("b")
    return found.groupBy("doc_id", "licence").agg(best, F.sum("n").alias("n_windows")).select("doc_id", "licence", F.round(-F.col("b.d"), 6).alias("dice"), F.col("b.at").alias("first_word"), "n_windows")


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all templates."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    texts = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
    before, after = r"regexp_replace({}, '(^|[^0-9])\.', '\1 ', 'g')", r"regexp_replace({}, '\.([^0-9]|$)', ' \1', 'g')"

    def listed(text: str) -> str:
        for step in (before, before, after, after):
            text = step.format(text if "regexp" in text else f"lower({text})")
        return rf"list_filter(string_split(regexp_replace({text}, '[^\p{{L}}\p{{N}}.]+', ' ', 'g'), ' '), lambda x: x <> '')"

    return f"""
WITH t AS (SELECT licence, {listed('notice')} AS w FROM (VALUES {texts}) n(licence, notice)),
tb AS (SELECT licence, len(w) - 1 AS m, w[i] || ' ' || w[i + 1] AS pair, count(*) AS n FROM t, unnest(range(1, len(w))) u(i) GROUP BY licence, m, pair),
d AS (SELECT row_number() OVER () AS no, doc_id, {listed('text')} AS w FROM documents WHERE text IS NOT NULL),
h AS (SELECT no, doc_id, size, i - 1 AS p, licence, m, pair, n FROM (SELECT no, doc_id, len(w) - 1 AS size, i, w[i] || ' ' || w[i + 1] AS pair FROM d, unnest(range(1, len(w))) u(i)) JOIN tb USING (pair)),
k AS (SELECT * FROM h JOIN (SELECT no, licence FROM h GROUP BY no, licence, m HAVING count(*) >= ceil({THRESHOLD} / (2 - {THRESHOLD}) * m - 1e-9)) USING (no, licence)),
s AS (SELECT a.no, a.doc_id, a.licence, a.p, a.m, a.size, b.pair, least(count(*), b.n) AS shared FROM k a JOIN k b ON a.no = b.no AND a.licence = b.licence AND b.p >= a.p AND b.p < a.p + a.m GROUP BY a.no, a.doc_id, a.licence, a.p, a.m, a.size, b.pair, b.n),
g AS (SELECT doc_id, licence, p, 2 * sum(shared)::DOUBLE / (least(m, size - p) + m) AS dice FROM s GROUP BY no, doc_id, licence, p, m, size)
SELECT doc_id, licence, round(max(dice), 6) AS dice, first(p ORDER BY dice DESC, p) AS first_word, count(*) AS n_windows FROM g WHERE dice >= {THRESHOLD} GROUP BY doc_id, licence
"""


OP2_SQL = _sql()

"""Operator 6: license scans by an exact set-similarity join.

Templates are whole public notices and the short lines that name a license. A text block of a template is any run of as
many words as the template has and a quarter more; it belongs to the template when it holds at least ``THRESHOLD`` of the
template's distinct words. So a short line must stand nearly word by word, and a long notice may have gaps, names and
years in it, but words strewn over a page make no match. The join that finds every such block works as prefix joins do:

1. the words of all templates are counted over all documents and put in global order, the rarest first;
2. of a template only a prefix of that order is indexed: a block that misses the whole prefix can't reach the threshold;
3. texts with too few of the template's words are left out (length filter), and those whose first match comes too late in
   either order to leave enough words (positional filter);
4. the rest is counted exactly, block by block along the places of the template's words.

The filters never lose a block, so labels don't depend on the counts, which only make the search cheap. The templates
are a fixed list, so they go to all tasks; the documents are never shuffled. The counts have one row per template word.

Base phrases are places where a phrase's words stand one after the other. Words are runs of digits, a-z and non-ASCII
characters after A-Z are lowered. Null text counts as empty: no words, no labels, score 0. The score is the largest
share of a template's words held by one of its blocks, 1 for a text with a base phrase, else 0.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import map_batches, raw_texts, slices

#: Fixed values of the contract.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Label and text of public license notices and of the lines by which texts name a license.
NOTICES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        "AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
        "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License version 3"),
    (
        "gpl",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR "
        "A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
)
#: As a fraction, so that it is exact.
THRESHOLD = (9, 10)

_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def block_length(template: list[bytes]) -> int:
    return len(template) + len(template) // 4


class Matcher:
    """Templates with their words in global order and an index of their prefixes."""

    def __init__(self, counts: dict[bytes, int], notices, phrases, threshold: tuple[int, int]):
        up, down = threshold
        texts = [(label, words_of(text.encode())) for label, text in notices]
        vocabulary = sorted({w for _, t in texts for w in t}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.templates, self.prefix = [], {}
        for k, (label, text) in enumerate(texts):
            own = sorted(set(text), key=self.rank.get)
            need = -(-up * len(own) // down)
            self.templates.append((label, own, need, block_length(text)))
            for i, w in enumerate(own[: len(own) - need + 1]):
                self.prefix.setdefault(w, []).append((k, i))
        self.phrases = [(p.encode().split(), label) for p, label in phrases]
        self.first = {p[0] for p, _ in self.phrases}

    def base(self, words: list[bytes]) -> list[tuple[int, str]]:
        if self.first.isdisjoint(words):
            return []
        return [(i, label) for i, w in enumerate(words) if w in self.first for p, label in self.phrases if words[i : i + len(p)] == p]

    def blocks(self, words: list[bytes]) -> dict[str, tuple[float, int]]:
        """Label to the largest share of a template's words in one of its blocks, and where the first such block begins."""
        if self.prefix.keys().isdisjoint(words):
            return {}
        places: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.rank:
                places.setdefault(w, []).append(i)
        held = sorted(places, key=self.rank.get)
        found: dict[str, list] = {}
        seen = set()
        for j, w in enumerate(held):
            for k, i in self.prefix.get(w, ()):
                label, own, need, length = self.templates[k]
                if k in seen or min(len(own) - i, len(held) - j) < need:
                    continue
                seen.add(k)
                here = [x for x in own[i:] if x in places]
                if len(here) >= need:
                    most, at = _fullest(sorted((p, x) for x in here for p in places[x]), length)
                    if most >= need:
                        found.setdefault(label, []).append((-most / len(own), k, at))
        return {label: (-min(x)[0], min(x)[2]) for label, x in found.items()}


def _fullest(placed: list[tuple[int, bytes]], length: int) -> tuple[int, int]:
    """The most distinct words within ``length`` places, and the first place of the first such run."""
    inside: dict[bytes, int] = {}
    best, left = (0, 0), 0
    for place, word in placed:
        inside[word] = inside.get(word, 0) + 1
        while place - placed[left][0] >= length:
            gone = placed[left][1]
            inside[gone] -= 1
            if not inside[gone]:
                del inside[gone]
            left += 1
        if len(inside) > best[0]:
            best = (len(inside), placed[left][0])
    return best


def word_counts(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """word, n_docs: in how many documents each template word stands."""
    vocabulary = {w for _, t in notices for w in words_of(t.encode())}

    def run(batches):
        counts = dict.fromkeys(sorted(vocabulary), 0)
        for batch in batches:
            for part in slices(batch):
                for text in raw_texts(part.column("text")):
                    for w in vocabulary.intersection(words_of(text)):
                        counts[w] += 1
        yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in counts], "n": list(counts.values())}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n_docs"))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("blocks", pa.string())])


def license_scan(docs: DataFrame, notices=NOTICES, phrases=PHRASES, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    # one row per word of the fixed templates
    counts = {r["word"].encode(): r["n_docs"] for r in word_counts(docs, notices).collect()}
    matcher = Matcher(counts, notices, phrases, threshold)

    def scan(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {f.name: [] for f in ARROW}
        out["doc_id"] = batch.column("doc_id")
        for text in raw_texts(batch.column("text")):
            words = words_of(text)
            base, found = matcher.base(words), matcher.blocks(words)
            labels = {label for _, label in base}
            out["n_words"].append(len(words))
            out["n_base"].append(len(base))
            out["first_word"].append(base[0][0] if base else None)
            out["last_word"].append(base[-1][0] if base else None)
            out["base_labels"].append(",".join(sorted(labels)))
            out["labels"].append(",".join(sorted(labels | found.keys())))
            out["score"].append(1.0 if base else max((share for share, _ in found.values()), default=0.0))
            out["blocks"].append(",".join(f"{label}:{at}" for label, (_, at) in sorted(found.items())))
        return out

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), scan, SCHEMA, ARROW)


def license_sql(notices=NOTICES, phrases=PHRASES, threshold: tuple[int, int] = THRESHOLD) -> str:
    """Brute force: every block that begins with a word of the template, every place against every phrase."""
    up, down = threshold
    listed = lambda s: "[" + ", ".join(f"'{w}'" for w in s) + "]"
    rows = [(label, [w.decode() for w in words_of(t.encode())]) for label, t in notices]
    ts = ", ".join(f"({k}, '{label}', {listed(sorted(set(t)))}, {block_length(t)})" for k, (label, t) in enumerate(rows))
    ps = ", ".join(f"('{label}', {listed(p.split())})" for p, label in phrases)
    return f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS rid,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
               FROM documents),
         t(k, label, own, size) AS (VALUES {ts}), p(label, own) AS (VALUES {ps}),
         places AS (SELECT rid, w, unnest(range(0, len(w))) AS i FROM d),
         base AS (SELECT rid, i, label FROM places, p WHERE w[i + 1] = own[1] AND w[i + 1 : i + len(own)] = own),
         base_by AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY rid),
         near AS (SELECT rid, w, k, label, own, size FROM d, t WHERE len(list_intersect(own, list_distinct(w))) * {down} >= len(own) * {up}),
         blocks AS (SELECT rid, k, label, len(own) AS n, i, len(list_intersect(own, list_distinct(w[i + 1 : i + size]))) AS common
                    FROM (SELECT *, unnest(range(0, len(w))) AS i FROM near) WHERE list_contains(own, w[i + 1])),
         met AS (SELECT rid, label, k, i, common / n AS share FROM blocks WHERE common * {down} >= n * {up}),
         top AS (SELECT rid, label, share, i FROM met QUALIFY row_number() OVER (PARTITION BY rid, label ORDER BY share DESC, k, i) = 1),
         labels AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM base UNION ALL SELECT rid, label FROM met) GROUP BY rid),
         best AS (SELECT rid, max(share) AS share, string_agg(label || ':' || i, ',' ORDER BY label) AS blocks FROM top GROUP BY rid)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
           CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score, coalesce(blocks, '') AS blocks
    FROM d LEFT JOIN base_by USING (rid) LEFT JOIN labels USING (rid) LEFT JOIN best USING (rid)"""

"""License scan by canonical digests.

A text is normalised - case, punctuation and layout, copyright lines, equivalent
spellings - and the digest of the whole is joined with the digests of known licence texts
and notices, normalised the same way.  What is looked up is each entire document, each
paragraph (between blank lines), each line, and each run of paragraphs inside a document
that has as many words as a known text of several paragraphs: a licence counts where one of
these is its entire text, never where it is only mentioned.  Of runs that begin with the
same paragraph the longest counts, and none inside of it.

The known texts are a fixed list, so their digests are broadcast.

Edge cases: null and empty texts, and those of copyright lines alone, have no digest; a
document with a licence twice is one row with both places counted; repeated doc_ids are
taken as one document; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from itertools import accumulate
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import pick, tidy, tuned

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

_GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."""


def _notices() -> list[tuple[str, str]]:
    """(licence, text) of short notices: usual phrasings times licence names."""
    names = {
        "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0"],
        "MIT": ["the MIT License", "MIT", "the terms of the MIT License"],
        "BSD-2-Clause": ["the BSD 2-Clause License"], "BSD-3-Clause": ["the BSD 3-Clause License"], "ISC": ["the ISC License"], "MPL-2.0": ["the Mozilla Public License, Version 2.0"],
        "Unlicense": ["the Unlicense"], "CC0-1.0": ["CC0 1.0"],
    }
    names |= {f"{short}-{v}": [f"the GNU {long}General Public License, version {v}", f"the GNU {short} version {v}", f"the GNU {short} v{v}"] for short, long, versions in (("GPL", "", (2, 3)), ("LGPL", "Lesser ", (3,)), ("AGPL", "Affero ", (3,))) for v in versions}
    parts = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
    names |= {f"CC-{p}-{v}": [f"CC {p} {v}", f"a Creative Commons {p} {v} License"] for p in parts for v in ("3.0", "4.0")}
    frames = ("Licensed under {}", "Released under {}", "This work is licensed under {}", "This work is released under {}", "Distributed under {}", "Available under {}")
    return [(k, f.format(n)) for k, forms in names.items() for n in forms for f in frames] + [(k, f"SPDX-License-Identifier: {k}") for k in names]


#: Licences whose entire texts are files; of the notices' licences, AGPL-3 and the CC-BY family have none.
FULL_TEXTS = ("Apache-2.0", "GPL-2", "GPL-3", "LGPL-3", "MPL-2.0", "CC0-1.0", "Unlicense")
_END = re.compile(r".*END OF TERMS AND CONDITIONS\s", re.DOTALL)


def full_texts() -> list[tuple[str, str]]:
    """(licence, entire text) of the licences in files: with and without what follows the terms, the line for an owner's name and the closing address, with http and https."""
    found: dict[str, tuple[str, str]] = {}
    for name in FULL_TEXTS:
        text = (Path(__file__).parent / "license_texts" / f"{name}.txt").read_text(encoding="utf-8")
        text = "\n".join(line for line in text.split("\n") if not _COPYRIGHT.fullmatch(line.lower()))
        forms = [text, text.replace("Copyright [yyyy] [name of copyright owner]", ""), text.partition("For more information, please refer to <")[0]]
        if end := _END.match(text):
            forms.append(end[0])
        for form in forms:
            for one in (form, form.replace("https://", "http://"), re.sub("https?://", "https://", form)):
                found.setdefault(digest(one), (name, one))
    return list(found.values())


def known_texts() -> list[tuple[str, str]]:
    """The fixed list of known licence texts and notices."""
    texts = [("MIT", _MIT), ("ISC", _ISC), ("BSD-2-Clause", _BSD_2 + _BSD_END), ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_END), ("Zlib", _ZLIB), ("Apache-2.0", _APACHE_HEADER)]
    texts += [(f"{short}-{v}", _GPL_HEADER.format(long, v)) for short, long, v in (("GPL", "", 2), ("GPL", "", 3), ("LGPL", "Lesser ", 3), ("AGPL", "Affero ", 3))]
    titles = {"MIT": "MIT License", "ISC": "ISC License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Zlib": "zlib License"}
    return texts + [(k, f"{titles[k]}\n\n{t}") for k, t in texts if k in titles] + full_texts() + _notices()


#: Spellings that count as the same word (fixed values).
EQUIVALENT = {
    "licence": "license", "licencee": "licensee", "licencees": "licensees", "licences": "licenses", "licenced": "licensed", "acknowledgement": "acknowledgment", "merchantibility": "merchantability", "organisation": "organization",
    "analyse": "analyze", "authorisation": "authorization", "authorised": "authorized", "colour": "color", "favour": "favor", "fulfil": "fulfill", "programme": "program",
    "sublicence": "sublicense", "noninfringement": "non infringement", "whilst": "while", "centre": "center", "judgement": "judgment", "recognise": "recognize", "v2": "2", "v3": "3",
}
_COPYRIGHT = re.compile(r"[^\w\n]*(?:copyright\s*(?:\(c\)|©|\d{4})|\(c\)\s*(?:copyright|\d{4})|©|all rights reserved).*")
_WORD = re.compile(r"[^\W_]+")
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")


def canonical(text: str) -> str:
    """Lower-cased words with usual spellings; punctuation, layout and copyright lines are gone."""
    low = text.lower()
    if "copyright" in low or "(c)" in low or "©" in low or "all rights" in low:
        low = "\n".join(line for line in low.split("\n") if not _COPYRIGHT.fullmatch(line.rstrip("\r")))
    return " ".join(EQUIVALENT.get(w, w) for w in _WORD.findall(low))


def digest(text: str) -> str | None:
    words = canonical(text)
    return hashlib.sha256(words.encode()).hexdigest() if words else None


def units(text: str) -> list[tuple[str, str]]:
    """(kind, text) of the document, its paragraphs and its lines, each a part of the one before only where it differs."""
    out = [("document", text)]
    paragraphs = [p for p in _BLANK.split(text) if p.strip()]
    if len(paragraphs) > 1:
        out += [("paragraph", p) for p in paragraphs]
    for p in paragraphs:
        lines = [x for x in p.split("\n") if x.strip()]
        if len(lines) > 1:
            out += [("line", x) for x in lines]
    return out


#: How many words a known text is looked up by before its digest is.
LEAD = 4


def run_table(known: list[tuple[str, str]]) -> dict[str, dict[int, set[str]]]:
    """Digests of the known texts of several paragraphs, by their first words and number of words."""
    out: dict[str, dict[int, set[str]]] = {}
    for _, text in known:
        words = canonical(text).split()
        if sum(bool(canonical(p)) for p in _BLANK.split(text)) > 1:
            out.setdefault(" ".join(words[:LEAD]), {}).setdefault(len(words), set()).add(digest(text))
    return out


def runs(text: str, table: dict[str, dict[int, set[str]]]) -> list[str]:
    """Digests of the runs of paragraphs that are known texts; the whole document is none."""
    parts = [words for p in _BLANK.split(text) if (words := canonical(p).split())]
    words = [w for p in parts for w in p]
    starts = [0, *accumulate(map(len, parts))]
    ends, out, free = set(starts), [], 0
    for a, first in zip(starts, starts[1:]):
        if a < free:
            continue
        lengths = table.get(" ".join(words[a : a + LEAD]), {})
        for n in sorted(lengths, reverse=True):
            if a + n in ends and (found := hashlib.sha256(" ".join(words[a : a + n]).encode()).hexdigest()) in lengths[n]:
                if n == len(words):
                    return []
                if a + n > first:
                    out.append(found)
                free = a + n
                break
    return out


ROWS = pa.schema([("doc_id", pa.int64()), ("unit", pa.string()), ("digest", pa.string())])


def unit_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: dict[str, dict[int, set[str]]] | None = None) -> DataFrame:
    """(doc_id, unit, digest) of every unit of every text, and of its runs of paragraphs that are in the table."""
    table = table or {}

    def run(batches):
        for batch in batches:
            ids, kinds, digests = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, unit in units(text or ""):
                    found = digest(unit)
                    if found:
                        ids.append(doc_id)
                        kinds.append(kind)
                        digests.append(found)
                for found in runs(text or "", table) if table else ():
                    ids.append(doc_id)
                    kinds.append("paragraphs")
                    digests.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(digests, pa.string())], schema=ROWS)

    return pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, unit string, digest string")


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, unit, n): the documents that hold an entire known text, as what, how often."""
    known = known or known_texts()
    table = {digest(text): name for name, text in known}
    table.pop(None, None)
    names = docs.sparkSession.createDataFrame(sorted(table.items()), "digest string, license string")
    met = unit_digests(docs, id_col, text_col, run_table(known)).join(F.broadcast(names), "digest")
    return met.groupBy("doc_id", "license", "unit").agg(F.count("*").alias("n"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(tuned(spark).read.parquet(f"{sf_dir}/documents.parquet"))

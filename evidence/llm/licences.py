"""Licence scans by sentence rules.

A text is cut into sentences (at line ends and after . ! ? ; : before white space), each normalised to its lower-case
words and numbers. Known licence sentences have identifiers; one may run over several of the text's cuts (a wrapped
line), but starts and ends at one. The identifiers in order of place are a sequence, in which rules are sought: the first
rule in the order of RULES that matches the identifiers at a place, one after another with no other known sentence
between, names a licence there, and the search goes on after it.

Sentences that say a licence's name (SAID, SPDX lines) are made from the names; the others are of the notices that licences
ask for. licence_scan() takes other tables of sentences and rules too.

Defined cases: null and empty texts hold no licence. Repeated rows are scanned alike, rows without doc_id too. Other
columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from evidence.llm.common import batch_of, rows, texts

# Sentences of public licence notices and their identifiers.
SENTENCES = {
    "Licensed under the Apache License, Version 2.0": "apache2-notice",
    "Licensed under the Apache License, Version 2.0 (the \"License\")": "apache2-notice",
    "you may not use this file except in compliance with the License": "apache2-compliance",
    "You may obtain a copy of the License at": "apache2-copy",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied": "apache2-warranty",
    "Released under the MIT License": "mit-notice",
    "Licensed under the MIT License": "mit-notice",
    "This project is licensed under the MIT License": "mit-notice",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions": "mit-grant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software": "mit-condition",
    "This work is licensed under the GNU General Public License, version 3": "gpl3-notice",
    "Licensed under the GNU General Public License, version 3": "gpl3-notice",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version": "gpl3-grant",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version": "gpl2-grant",
    "You should have received a copy of the GNU General Public License along with this program": "gpl-copy",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE": "gpl-warranty",
    "Licensed under CC BY-NC 4.0": "ccbync4-notice",
    "Licensed under CC BY 4.0": "ccby4-notice",
    "Licensed under CC BY-SA 4.0": "ccbysa4-notice",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "ccby4-notice",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "ccbysa4-notice",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "ccbync4-notice",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd-grant",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "bsd-source",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "bsd-binary",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl2-notice",
    "This is free and unencumbered software released into the public domain": "unlicense-grant",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT": "mit-warranty",
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE": "mit-liability",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED": "bsd-warranty",
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE": "bsd-liability",
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS": "isc-warranty",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/": "mpl2-copy",
    "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/": "mpl2-copy",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version": "lgpl21-grant",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version": "lgpl3-grant",
    "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE": "gpl-warranty",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version": "agpl3-grant",
    "You should have received a copy of the GNU Affero General Public License along with this program": "gpl-copy",
    "You should have received a copy of the GNU Lesser General Public License along with this program": "gpl-copy",
    "This software is provided 'as-is', without any express or implied warranty": "zlib-warranty",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions": "zlib-grant",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following": "boost-grant",
    "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work": "cc0-waiver",
}
# Names of licences as notices write them, and the sentences that say one.
NAMED = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "MIT": ["MIT License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"],
    "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, Version 2.0"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU General Public License v2.0"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU General Public License v3.0"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Zlib": ["zlib License"],
}
SAID = ["Licensed under the {}", "Released under the {}", "Distributed under the {}", "This project is licensed under the {}", "This work is licensed under the {}", "This software is licensed under the {}"]
# Identifiers of the SPDX list that a line of a source file may give.
SPDX = [*NAMED, "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "0BSD", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"]
for _licence, _names in NAMED.items():
    for _name in _names:
        for _form in SAID:
            SENTENCES.setdefault(_form.format(_name), f"said-{_licence}")
SENTENCES |= {f"SPDX-License-Identifier: {x}": f"spdx-{x}" for x in SPDX}
# Licences by sequences of sentence identifiers; longer rules before the shorter that they contain.
RULES = [
    ("Apache-2.0", ("apache2-notice", "apache2-compliance", "apache2-copy", "apache2-warranty")),
    ("Apache-2.0", ("apache2-notice", "apache2-compliance")),
    ("Apache-2.0", ("apache2-notice",)),
    ("MIT", ("mit-notice", "mit-grant", "mit-condition", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-notice", "mit-grant", "mit-condition")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("MIT", ("mit-notice",)),
    ("GPL-3.0-or-later", ("gpl3-grant", "gpl-warranty", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl3-grant",)),
    ("GPL-2.0-or-later", ("gpl2-grant", "gpl-warranty", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl2-grant",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("CC-BY-NC-4.0", ("ccbync4-notice",)),
    ("CC-BY-SA-4.0", ("ccbysa4-notice",)),
    ("CC-BY-4.0", ("ccby4-notice",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant", "isc-warranty")),
    ("0BSD", ("0bsd-grant",)),
    ("MPL-2.0", ("mpl2-notice", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-notice",)),
    ("LGPL-2.1-or-later", ("lgpl21-grant", "gpl-warranty", "gpl-copy")),
    ("LGPL-2.1-or-later", ("lgpl21-grant",)),
    ("LGPL-3.0-or-later", ("lgpl3-grant", "gpl-warranty", "gpl-copy")),
    ("LGPL-3.0-or-later", ("lgpl3-grant",)),
    ("AGPL-3.0-or-later", ("agpl3-grant", "gpl-warranty", "gpl-copy")),
    ("AGPL-3.0-or-later", ("agpl3-grant",)),
    ("Zlib", ("zlib-warranty", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("boost-grant",)),
    ("CC0-1.0", ("cc0-waiver",)),
    ("Unlicense", ("unlicense-grant",)),
    *((x, (f"said-{x}",)) for x in NAMED),
    *((x, (f"spdx-{x}",)) for x in SPDX),
]

_TOKEN = re.compile(r"[^\W_]+|\n|[.!?;:](?=\s|\Z)")
#: Every known sentence has one of these; a text without any is no further looked at.
_ANCHOR = re.compile(r"licen[cs]e|permi(?:ssion|tted)|redistribut|copyright|warrant|unencumbered|\bMPL\b", re.I)


def normalised(sentence: str) -> tuple[str, ...]:
    return tuple(t.lower() for t in _TOKEN.findall(sentence) if t[0].isalnum())


def _index(sentences: dict[str, str]) -> dict[tuple[str, ...], list[tuple[tuple[str, ...], str]]]:
    """Known sentences by their first two words, longest first."""
    out: dict[tuple[str, ...], list] = {}
    for sentence, name in sentences.items():
        ws = normalised(sentence)
        out.setdefault(ws[:2], []).append((ws, name))
    for found in out.values():
        found.sort(key=lambda x: -len(x[0]))
    return out


_KNOWN = _index(SENTENCES)


def sentence_ids(text: str, known: dict | None = None) -> list[tuple[str, int, int]]:
    """identifier, start and end (places of characters) of each known sentence, in order, none inside another.

    known: an index of other sentences, in which each text is sought whole.
    """
    if known is None and not _ANCHOR.search(text):
        return []
    known = _KNOWN if known is None else known
    tokens, spans, cut = [], [], {0}
    for m in _TOKEN.finditer(text):
        if m[0][0].isalnum():
            tokens.append(m[0].lower())
            spans.append(m.span())
        else:
            cut.add(len(tokens))
    cut.add(len(tokens))
    out, i = [], 0
    for i in sorted(cut):
        if out and i < out[-1][3]:
            continue
        for ws, name in known.get(tuple(tokens[i : i + 2]), ()):
            end = i + len(ws)
            if end in cut and tuple(tokens[i:end]) == ws:
                out.append((name, spans[i][0], spans[end - 1][1], end))
                break
    return [x[:3] for x in out]


def licences(ids: list[str], rules: list[tuple[str, tuple[str, ...]]] = RULES) -> list[tuple[str, int, int]]:
    """Licence, first and end place in ids of each rule that matches."""
    out, i = [], 0
    while i < len(ids):
        for name, rule in rules:
            if tuple(ids[i : i + len(rule)]) == rule:
                out.append((name, i, i + len(rule)))
                i += len(rule)
                break
        else:
            i += 1
    return out


_SCHEMA = "doc_id long, licence string, n_licences int, licences array<string>, sentences array<string>, first_start int, last_end int"


def licence_scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, tuple[str, ...]]] = RULES) -> DataFrame:
    """One row a document: the first licence, all distinct ones in order, the known sentences, where they start and end.

    sentences, rules: other tables than SENTENCES and RULES, of the same form; sentences of at least two words.
    """
    known = None if sentences is None else _index(sentences)
    arrow = pa.schema([("doc_id", pa.int64()), ("licence", pa.string()), ("n_licences", pa.int32()), ("licences", pa.list_(pa.string())), ("sentences", pa.list_(pa.string())), ("first_start", pa.int32()), ("last_end", pa.int32())])

    def run(batches):
        for part in rows(batches):
            out = []
            for doc_id, text in part:
                found = sentence_ids(text, known)
                names = list(dict.fromkeys(n for n, _, _ in licences([f[0] for f in found], rules)))
                out.append((doc_id, names[0] if names else None, len(names), names, [f[0] for f in found], found[0][1] if found else None, found[-1][2] if found else None))
            yield batch_of(out, arrow)

    return texts(docs).mapInArrow(run, _SCHEMA)

"""License scans by sentence rules.

A text is cut into fragments at line breaks and behind sentence ends. Fragments, alone or joined over line breaks, are
normalised (ASCII letters lower-cased, everything but letters and digits a single space) and looked up among known
licence sentences. The sequence of sentence identifiers so found is then matched against ordered licence rules: at each
place the first rule whose identifiers follow one another there wins and is passed over; an identifier that opens no rule
stays as a sentence without a licence. Between two sentences of one rule there may be GAP characters of other text, or as
many as the book allows for that licence. A wording may hold one slot, <holder>, for a name of up to SLOT_WORDS words. Tag
lines may hold whole expressions of licence identifiers (OR, AND, WITH, parentheses), each of whose licences is found.
Sentences and rules are a RuleBook, which a caller may extend or replace.

Defined results: null and empty texts have no sentences; null ids and repeated rows are each scanned; a text of any length
is scanned whole, in time linear in it; of several sentences that begin at one place the longest wins; of several rules the
first in order; columns of other names, whatever they are, are ignored; an empty table gives an empty result. Places are in
code points, end exclusive, without white space around them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_slices

# Sentences of public licences and of the notices that name them, by identifier.
SENTENCES = {
    "mit-released": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "Distributed under the MIT License."],
    "mit-title": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "mit-grant": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
    ],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-as-is": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "mit-liability": ["IN NO EVENT SHALL <holder> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "apache2-licensed": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License");', "Released under the Apache License, Version 2.0.", "This project is licensed under the Apache License 2.0."],
    "apache2-comply": ["you may not use this file except in compliance with the License."],
    "apache2-copy": ["You may obtain a copy of the License at"],
    "apache2-as-is": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "gpl3-licensed": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 3."],
    "gpl-redistribute": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "apache2-title": ["Apache License Version 2.0, January 2004"],
    "apache2-terms": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "apache2-grant": [
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."
    ],
    "apache2-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "gpl2-redistribute": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl2-licensed": ["Licensed under the GNU General Public License, version 2.", "Released under the GNU General Public License, version 2.", "This work is licensed under the GNU General Public License, version 2."],
    "gpl2-preamble": ["The licenses for most software are designed to take away your freedom to share and change it."],
    "gpl2-intent": ["By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."],
    "gpl3-title": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "gpl2-title": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "gpl3-preamble": ["The GNU General Public License is a free, copyleft license for software and other kinds of works."],
    "agpl3-preamble": ["The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."],
    "agpl3-redistribute": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl3-licensed": ["Licensed under the GNU Affero General Public License, version 3.", "Released under the GNU Affero General Public License, version 3."],
    "agpl-details": ["See the GNU Affero General Public License for more details."],
    "lgpl3-incorporates": ["This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."],
    "lgpl3-redistribute": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl21-redistribute": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ],
    "lgpl-licensed": ["Licensed under the GNU Lesser General Public License, version 3.", "Released under the GNU Lesser General Public License, version 3."],
    "lgpl-details": ["See the GNU Lesser General Public License for more details."],
    "mpl2-subject": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "mpl2-licensed": ["Licensed under the Mozilla Public License 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "Released under the Mozilla Public License 2.0."],
    "epl2-available": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "epl2-licensed": ["Licensed under the Eclipse Public License 2.0.", "Released under the Eclipse Public License 2.0."],
    "unlicense-dedicated": ["This is free and unencumbered software released into the public domain."],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-liable": ["In no event will the authors be held liable for any damages arising from the use of this software."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "zlib-removed": ["This notice may not be removed or altered from any source distribution."],
    "bsl1-title": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "bsl1-grant": [
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'
    ],
    "bsl1-distributed": ["Distributed under the Boost Software License, Version 1.0."],
    "bsd-as-is": [
        'THIS SOFTWARE IS PROVIDED BY <holder> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
    ],
    "bsd-liability": [
        "IN NO EVENT SHALL <holder> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ],
    "bsd-licensed": ["Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License.", "This project is licensed under the BSD 3-Clause License."],
    "isc-as-is": ['THE SOFTWARE IS PROVIDED "AS IS" AND <holder> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'],
    "cc0-dedicated": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."],
    "gpl-details": ["See the GNU General Public License for more details."],
    "bsd-redistribution": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": [
        "Neither the name of <holder> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Neither the name of <holder> nor the names of any contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Neither the names of <holder> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Neither the name of <holder> may be used to endorse or promote products derived from this software without specific prior written permission.",
        "The name of <holder> may not be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "cc-by-nc-4-licensed": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-4-licensed": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4-licensed": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
}
# Licence identifiers that a tag line may name.
TAGGED = [
    "MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "Unlicense", "Zlib", "BSL-1.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "CC0-1.0", "CC-BY-NC-4.0", "CC-BY-4.0", "CC-BY-SA-4.0",
]
# Rules in the order they are tried, longer ones of a licence first.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-released"]),
    ("Apache-2.0", ["apache2-title", "apache2-terms", "apache2-grant"]),
    ("Apache-2.0", ["apache2-terms", "apache2-grant"]),
    ("Apache-2.0", ["apache2-licensed", "apache2-comply", "apache2-copy", "apache2-as-is", "apache2-see"]),
    ("Apache-2.0", ["apache2-licensed", "apache2-comply", "apache2-copy", "apache2-as-is"]),
    ("Apache-2.0", ["apache2-licensed"]),
    ("GPL-3.0-only", ["gpl3-title", "gpl3-preamble"]),
    ("GPL-3.0-or-later", ["gpl-redistribute", "gpl-hope", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl-redistribute"]),
    ("GPL-3.0-only", ["gpl3-licensed"]),
    ("GPL-2.0-only", ["gpl2-title", "gpl2-preamble", "gpl2-intent"]),
    ("GPL-2.0-or-later", ["gpl2-redistribute", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl2-redistribute"]),
    ("GPL-2.0-only", ["gpl2-licensed"]),
    ("AGPL-3.0-or-later", ["agpl3-redistribute", "gpl-hope", "agpl-details"]),
    ("AGPL-3.0-or-later", ["agpl3-redistribute"]),
    ("AGPL-3.0-only", ["agpl3-preamble"]),
    ("AGPL-3.0-only", ["agpl3-licensed"]),
    ("LGPL-3.0-only", ["lgpl3-incorporates"]),
    ("LGPL-3.0-or-later", ["lgpl3-redistribute"]),
    ("LGPL-2.1-or-later", ["lgpl21-redistribute"]),
    ("LGPL-3.0-only", ["lgpl-licensed"]),
    ("MPL-2.0", ["mpl2-subject", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-subject"]),
    ("MPL-2.0", ["mpl2-licensed"]),
    ("EPL-2.0", ["epl2-available"]),
    ("EPL-2.0", ["epl2-licensed"]),
    ("Unlicense", ["unlicense-dedicated", "unlicense-anyone"]),
    ("Unlicense", ["unlicense-dedicated"]),
    ("Zlib", ["zlib-as-is", "zlib-liable", "zlib-grant", "zlib-removed"]),
    ("Zlib", ["zlib-as-is", "zlib-liable", "zlib-grant"]),
    ("BSL-1.0", ["bsl1-title", "bsl1-grant"]),
    ("BSL-1.0", ["bsl1-grant"]),
    ("BSL-1.0", ["bsl1-distributed"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-liability"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-licensed"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("ISC", ["isc-grant"]),
    ("CC0-1.0", ["cc0-dedicated"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-licensed"]),
    ("CC-BY-4.0", ["cc-by-4-licensed"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-licensed"]),
    ("MIT", ["mit-title"]),
    *((name, [f"tag-{name}"]) for name in TAGGED),
]
# Older names of licences in tag lines.
RENAMED = {
    "GPL-2.0": "GPL-2.0-only", "GPL-2.0+": "GPL-2.0-or-later", "GPL-3.0": "GPL-3.0-only", "GPL-3.0+": "GPL-3.0-or-later", "LGPL-2.1": "LGPL-2.1-only", "LGPL-2.1+": "LGPL-2.1-or-later",
    "LGPL-3.0": "LGPL-3.0-only", "LGPL-3.0+": "LGPL-3.0-or-later", "AGPL-3.0": "AGPL-3.0-only", "AGPL-3.0+": "AGPL-3.0-or-later",
}
#: Characters of other text between two sentences of a rule; a clause of a licence is longer.
GAP = 120
# Of licences whose known sentences are further apart.
GAPS = {"Apache-2.0": 30_000, "GPL-3.0-only": 1_000, "GPL-2.0-only": 2_500, "Zlib": 1_000, "BSL-1.0": 300, "Unlicense": 300, "MPL-2.0": 300}
#: Words that a slot may take.
SLOT, SLOT_WORDS = "<holder>", 16
#: A text that holds none of these needs no cutting: every known sentence must hold one.
CUES = ["licen", "permission", "redistribut", "copyright", "warrant", "terms and conditions", "public domain", "free to copy", "held liable", "a copy of the mpl", "this notice may not", "in no event shall"]

_PLAIN = re.compile(r"[^a-z0-9]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_STOPS = re.compile(r"[.!?;:]+")


def normalised(sentence: str) -> str:
    return _PLAIN.sub(" ", sentence.translate(_LOWER)).strip()


def fragments(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each piece between line breaks and behind sentence ends that white space follows."""
    at = 0
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        for m in _STOPS.finditer(text, at, end):
            if m.end() == end or text[m.end()].isspace():
                yield at, m.end()
                at = m.end()
        yield at, end
        at = end + 1


@dataclass(frozen=True)
class RuleBook:
    """sentences: by identifier, its wordings. rules: (licence, identifiers in order), in the order they are tried.

    gaps: by licence, characters between two sentences of a rule, where not GAP. cues: lower-case; each wording must hold one, else a ValueError, since only texts with a cue are cut."""

    sentences: dict[str, list[str]]
    rules: list[tuple[str, list[str]]]
    cues: list[str]
    gaps: dict[str, int] = field(default_factory=dict)
    known: dict[str, str] = field(init=False)
    prefixes: frozenset[str] = field(init=False)
    #: By first word: identifier, and the words before and behind the slot.
    slots: dict[str, list[tuple[str, list[str], list[str]]]] = field(init=False)

    def __post_init__(self) -> None:
        known = {normalised(s): k for k, wordings in self.sentences.items() for s in wordings if SLOT not in s}
        slots: dict[str, list[tuple[str, list[str], list[str]]]] = {}
        for k, wordings in self.sentences.items():
            for s in wordings:
                if SLOT in s:
                    head, tail = (normalised(part).split() for part in s.split(SLOT))
                    if not head or not tail:
                        raise ValueError(f"a slot at an end of {s!r}")
                    slots.setdefault(head[0], []).append((k, head, tail))
        object.__setattr__(self, "slots", slots)
        if without := [s for wordings in self.sentences.values() for s in wordings if not any(c in s.translate(_LOWER) for c in self.cues)]:
            raise ValueError(f"no cue in {without}")
        if unknown := {i for _, ids in self.rules for i in ids} - set(self.sentences):
            raise ValueError(f"rules name unknown sentences {sorted(unknown)}")
        words = [s.split() for s in known]
        object.__setattr__(self, "known", known)
        object.__setattr__(self, "prefixes", frozenset(" ".join(w[: i + 1]) for w in words for i in range(len(w))))


def standard_rules() -> RuleBook:
    tags = {f"tag-{name}": [f"SPDX-License-Identifier: {name}"] for name in TAGGED}
    return RuleBook(SENTENCES | tags, RULES, CUES, GAPS)


STANDARD = standard_rules()


_TAG = "spdx license identifier"
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+-]+")


def tagged(expression: str, book: RuleBook) -> list[str]:
    """Identifiers of the tag sentences for each licence of a tag line's expression; none if it is not well formed."""
    names, want_name, skip = [], True, False
    for token in _TOKEN.findall(expression.rstrip("*/->#; \t\r")):
        if token in "()":
            continue
        if token in ("OR", "AND", "WITH"):
            if want_name:
                return []
            want_name, skip = True, token == "WITH"
            continue
        if not want_name:
            return []
        if not skip:
            names.append(RENAMED.get(token, token))
        want_name = skip = False
    return [] if want_name else [f"tag-{n}" for n in names if f"tag-{n}" in book.sentences]


def _slotted(pieces: list[tuple[str, int, int]], i: int, book: RuleBook) -> tuple[str, int] | None:
    """The sentence with a slot that begins at piece i, and the piece behind it."""
    for name, head, tail in book.slots.get(pieces[i][0].split(" ", 1)[0], []):
        words: list[str] = []
        most = len(head) + SLOT_WORDS + len(tail)
        for j in range(i, len(pieces)):
            if len(pieces[j][0]) > 64 * most:
                break
            words += pieces[j][0].split()
            if len(words) > most or words[: len(head)] != head[: len(words)]:
                break
            if len(words) > len(head) + len(tail) and words[-len(tail) :] == tail and " ".join(head) not in " ".join(words[len(head) :]):
                return name, j + 1
    return None


def sentences(text: str, book: RuleBook = STANDARD) -> list[tuple[str, int, int]]:
    """Known sentences of text in order: identifier, start, end. The longest at a place wins."""
    low = text.translate(_LOWER) if text.isascii() else text.lower()
    if not any(c in low for c in book.cues):
        return []
    pieces = []
    for start, end in fragments(text):
        if plain := normalised(text[start:end]):
            part = text[start:end]
            pieces.append((plain, start + len(part) - len(part.lstrip()), end - len(part) + len(part.rstrip())))
    out, i = [], 0
    while i < len(pieces):
        joined, best, j = "", None, i
        while j < len(pieces):
            joined = f"{joined} {pieces[j][0]}" if joined else pieces[j][0]
            if joined not in book.prefixes:
                break
            j += 1
            if joined in book.known:
                best = (book.known[joined], j)
        slotted = _slotted(pieces, i, book)
        if slotted and (not best or slotted[1] > best[1]):
            best = slotted
        if not best and pieces[i][0] == _TAG and i + 1 < len(pieces) and "\n" not in text[pieces[i][2] : pieces[i + 1][1]]:
            names = tagged(text[pieces[i + 1][1] : pieces[i + 1][2]], book)
            out += [(name, pieces[i][1], pieces[i + 1][2]) for name in names]
            i += 2 if names else 1
            continue
        if best:
            out.append((best[0], pieces[i][1], pieces[best[1] - 1][2]))
            i = best[1]
        else:
            i += 1
    return out


def licenses(found: list[tuple[str, int, int]], book: RuleBook = STANDARD) -> list[str]:
    """Licences of the sentences of a text (identifier, start, end), by the ordered rules."""
    out, i = [], 0
    names = [k for k, _, _ in found]
    while i < len(found):
        for licence, rule in book.rules:
            far = book.gaps.get(licence, GAP)
            if names[i : i + len(rule)] == rule and all(found[k + 1][1] - found[k][2] <= far for k in range(i, i + len(rule) - 1)):
                out.append(licence)
                i += len(rule)
                break
        else:
            i += 1
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", book: RuleBook = STANDARD) -> DataFrame:
    """key, n_sentences, sentences (identifier:start:end, in order), licenses (distinct, sorted) of each row."""
    kind = docs.select(key).schema[0].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for body in batch.column("_text").to_pylist():
            found = sentences(body, book)
            rows.append((len(found), ",".join(f"{k}:{s}:{e}" for k, s, e in found), ",".join(sorted(set(licenses(found, book))))))
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
        return pa.RecordBatch.from_arrays([batch.column(key), *columns], [key, "n_sentences", "sentences", "licenses"])

    rows = docs.select(key, F.make_valid_utf8(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    return map_slices(rows, "_text", work, f"`{key}` {kind}, n_sentences long, sentences string, licenses string")

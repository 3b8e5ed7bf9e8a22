"""Licence scans by sentence-rule recognition.

A text becomes a sequence of normalised words (lower case, letters and digits only, variant spellings
unified), so that line breaks, punctuation and comment marks count as spaces. Known licence sentences are
found in it as word sequences, wherever they stand, the longest first, none over another; a sentence doesn't
count after a negation, or where its last word goes on ("MIT-0", "version 3.1", "version 3 or"). The
document's identifiers in order are then matched against ordered licence rules: a rule fits where its
identifiers stand in that order with at most ``gap`` other known sentences between two of them. Rules
are tried from the most specific (longest) on, and a sentence used by one rule is not used by a later one.

Defined cases: null, empty and licence-free texts give empty arrays; repeated rows stay repeated;
very long texts are worked through whole; an empty table gives no rows; columns beside key and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Known licence sentences (identifier, sentence).
SENTENCES: list[tuple[str, str]] = [
    ("apache2-short", "Licensed under the Apache License, Version 2.0."),
    ("apache2-grant", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("apache2-compliance", "you may not use this file except in compliance with the License."),
    ("apache2-copy", "You may obtain a copy of the License at"),
    ("apache2-url", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache2-asis", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("mit-short", "Released under the MIT License."),
    ("mit-licensed", "Licensed under the MIT License."),
    ("mit-title", "The MIT License (MIT)"),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("gpl3-short", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-redistribute-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-redistribute-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-no-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("ccbync4-short", "Licensed under CC BY-NC 4.0."),
    ("ccby4-short", "Licensed under CC BY 4.0."),
    ("ccbysa4-short", "Licensed under CC BY-SA 4.0."),
    ("cc0-short", "Licensed under CC0 1.0."),
    ("bsd3-short", "Licensed under the BSD 3-Clause License."),
    ("bsd-conditions", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("mpl2-short", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("spdx-apache2", "SPDX-License-Identifier: Apache-2.0"),
    ("spdx-mit", "SPDX-License-Identifier: MIT"),
    ("spdx-gpl3", "SPDX-License-Identifier: GPL-3.0-only"),
    ("mit-asis", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("apache2-limits", "See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-details", "See the GNU General Public License for more details."),
    ("lgpl-redistribute-21", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-redistribute-3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-no-warranty", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("lgpl-details", "See the GNU Lesser General Public License for more details."),
    ("agpl-redistribute-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-details", "See the GNU Affero General Public License for more details."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("isc-asis", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-advertise", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("bsd-asis", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("mpl2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense-free", "This is free and unencumbered software released into the public domain."),
    ("unlicense-anyone", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib-asis", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("boost-short", "Distributed under the Boost Software License, Version 1.0."),
    ("epl2-available", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("wtfpl-terms", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION"),
    # second forms: the grant cut short, and the endorsement with a named holder
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'),
    ("bsd-endorse", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
]
# Ordered licence rules (licence, sentence identifiers in order).
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-2.0", ("apache2-grant", "apache2-compliance", "apache2-copy", "apache2-url", "apache2-asis")),
    ("Apache-2.0", ("apache2-grant", "apache2-compliance")),
    ("Apache-2.0", ("apache2-short",)),
    ("Apache-2.0", ("spdx-apache2",)),
    ("MIT", ("mit-title", "mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("spdx-mit",)),
    ("GPL-3.0-or-later", ("gpl-redistribute-3", "gpl-no-warranty")),
    ("GPL-2.0-or-later", ("gpl-redistribute-2", "gpl-no-warranty")),
    ("GPL-3.0-only", ("gpl3-short",)),
    ("GPL-3.0-only", ("spdx-gpl3",)),
    ("CC-BY-NC-4.0", ("ccbync4-short",)),
    ("CC-BY-4.0", ("ccby4-short",)),
    ("CC-BY-SA-4.0", ("ccbysa4-short",)),
    ("CC0-1.0", ("cc0-short",)),
    ("BSD-3-Clause", ("bsd-conditions", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd3-short",)),
    ("BSD-2-Clause", ("bsd-conditions",)),
    ("MPL-2.0", ("mpl2-short",)),
    ("Apache-2.0", ("apache2-grant", "apache2-compliance", "apache2-copy", "apache2-url", "apache2-asis", "apache2-limits")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("MPL-2.0", ("mpl2-short", "mpl2-copy")),
    ("GPL-3.0-or-later", ("gpl-redistribute-3", "gpl-no-warranty", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl-redistribute-2", "gpl-no-warranty", "gpl-details")),
    ("LGPL-2.1-or-later", ("lgpl-redistribute-21", "lgpl-no-warranty", "lgpl-details")),
    ("LGPL-2.1-or-later", ("lgpl-redistribute-21", "lgpl-no-warranty")),
    ("LGPL-3.0-or-later", ("lgpl-redistribute-3", "lgpl-no-warranty", "lgpl-details")),
    ("LGPL-3.0-or-later", ("lgpl-redistribute-3", "lgpl-no-warranty")),
    ("AGPL-3.0-or-later", ("agpl-redistribute-3", "gpl-no-warranty", "agpl-details")),
    ("AGPL-3.0-or-later", ("agpl-redistribute-3", "gpl-no-warranty")),
    ("ISC", ("isc-grant", "isc-asis")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant", "isc-asis")),
    ("BSD-4-Clause", ("bsd-conditions", "bsd-source", "bsd-binary", "bsd-advertise", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-conditions", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis")),
    ("BSD-3-Clause", ("bsd-conditions", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-conditions", "bsd-source", "bsd-binary", "bsd-asis")),
    ("BSD-2-Clause", ("bsd-conditions", "bsd-source", "bsd-binary")),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Unlicense", ("unlicense-free",)),
    ("Zlib", ("zlib-asis", "zlib-grant")),
    ("BSL-1.0", ("boost-short",)),
    ("EPL-2.0", ("epl2-available",)),
    ("WTFPL", ("wtfpl-terms",)),
]
# Licences by identifier and full name.
NAMES: list[tuple[str, str]] = [
    ("AFL-3.0", "Academic Free License v3.0"), ("AGPL-3.0-only", "GNU Affero General Public License v3.0 only"), ("AGPL-3.0-or-later", "GNU Affero General Public License v3.0 or later"),
    ("Apache-1.1", "Apache License 1.1"), ("Apache-2.0", "Apache License 2.0"), ("APSL-2.0", "Apple Public Source License 2.0"), ("Artistic-2.0", "Artistic License 2.0"),
    ("BSD-2-Clause", 'BSD 2-Clause "Simplified" License'), ("BSD-3-Clause", 'BSD 3-Clause "New" or "Revised" License'), ("BSD-4-Clause", 'BSD 4-Clause "Original" or "Old" License'),
    ("BSL-1.0", "Boost Software License 1.0"), ("BUSL-1.1", "Business Source License 1.1"), ("CC-BY-3.0", "Creative Commons Attribution 3.0 Unported"), ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution Non Commercial 4.0 International"), ("CC-BY-ND-4.0", "Creative Commons Attribution No Derivatives 4.0 International"), ("CC-BY-SA-3.0", "Creative Commons Attribution Share Alike 3.0 Unported"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution Share Alike 4.0 International"), ("CC0-1.0", "Creative Commons Zero v1.0 Universal"), ("CDDL-1.0", "Common Development and Distribution License 1.0"), ("CPL-1.0", "Common Public License 1.0"),
    ("ECL-2.0", "Educational Community License v2.0"), ("EPL-1.0", "Eclipse Public License 1.0"), ("EPL-2.0", "Eclipse Public License 2.0"), ("EUPL-1.2", "European Union Public License 1.2"),
    ("GFDL-1.3-only", "GNU Free Documentation License v1.3 only"), ("GPL-2.0-only", "GNU General Public License v2.0 only"), ("GPL-2.0-or-later", "GNU General Public License v2.0 or later"),
    ("GPL-3.0-only", "GNU General Public License v3.0 only"), ("GPL-3.0-or-later", "GNU General Public License v3.0 or later"), ("IPL-1.0", "IBM Public License v1.0"), ("ISC", "ISC License"),
    ("LGPL-2.1-only", "GNU Lesser General Public License v2.1 only"), ("LGPL-2.1-or-later", "GNU Lesser General Public License v2.1 or later"), ("LGPL-3.0-only", "GNU Lesser General Public License v3.0 only"),
    ("LGPL-3.0-or-later", "GNU Lesser General Public License v3.0 or later"), ("LPPL-1.3c", "LaTeX Project Public License v1.3c"), ("MIT", "MIT License"), ("MPL-1.1", "Mozilla Public License 1.1"), ("MPL-2.0", "Mozilla Public License 2.0"),
    ("MS-PL", "Microsoft Public License"), ("MS-RL", "Microsoft Reciprocal License"), ("ODbL-1.0", "Open Data Commons Open Database License v1.0"), ("OFL-1.1", "SIL Open Font License 1.1"), ("OSL-3.0", "Open Software License 3.0"),
    ("PHP-3.01", "PHP License v3.01"), ("PostgreSQL", "PostgreSQL License"), ("PSF-2.0", "Python Software Foundation License 2.0"), ("Ruby", "Ruby License"), ("SSPL-1.0", "Server Side Public License, v 1"),
    ("Unlicense", "The Unlicense"), ("UPL-1.0", "Universal Permissive License v1.0"), ("WTFPL", "Do What The F*ck You Want To Public License"), ("Zlib", "zlib License"), ("ZPL-2.1", "Zope Public License 2.1"),
]
# How a text names its licence; {id} and {name} stand for a licence's.
PHRASES: list[tuple[str, str]] = [
    ("licensed", "Licensed under the {name}"),
    ("released", "Released under the {name}"),
    ("distributed", "Distributed under the {name}"),
    ("available", "made available under the {name}"),
    ("terms", "under the terms of the {name}"),
    ("conditions", "subject to the terms of the {name}"),
    ("governed", "governed by the {name}"),
    ("spdx", "SPDX-License-Identifier: {id}"),
]
# Spellings that count as one word.
VARIANTS = {"licence": "license", "licenced": "licensed", "licences": "licenses", "https": "http"}

# A sentence doesn't count behind these words ("isn't" ends in a word t), or with these behind it.
NEGATIONS = {"not", "never", "t"}
NOT_BEFORE = {"gpl3-short": {"or"}}

_WORD = re.compile(r"[a-z0-9]+")
#: What makes a last word another one: a further part of its name or number.
_GOES_ON = re.compile(r"[-_][a-z0-9]|\.[0-9]|\+")
#: Comment marks that are words.
_MARK = re.compile(r"^[ \t]*@?(?:dnl|rem)\b", re.MULTILINE)


def normalise(sentence: str) -> str:
    return " ".join(VARIANTS.get(w, w) for w in _WORD.findall(sentence.lower()))


def named() -> tuple[list[tuple[str, str]], list[tuple[str, tuple[str, ...]]]]:
    """Sentences and rules of every licence in every phrase, but for the sentences that are known already."""
    known = {normalise(s) for _, s in SENTENCES}
    sentences, rules = [], []
    for spdx, name in NAMES:
        for how, phrase in PHRASES:
            sentence = phrase.format(id=spdx, name=name)
            if normalise(sentence) not in known:
                known.add(normalise(sentence))
                sentences.append((f"{spdx}:{how}", sentence))
                rules.append((spdx, (f"{spdx}:{how}",)))
    return sentences, rules


class Recognizer:
    """Known sentences by their first words, and the rules over their identifiers."""

    def __init__(self, sentences=None, rules=None, gap: int = 2):
        more_sentences, more_rules = named()
        self.rules = sorted(rules or RULES + more_rules, key=lambda r: (-len(r[1]), r[0], r[1]))
        self.gap = gap
        self.known = sorted(((normalise(s).split(), name) for name, s in sentences or SENTENCES + more_sentences), key=lambda x: (-len(x[0]), x[1]))
        self.width = min(3, *(len(words) for words, _ in self.known))
        self.by_first: dict[tuple[str, ...], list[tuple[list[str], str]]] = {}
        for words, name in self.known:
            self.by_first.setdefault(tuple(words[: self.width]), []).append((words, name))
        # a text without one of these words holds no known sentence
        self.cues = sorted({min(words, key=lambda w: (not w.startswith("licens"), -len(w), w))[:6] for words, _ in self.known})
        # rules by their first identifier, in order
        self.by_name: dict[str, list[int]] = {}
        for r, (_, want) in enumerate(self.rules):
            self.by_name.setdefault(want[0], []).append(r)

    def identifiers(self, text: str | None) -> list[str]:
        """Known sentences of the text in order."""
        low = text.lower() if text else ""
        held = low.replace("licence", "license")
        if not any(cue in held for cue in self.cues):
            return []
        low = _MARK.sub("", low)
        found = list(_WORD.finditer(low))
        words = [VARIANTS.get(w, w) for w in (m[0] for m in found)]
        out, i = [], 0
        for at, first in enumerate(zip(*(words[k:] for k in range(self.width)), strict=False)):
            if at < i or first not in self.by_first or at and words[at - 1] in NEGATIONS:
                continue
            for want, name in self.by_first[first]:
                end = at + len(want)
                if words[at:end] == want and not _GOES_ON.match(low, found[end - 1].end()) and not (end < len(words) and words[end] in NOT_BEFORE.get(name, ())):
                    out.append(name)
                    i = end
                    break
        return out

    def licences(self, ids: list[str]) -> list[str]:
        """Licences by position of their first sentence; each match uses up its sentences."""
        free, found = [True] * len(ids), []
        tried = sorted({r for name in set(ids) for r in self.by_name.get(name, ())})  # the others can't fit
        for licence, want in (self.rules[r] for r in tried):
            for start in range(len(ids)):
                at, spot = [], start
                for name in want:
                    stop = start + 1 if not at else min(len(ids), at[-1] + 2 + self.gap)
                    spot = next((j for j in range(spot, stop) if free[j] and ids[j] == name), None)
                    if spot is None:
                        break
                    at.append(spot)
                    spot += 1
                else:
                    for j in at:
                        free[j] = False
                    found.append((at[0], licence))
        return [x for _, x in sorted(found)]


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", recognizer: Recognizer | None = None) -> DataFrame:
    """(key, sentence_ids, licenses) of every row; both arrays in text order, licenses with repeats."""
    rec = recognizer or Recognizer()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [rec.identifiers(x.as_py()) for x in batch.column(1)]
            names = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, names), pa.array([rec.licences(x) for x in ids], names)], ["k", "sentence_ids", "licenses"])

    return docs.select(key, text).mapInArrow(run, f"k {kind}, sentence_ids array<string>, licenses array<string>").withColumnRenamed("k", key)

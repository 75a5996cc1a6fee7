"""Licence scans by sentence rules.

Normalised sentences are mapped to identifiers of known licence sentences; the sequence of identifiers
of a text is then matched against ordered rules, each a sequence of identifiers that names a licence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import map_batches, replace_columns, replaced_schema, slices

# Sentences of public licence texts and notices, by identifier.
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit-name": ("Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "MIT License", "The MIT License (MIT)", "The MIT License", "Licensed under the MIT License (see LICENSE)", "MIT licensed"),
    "mit-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    ),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "mit-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    ),
    "apache-name": ("Licensed under the Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License")', "Apache License, Version 2.0", "Released under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004"),
    "apache-terms": ("you may not use this file except in compliance with the License",),
    "apache-copy": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",),
    "gpl3-name": ("This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "GNU General Public License, version 3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "gpl-grant": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "gpl-hope": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",),
    "bsd-grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",),
    "bsd-endorse": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "cc-by-nc-4": ("Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-4": ("Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-sa-4": ("Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "mpl-name": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, Version 2.0"),
    "gpl2-name": ("This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2", "GNU General Public License, version 2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "gpl2-grant": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    ),
    "gpl2-only": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",),
    "lgpl21-name": ("Licensed under the GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    "lgpl21-grant": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",),
    "lgpl3-name": ("Licensed under the GNU Lesser General Public License, version 3", "GNU Lesser General Public License, version 3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "lgpl3-grant": tuple(f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version" for what in ("program", "library")),
    "agpl3-name": ("Licensed under the GNU Affero General Public License, version 3", "GNU Affero General Public License, version 3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    "agpl3-grant": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "isc-name": ("Released under the ISC License", "Licensed under the ISC License", "This project is licensed under the ISC License", "ISC License"),
    "isc-grant": tuple(f"Permission to use, copy, modify, and{do} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies" for do in ("", "/or")),
    "epl2-name": ("Licensed under the Eclipse Public License 2.0", "Eclipse Public License - v 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"),
    "epl1-name": ("Licensed under the Eclipse Public License 1.0", "Eclipse Public License - v 1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    "unlicense": ("This is free and unencumbered software released into the public domain", "Released under the Unlicense", "Licensed under the Unlicense"),
    "cc0": ("CC0 1.0 Universal", "Licensed under CC0 1.0", "This work is licensed under CC0 1.0", "This work is licensed under a Creative Commons CC0 1.0 Universal License", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    "zlib-grant": ("This software is provided 'as-is', without any express or implied warranty",),
    "boost-name": ("Distributed under the Boost Software License, Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    "reserved": ("All rights reserved",),
}

# Identifiers that a line `SPDX-License-Identifier: ...` may name.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0",
    "EPL-1.0", "EPL-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "Zlib",
)
SENTENCES |= {f"spdx-{i}": (f"SPDX-License-Identifier: {i}",) for i in SPDX}


@dataclass(frozen=True)
class Rule:
    licence: str
    sequence: tuple[str, ...]
    #: Other sentences allowed between two of the sequence.
    gap: int = 3


# Rules in order of precedence; a sentence serves the first rule that takes it.
RULES: tuple[Rule, ...] = (
    Rule("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    Rule("MIT", ("mit-grant", "mit-notice")),
    Rule("Apache-2.0", ("apache-name", "apache-terms", "apache-copy")),
    Rule("Apache-2.0", ("apache-name", "apache-terms")),
    Rule("GPL-3.0-or-later", ("gpl-grant", "gpl-hope")),
    Rule("GPL-3.0-or-later", ("gpl-grant",)),
    Rule("GPL-2.0-or-later", ("gpl2-grant", "gpl-hope")),
    Rule("GPL-2.0-or-later", ("gpl2-grant",)),
    Rule("GPL-2.0-only", ("gpl2-only",)),
    Rule("LGPL-2.1-or-later", ("lgpl21-grant",)),
    Rule("LGPL-3.0-or-later", ("lgpl3-grant",)),
    Rule("AGPL-3.0-or-later", ("agpl3-grant",)),
    Rule("ISC", ("isc-name", "isc-grant")),
    Rule("ISC", ("isc-grant",)),
    Rule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    Rule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    Rule("BSD-1-Clause", ("bsd-grant", "bsd-source")),
    Rule("MIT", ("mit-name",)),
    Rule("Apache-2.0", ("apache-name",)),
    Rule("GPL-3.0", ("gpl3-name",)),
    Rule("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    Rule("CC-BY-4.0", ("cc-by-4",)),
    Rule("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    Rule("MPL-2.0", ("mpl-name",)),
    Rule("GPL-2.0", ("gpl2-name",)),
    Rule("LGPL-2.1", ("lgpl21-name",)),
    Rule("LGPL-3.0", ("lgpl3-name",)),
    Rule("AGPL-3.0", ("agpl3-name",)),
    Rule("ISC", ("isc-name",)),
    Rule("EPL-2.0", ("epl2-name",)),
    Rule("EPL-1.0", ("epl1-name",)),
    Rule("Unlicense", ("unlicense",)),
    Rule("CC0-1.0", ("cc0",)),
    Rule("Zlib", ("zlib-grant",)),
    Rule("BSL-1.0", ("boost-name",)),
    *(Rule(i, (f"spdx-{i}",)) for i in SPDX),
    Rule("all-rights-reserved", ("reserved",)),
)

_TOKEN = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
#: Sentences end at closing punctuation before white space; lines may end one or wrap it.
_BREAK = re.compile(r"(?<=[.!?;:])\s+|\n+")


def normalise(sentence: str) -> tuple[str, ...]:
    return tuple(_TOKEN.findall(sentence.lower()))


class SentenceIndex:
    """Known sentences by their tokens, with all beginnings of them, and words one of which each sentence has."""

    def __init__(self, sentences: dict[str, tuple[str, ...]]):
        self.known = {normalise(s): i for i, found in sentences.items() for s in found}
        self.prefixes = {k[:n] for k in self.known for n in range(1, len(k))}
        left, self.anchors = set(self.known), []
        while left:  # greedy cover, long words first among equals
            words = {w for k in left for w in k}
            best = max(sorted(words), key=lambda w: (sum(w in k for k in left) * (len(w) > 5), len(w)))
            self.anchors.append(best)
            left = {k for k in left if best not in k}

    def recognise(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(identifier, first and end fragment, start and end offset) of known sentences, in order.

        A sentence may wrap over several fragments; the longest one wins.
        """
        lower = text.lower()
        if not any(a in lower for a in self.anchors):
            return []
        spans, at = [], 0
        for m in _BREAK.finditer(text):
            spans.append((at, m.start()))
            at = m.end()
        spans.append((at, len(text)))
        spans = [(a, b, t) for a, b in spans if (t := normalise(text[a:b]))]
        out, i = [], 0
        while i < len(spans):
            tokens, best, j = (), None, i
            while j < len(spans):
                tokens += spans[j][2]
                j += 1
                if tokens in self.known:
                    best = (self.known[tokens], j)
                if tokens not in self.prefixes:
                    break
            if best:
                out.append((best[0], i, best[1], spans[i][0], spans[best[1] - 1][1]))
                i = best[1]
            else:
                i += 1
        return out


def match_rules(found: list[tuple[str, int, int, int, int]], rules: tuple[Rule, ...]) -> list[tuple[str, int, int]]:
    """(licence, start, end) by order of start; rules are tried in order, each sentence is used once."""
    free, out = [True] * len(found), []
    for rule in rules:
        for first in range(len(found)):
            taken: list[int] = []
            for k in range(first, len(found)):
                if taken and found[k][1] - found[taken[-1]][2] > rule.gap:
                    break
                if free[k] and found[k][0] == rule.sequence[len(taken)]:
                    taken.append(k)
                    if len(taken) == len(rule.sequence):
                        break
                elif not taken:
                    break
            if len(taken) == len(rule.sequence):
                for k in taken:
                    free[k] = False
                out.append((rule.licence, found[taken[0]][3], found[taken[-1]][4]))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def scan(
    docs: DataFrame, text_col: str = "text", sentences: dict[str, tuple[str, ...]] | None = None, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Adds ``licences`` array<struct<licence string, start int, end int>> to each row.

    Offsets are in characters of the whole text, spans in order of their start. Null, empty and blank
    texts, and texts without a known sentence, get an empty array. An input column of that name is
    replaced. Repeated rows are scanned each by itself. There is no shuffle; the rules are a fixed table.
    """
    index = SentenceIndex(sentences or SENTENCES)
    span = T.StructType([T.StructField("licence", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    kind = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [match_rules(index.recognise(t or ""), rules) for t in part.column(text_col).to_pylist()]
            rows = [[{"licence": n, "start": a, "end": b} for n, a, b in f] for f in found]
            yield replace_columns(part, {"licences": pa.array(rows, kind)})

    return map_batches(docs, run, replaced_schema(docs, [T.StructField("licences", T.ArrayType(span))]))

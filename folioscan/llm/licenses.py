"""Licence recognition by known sentences and ordered rules.

A text is cut into pieces (at line ends and at a full stop, question or
exclamation mark before white space). A known licence sentence is found where one
piece, or several that follow one another, normalise to it: sentences may be wrapped,
stand behind comment marks, or hold a full stop. Found ones don't overlap, and of
those that begin at a piece the longest counts. The identifiers, in order, are matched
against an ordered list of licence rules, of which the first that fits names
the licence. Lookup and rules are literals in one projection: no shuffle, no join.

Most of the table is made by rule: names of licences (NAMES) in the shapes that notices have (SHAPES), SPDX lines
for every identifier, headings of licence files. The sentences of licence texts themselves stand in SENTENCES.

Null and empty texts have no sentences and no licence. Repeated sentences
count each time, repeated rows get repeated results, extra columns are ignored
and an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table, text_or_empty

#: Fixed values: (identifier, sentence as licences and notices publish it).
OWN_SENTENCES: list[tuple[str, str]] = [
    ("apache-notice", "Licensed under the Apache License, Version 2.0."),
    ("apache-notice", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("apache-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-use", "you may not use this file except in compliance with the License."),
    ("apache-copy", "You may obtain a copy of the License at"),
    ("apache-asis", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl3-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl3-notice", "Licensed under the GNU General Public License, version 3."),
    ("gpl2-notice", "Licensed under the GNU General Public License, version 2."),
    ("gpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl-received", "You should have received a copy of the GNU General Public License along with this program."),
    ("lgpl-notice", "Licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-notice", "Licensed under the GNU Affero General Public License, version 3."),
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "Licensed under the MIT License."),
    ("mit-notice", "MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit-include", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("asis-software", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-notice", "Licensed under the BSD 3-Clause License."),
    ("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "Released under CC0 1.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("reserved", "All rights reserved."),
    ("gpl2-free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl2-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("lgpl21-free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl3-free", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("epl1-terms", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("epl2-terms", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("epl2-terms", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("boost-grant", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
]

#: SPDX identifiers and the names by which notices call the licence.
NAMES: list[tuple[str, str]] = [
    ("MIT", "MIT License|Expat License"), ("Apache-2.0", "Apache License, Version 2.0|Apache License 2.0|Apache 2.0 License|Apache-2.0 License|Apache Software License 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License|2-Clause BSD License|Simplified BSD License|FreeBSD License|BSD 2-Clause \"Simplified\" License"),
    ("BSD-3-Clause", "BSD 3-Clause License|3-Clause BSD License|New BSD License|Modified BSD License|Revised BSD License|BSD 3-Clause \"New\" or \"Revised\" License"),
    ("0BSD", "0BSD License|BSD Zero Clause License|Zero-Clause BSD License"), ("ISC", "ISC License"), ("Zlib", "zlib License"), ("NCSA", "University of Illinois/NCSA Open Source License"),
    ("GPL-2.0", "GNU General Public License, version 2|GNU General Public License v2.0|GNU General Public License v2|GNU GPL version 2|GNU GPL v2|GPLv2 License"),
    ("GPL-3.0", "GNU General Public License, version 3|GNU General Public License v3.0|GNU General Public License v3|GNU GPL version 3|GNU GPL v3|GPLv3 License"),
    ("GPL-2.0-or-later", "GNU General Public License v2.0 or later|GNU General Public License, version 2 or later|GPLv2 or later"), ("GPL-3.0-or-later", "GNU General Public License v3.0 or later|GNU General Public License, version 3 or later|GPLv3 or later"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1|GNU Lesser General Public License v2.1|GNU LGPL version 2.1|GNU LGPL v2.1|LGPLv2.1 License"), ("LGPL-2.1-or-later", "GNU Lesser General Public License v2.1 or later"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3|GNU Lesser General Public License v3.0|GNU LGPL version 3|GNU LGPL v3|LGPLv3 License"), ("LGPL-3.0-or-later", "GNU Lesser General Public License v3.0 or later"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3|GNU Affero General Public License v3.0|GNU AGPL version 3|GNU AGPL v3|AGPLv3 License"), ("AGPL-3.0-or-later", "GNU Affero General Public License v3.0 or later"),
    ("MPL-1.1", "Mozilla Public License 1.1|Mozilla Public License Version 1.1"), ("MPL-2.0", "Mozilla Public License 2.0|Mozilla Public License, v. 2.0|Mozilla Public License Version 2.0|Mozilla Public License, version 2.0"),
    ("EPL-1.0", "Eclipse Public License 1.0|Eclipse Public License v1.0|Eclipse Public License - v 1.0|Eclipse Public License, Version 1.0"), ("EPL-2.0", "Eclipse Public License 2.0|Eclipse Public License v2.0|Eclipse Public License - v 2.0|Eclipse Public License, Version 2.0"),
    ("BSL-1.0", "Boost Software License|Boost Software License 1.0|Boost Software License, Version 1.0|Boost Software License - Version 1.0"), ("CDDL-1.0", "Common Development and Distribution License 1.0|Common Development and Distribution License, Version 1.0"),
    ("EUPL-1.2", "European Union Public License 1.2|EUPL, Version 1.2"), ("PostgreSQL", "PostgreSQL License"), ("Artistic-2.0", "Artistic License 2.0"), ("OFL-1.1", "SIL Open Font License 1.1|SIL Open Font License, Version 1.1"), ("MS-PL", "Microsoft Public License"),
    ("Unlicense", "Unlicense License|The Unlicense"), ("CC0-1.0", "CC0 1.0|CC0 1.0 Universal|Creative Commons Zero v1.0 Universal"),
    ("CC-BY-4.0", "CC BY 4.0|Creative Commons Attribution 4.0 International License"), ("CC-BY-SA-4.0", "CC BY-SA 4.0|Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0|Creative Commons Attribution-NonCommercial 4.0 International License"), ("CC-BY-ND-4.0", "CC BY-ND 4.0|Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0|Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"), ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0|Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
]
#: What stands around a name in a notice.
SHAPES = [
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Distributed under the {}.", "Available under the {}.", "Published under the {}.", "License: {}",
    "This project is licensed under the {}.", "This project is licensed under the terms of the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "This software is licensed under the {}.",
    "This software is released under the {}.", "This program is licensed under the {}.", "This library is licensed under the {}.", "This code is licensed under the {}.", "This file is licensed under the {}.", "The code is released under the {}.",
]
#: Headings of licence files.
HEADINGS = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004"), ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3"), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3"), ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1"), ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3"), ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("OFL-1.1", "SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007"), ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
]
_NOTICE = {
    "MIT": "mit-notice", "Apache-2.0": "apache-notice", "BSD-3-Clause": "bsd-notice", "GPL-2.0": "gpl2-notice", "GPL-3.0": "gpl3-notice", "LGPL-3.0": "lgpl-notice", "AGPL-3.0": "agpl-notice", "MPL-2.0": "mpl-notice",
    "CC-BY-4.0": "cc-by", "CC-BY-SA-4.0": "cc-by-sa", "CC-BY-NC-4.0": "cc-by-nc", "CC0-1.0": "cc0", "Unlicense": "unlicense",
}


def notice_of(spdx: str) -> str:
    """The identifier of sentences that name a licence."""
    return _NOTICE.get(spdx, f"{spdx.lower()}-notice")


def sentences() -> list[tuple[str, str]]:
    """(identifier, sentence): those of licence texts, then each name in each shape, SPDX lines and headings; the first of equal ones holds."""
    rows = list(OWN_SENTENCES)
    for spdx, names in NAMES:
        for name in names.split("|"):
            rows += [(notice_of(spdx), shape.format(name)) for shape in SHAPES]
            if "License" in name:
                rows += [(notice_of(spdx), name), (notice_of(spdx), f"The {name}")]
        same = [spdx, f"{spdx}-only"] if spdx.startswith(("GPL", "LGPL", "AGPL")) and "later" not in spdx else [spdx]
        rows += [(notice_of(spdx), shape.format(x)) for x in same for shape in ("SPDX-License-Identifier: {}", "License: {}", "Licensed under {}.")]
    rows += [(notice_of(spdx), heading) for spdx, heading in HEADINGS]
    first: dict[str, tuple[str, str]] = {}
    for i, s in rows:
        first.setdefault(normalised(s), (i, s))
    return list(first.values())


#: (licence, identifiers that must follow one another, others between them allowed); tried in this order.
TEXT_RULES: list[tuple[str, tuple[str, ...]]] = [
    ("AGPL-3.0-or-later", ("agpl-free",)), ("AGPL-3.0", ("agpl-notice",)), ("LGPL-3.0-or-later", ("lgpl3-free",)), ("LGPL-3.0", ("lgpl-notice",)), ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-received")), ("GPL-3.0-or-later", ("gpl-free",)), ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-2.0-or-later", ("gpl2-free",)), ("GPL-2.0", ("gpl2-only",)), ("GPL-2.0", ("gpl2-notice",)),
    ("Apache-2.0", ("apache-notice", "apache-copy", "apache-asis")), ("Apache-2.0", ("apache-notice",)), ("MPL-2.0", ("mpl-notice",)),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")), ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")), ("BSD-3-Clause", ("bsd-notice",)),
    ("MIT", ("mit-grant", "mit-include")), ("MIT", ("mit-notice",)), ("ISC", ("isc-grant",)), ("0BSD", ("0bsd-grant",)), ("Zlib", ("zlib-grant",)), ("BSL-1.0", ("boost-grant",)), ("EPL-2.0", ("epl2-terms",)), ("EPL-1.0", ("epl1-terms",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)), ("CC-BY-SA-4.0", ("cc-by-sa",)), ("CC-BY-4.0", ("cc-by",)), ("CC0-1.0", ("cc0",)), ("Unlicense", ("unlicense",)),
]
#: Those above, then each licence by the sentences that name it, in the order of NAMES.
RULES = TEXT_RULES + [(spdx, (notice_of(spdx),)) for spdx, _ in NAMES if spdx not in _NOTICE]


def normalised(sentence: str) -> str:
    """What normalise() makes of a sentence, for the table."""
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), sentence)).strip(" ")


SENTENCES = sentences()


def pieces(text: Column) -> Column:
    """The normalised pieces of a text, a line end before and after each; none is empty."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = F.regexp_replace(lower, r"\n+|(?<=[.?!])[\x20\t\r]+", "\n")
    return F.regexp_replace(F.concat(F.lit("\n"), F.regexp_replace(cut, r"[^a-z0-9\n]+", " "), F.lit("\n")), r"\x20?\n[\x20\n]*", "\n")


def anchors() -> list[str]:
    """Few words of which each known sentence has one: a text without any of them has no such sentence."""
    every = [normalised(s).split() for _, s in SENTENCES]
    left = [{w for w in words if len(w) > 5} or set(words) for words in every]  # short words are too frequent
    chosen = []
    while left:
        best = max(sorted({w for words in left for w in words}), key=lambda w: (sum(w in words for words in left), len(w)))
        chosen.append(best)
        left = [words for words in left if best not in words]
    return chosen


def sentence_pattern() -> str:
    """Matches any known sentence, the longest where one begins another; words that several share are tried once."""
    tree: dict = {}
    for _, s in SENTENCES:
        at = tree
        for w in normalised(s).split():
            at = at.setdefault(w, {})
        at[""] = {}

    def after(node: dict) -> str:
        """What may follow a word: the end of a piece, if a sentence ends here, or one of the next words."""
        ways = [r"[\x20\n]" + w + after(node[w]) for w in sorted(node) if w] + [r"(?=\n)"] * ("" in node)
        return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"

    return r"(?<=\n)(?:" + "|".join(w + after(tree[w]) for w in sorted(tree)) + ")"


def identify(text: Column) -> Column:
    """Identifiers of the licence sentences of a text, in order, repeats included."""
    known = F.create_map(*[F.lit(x) for s, i in sorted({normalised(s): i for i, s in SENTENCES}.items()) for x in (s, i)])
    found = F.transform(F.regexp_extract_all(pieces(text), F.lit(sentence_pattern()), F.lit(0)), lambda s: F.try_element_at(known, F.translate(s, "\n", " ")))
    return F.when(text.rlike("(?i)" + "|".join(anchors())), found).otherwise(F.array().cast("array<string>"))


def rule_pattern(identifiers: tuple[str, ...]) -> str:
    """Matches ' a b c ' where the identifiers stand in this order."""
    return ".*".join(f" {re.escape(i)} " for i in identifiers).replace(" .* ", " (.* )?")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_licence_sentences, sentence_ids (joined by spaces), licence (null: none), licences (all that fit)."""
    found = docs.select(F.col(id_col).alias("doc_id"), let(identify(text_or_empty(text_col)), lambda x: x).alias("ids"))
    line = F.concat(F.lit(" "), F.array_join("ids", " "), F.lit(" "))
    fits = [F.when(line.rlike(rule_pattern(ids)), F.lit(name)) for name, ids in RULES]
    some = F.size("ids") > 0
    licences = F.when(some, F.array_join(F.array_distinct(F.array_compact(F.array(*fits))), ",")).otherwise(F.lit(""))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_licence_sentences"), F.array_join("ids", " ").alias("sentence_ids"), F.when(some, F.coalesce(*fits)).alias("licence"), licences.alias("licences"))


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same for DuckDB, without a pattern of all sentences: each piece that a sentence may begin at is compared.

    P holds a text's pieces with a line end before and after each, W the same with spaces. Found
    sentences are then taken from left to right by a recursive query.
    """
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in sorted({normalised(s): i for i, s in SENTENCES}.items()))
    cases = [f"CASE WHEN regexp_matches(line, {quote(rule_pattern(ids))}) THEN {quote(name)} END" for name, ids in RULES]
    firsts = ", ".join(cases)
    return rf"""
WITH RECURSIVE known(sentence, id) AS (VALUES {known}),
d AS (SELECT doc_id, row_number() OVER () AS n, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
cut AS (SELECT n, regexp_replace(regexp_replace(t, '\n+', chr(10), 'g'), '([.?!])[ \t\r]+', '\1' || chr(10), 'g') AS t FROM d),
p AS (SELECT n, regexp_replace(chr(10) || regexp_replace(t, '[^a-z0-9\n]+', ' ', 'g') || chr(10), ' ?\n[ \n]*', chr(10), 'g') AS p FROM cut),
w AS (SELECT n, p, replace(p, chr(10), ' ') AS w FROM p),
near AS (SELECT n, p, w, sentence, id FROM (SELECT * FROM w WHERE regexp_matches(w, '{"|".join(anchors())}')) w JOIN known ON contains(w, ' ' || sentence || ' ')),
begins AS (SELECT n, p, w, unnest(list_filter(range(1, length(p) + 1), lambda k: p[k] = chr(10))) AS pos FROM (SELECT DISTINCT n, p, w FROM near)),
hits AS (SELECT b.n, b.pos, max(b.pos + length(k.sentence) + 1) AS upto, arg_max(k.id, length(k.sentence)) AS id FROM begins b JOIN known k
  ON substr(b.w, b.pos + 1, length(k.sentence)) = k.sentence AND substr(b.p, b.pos + length(k.sentence) + 1, 1) = chr(10) GROUP BY 1, 2),
taken AS (
  SELECT n, pos, upto, id FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY pos) AS r FROM hits) WHERE r = 1
  UNION ALL SELECT n, pos, upto, id FROM (SELECT h.*, row_number() OVER (PARTITION BY h.n ORDER BY h.pos) AS r FROM taken t JOIN hits h ON h.n = t.n AND h.pos >= t.upto) WHERE r = 1),
found AS (SELECT n, count(*) AS c, string_agg(id, ' ' ORDER BY pos) AS ids FROM taken GROUP BY n),
every AS (SELECT doc_id, coalesce(c, 0) AS n_licence_sentences, coalesce(ids, '') AS sentence_ids, ' ' || coalesce(ids, '') || ' ' AS line FROM d LEFT JOIN found USING (n))
SELECT doc_id, n_licence_sentences, sentence_ids, coalesce({firsts}) AS licence,
  array_to_string([x FOR x, i IN list_filter([{firsts}], lambda v: v IS NOT NULL) IF i = list_position(list_filter([{firsts}], lambda v: v IS NOT NULL), x)], ',') AS licences
FROM every
"""


OP2_SQL = _sql()

from __future__ import annotations

from folioscan.llm import licenses as lc


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.licence, r.sentence_ids) for r in lc.scan(docs).collect()}


def test_sentences_and_rules(spark):
    by_id: dict[str, str] = {}
    for i, s in lc.SENTENCES:
        by_id.setdefault(i, s)
    bsd = "\n".join(by_id[i] for i in ("bsd-redistribution", "bsd-source", "bsd-binary"))
    found = scan(spark, [
        "Prose.\nLicensed under the Apache License, Version 2.0.", "released  under the MIT LICENSE", f"{bsd}\n{by_id['bsd-endorse']}", bsd,
        "I like the MIT License. It is short.", f"{by_id['bsd-source']} {by_id['bsd-redistribution']}", "All rights reserved.", None, "",
    ])
    assert [found[k][0] for k in range(9)] == ["Apache-2.0", "MIT", "BSD-3-Clause", "BSD-2-Clause", None, None, None, None, None]
    assert found[2][1] == "bsd-redistribution bsd-source bsd-binary bsd-endorse"
    assert found[5][1] == "bsd-source bsd-redistribution"  # the order counts


def test_every_known_sentence_is_found(spark):
    found = scan(spark, [f"Some text here.\n{s}\nMore." for _, s in lc.SENTENCES])
    assert all(i in found[k][1].split() for k, (i, s) in enumerate(lc.SENTENCES))


def test_common_ways_of_naming_a_licence(spark):
    lgpl = "This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version."
    gpl2 = "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version."
    cases = [
        ("This project is licensed under the MIT License.", "MIT"), ("// SPDX-License-Identifier: Apache-2.0\ncode", "Apache-2.0"), ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"), (gpl2, "GPL-2.0-or-later"), (lgpl, "LGPL-2.1-or-later"),
        ("Boost Software License - Version 1.0 - August 17th, 2003\n", "BSL-1.0"), ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"), ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/", "EPL-2.0"),
        ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n", "Apache-2.0"), ("GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007", "GPL-3.0"),
        ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.", "0BSD"), ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0-or-later"), ("SPDX-License-Identifier: CC-BY-NC-SA-4.0", "CC-BY-NC-SA-4.0"),
        ("We talked about the MIT License and went home.", None), ("The license plate was available.", None), ("Licensed under nothing.", None),
    ]
    found = scan(spark, [text for text, _ in cases])
    assert [found[k][0] for k in range(len(cases))] == [want for _, want in cases]
    assert len(lc.SENTENCES) > 500 and len({lc.normalised(s) for _, s in lc.SENTENCES}) == len(lc.SENTENCES)


def test_every_rule_can_be_met(spark):
    """A text of a rule's sentences names its licence, or one whose rule comes earlier and fits as well."""
    by_id = {i: s for i, s in reversed(lc.SENTENCES)}
    docs = spark.createDataFrame([(k, "\n".join(by_id[i] for i in ids)) for k, (_, ids) in enumerate(lc.RULES)], "doc_id long, text string")
    for r in lc.scan(docs).collect():
        assert lc.RULES[r.doc_id][0] in r.licences.split(","), lc.RULES[r.doc_id]


def test_edges(odd, empty):
    assert lc.scan(odd).count() == odd.count() and lc.scan(empty).count() == 0


def test_sentences_with_full_stops_wrapped_and_behind_comment_marks(spark):
    import textwrap

    shapes = [(width, mark) for width in (400, 72, 30) for mark in ("", " * ", "# ", "// ")]
    cases = [(i, "Some text here.\n" + textwrap.indent(textwrap.fill(s, width, break_long_words=False), mark, lambda _: True) + "\nMore.") for i, s in lc.SENTENCES[:60] + lc.SENTENCES[60::9] for width, mark in shapes]
    found = scan(spark, [text for _, text in cases])
    for k, (i, text) in enumerate(cases):
        assert found[k][1].split()[0] == i, text
    mpl = next(s for i, s in lc.SENTENCES if i == "mpl-notice")
    bsd = [next(s for i, s in lc.SENTENCES if i == b) for b in ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")]
    found = scan(spark, [f"{mpl} It is.", "\n".join(textwrap.fill(s, 60) for s in bsd), "Licensed" + " -" * 600 + " under the MIT License."])
    assert [found[k][0] for k in range(3)] == ["MPL-2.0", "BSD-3-Clause", "MIT"]


def test_equal_to_its_sql_on_the_given_tables(spark):
    path = "/root/testdata/sf0.01"
    assert by_sql(f"SELECT * FROM '{path}/documents.parquet'") == sorted(str(tuple(r)) for r in lc.op2_license_scan(spark, path).collect())


def by_sql(documents: str) -> list[str]:
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS {documents}")
    return sorted(map(str, con.execute(f"SELECT doc_id, n_licence_sentences, sentence_ids, licence, licences FROM ({lc.OP2_SQL})").fetchall()))


def test_equal_to_its_sql_on_wrapped_and_repeated_sentences(spark, tmp_path):
    """Wrapped, behind comment marks, overlapping, one within another, at both ends, and without white space between."""
    import textwrap

    every = [s for _, s in lc.SENTENCES[:60] + lc.SENTENCES[60::40]]
    texts = [textwrap.indent(textwrap.fill(s, width), mark, lambda _: True) for s in every for width, mark in ((60, ""), (80, " * "), (25, "# "))]
    texts += [" ".join(every), "\n".join(every), "\n\n".join(every[::-1]), "MIT License\nMIT License MIT License.MIT License. \tMIT License", "MIT\nLicense\n", "\nLicensed under the\nMIT License.", None, "", "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.", "x" * 5000 + ". MIT License"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/d")
    assert by_sql(f"SELECT * FROM '{tmp_path}/d/*.parquet'") == sorted(str(tuple(r)) for r in lc.scan(docs).collect())

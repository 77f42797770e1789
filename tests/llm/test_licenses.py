from quillgraph.llm import licenses as li

MIT = " ".join(li._NOTICES[k] for k in ("mit_grant", "mit_notice", "as_is"))
CASES = {
    1: ("x\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    2: ("Some words.  Released under the MIT License.\nThis work is licensed under the GNU General Public License, version 3.", "GPL-3.0,MIT"),
    3: (MIT, "MIT"),
    4: (MIT.upper() + "\n" + MIT, "MIT"),
    5: (li._NOTICES["mit_notice"] + " " + li._NOTICES["mit_grant"], ""),
    6: ("Licensed under the Apache License, Version 2.0;\n" + li._NOTICES["apache_comply"] + "\nother line\n" + li._NOTICES["apache_copy"], "APACHE-2.0"),
    7: ("\n".join(li._NOTICES[k] for k in ("bsd_terms", "bsd_source", "bsd_binary", "bsd_names")), "BSD-3-CLAUSE"),
    8: ("\n".join(li._NOTICES[k] for k in ("bsd_terms", "bsd_source", "bsd_binary")), "BSD-2-CLAUSE"),
    9: ("We talk about the MIT License here.", ""),
    10: (None, ""),
    11: ("", ""),
    12: ("word " * 30000 + "\nSPDX-License-Identifier: MIT", "MIT"),
    13: ("Licensed under CC BY-NC 4.0 or later.", ""),
}


def test_rules(spark):
    frame = spark.createDataFrame([(i, t, "s") for i, (t, _) in CASES.items()] + [(1, CASES[1][0], "s"), (None, None, "s")], "doc_id long, text string, ids string")
    got = li.scan(frame).collect()
    assert len(got) == len(CASES) + 2
    for r in got:
        want = CASES[r.doc_id][1] if r.doc_id else ""
        assert r.licenses == want and r.n_licenses == len([x for x in want.split(",") if x]), r
    assert li.scan(frame.limit(0)).count() == 0


def test_every_known_sentence_has_a_marker():
    import re

    assert all(re.search(li.MARKERS, s) for s in li.SENTENCES)


APACHE = """# Copyright 2020 The Authors
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""
GPL2 = """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
"""


def test_wrapped_notices_and_spdx_expressions(spark):
    import textwrap

    def wrapped(*ids, width=72, mark=""):
        return "Title\n" + "\n\n".join(textwrap.fill(li._NOTICES[k], width, initial_indent=mark, subsequent_indent=mark) for k in ids)

    mit, bsd = ("mit_grant", "mit_notice", "as_is"), ("bsd_terms", "bsd_source", "bsd_binary", "bsd_names")
    cases = [
        (wrapped(*mit), "MIT"), (wrapped(*mit, width=30, mark=" * ").replace("\n", "\r\n"), "MIT"), (wrapped("isc_grant"), "ISC"), (wrapped(*bsd, mark="# "), "BSD-3-CLAUSE"),
        (wrapped("gpl_free", mark="-- "), "GPL-3.0"), (GPL2, "GPL-2.0"), (APACHE, "APACHE-2.0"),
        ("// SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("SPDX-License-Identifier: MIT OR Apache-2.0\ncode", "APACHE-2.0,MIT"), ("# SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR ISC", "GPL-2.0,ISC"),
        ("Copyright Me\nLicensed under\nthe MIT License\nmore", "MIT"), ("Licensed under\n\nthe MIT License", ""),
    ]
    frame = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert {r.doc_id: r.licenses for r in li.scan(frame).collect()} == {k: want for k, (_, want) in enumerate(cases)}

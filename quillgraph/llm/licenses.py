"""Licence scans by sentence rules.

A text is cut at lines without words and after . ! ? ; : before white space. In between, the longest run of whole
lines that makes a known licence sentence gives its identifier, so sentences may be wrapped and may follow other
lines. They are compared as lower-case ASCII words with single spaces. An SPDX line gives the identifier of each
licence in its expression, -only, -or-later and + left out. A text's identifiers in order are then matched against ordered rules: a rule fits if its identifiers
occur in its order, others in between; what a rule has used is gone for the rules after it, so that a full notice
is not also taken for its parts.

Every known sentence holds one of MARKERS, so texts without any are passed over. The rules and sentences are in
the expressions themselves; nothing is shuffled.

Defined cases: null, empty and other texts without known sentences have no licences; a licence that occurs twice
is named once; repeated rows are scanned each; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKERS = "licen[cs]e|copyright|permission|warrant|redistribut|spdx|public domain|as is|liable|gpl|copy of|(?:released|distributed|available) under|free software"

_CC = {"": "Attribution", "-sa": "Attribution-ShareAlike", "-nc": "Attribution-NonCommercial", "-nd": "Attribution-NoDerivatives", "-nc-sa": "Attribution-NonCommercial-ShareAlike", "-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
_OPENINGS = ("Licensed under {}", "Released under {}", "This work is licensed under {}", "This project is licensed under {}", "This software is licensed under {}", "Distributed under {}", "Available under {}", "This file is licensed under {}")
_NAMES = {
    "mit": ("the MIT License", "the MIT licence", "MIT"),
    "apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0", 'the Apache License, Version 2.0 (the "License")'),
    "isc": ("the ISC License",),
    "mpl-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"),
    "bsd-2-clause": ("the BSD 2-Clause License", "the Simplified BSD License"),
    "bsd-3-clause": ("the BSD 3-Clause License", "the New BSD License"),
    "cc0-1.0": ("CC0 1.0", "the Creative Commons CC0 1.0 Universal License"),
    **{f"{k}-{v}.0": (f"the GNU {name} Public License, version {v}", f"the GNU {name} Public License v{v}", f"the GNU {name} Public License version {v}", f"{k.upper()}v{v}") for k, name, vs in (("gpl", "General", (2, 3)), ("lgpl", "Lesser General", (3,)), ("agpl", "Affero General", (3,))) for v in vs},
    **{f"cc-by{part}-{v}": (f"CC BY{part.upper()} {v}", f"a Creative Commons {name} {v} International License", f"the Creative Commons {name} {v} International License") for part, name in _CC.items() for v in ("3.0", "4.0")},
}
# fixed values: sentences of full licence notices
_NOTICES = {
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as_is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd_terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd_names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache_comply": "you may not use this file except in compliance with the License.",
    "apache_copy": "You may obtain a copy of the License at",
    "gpl_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2_free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def normal_sentence(text: str) -> str:
    return re.sub(r"[ .]+$", "", re.sub(r"[^A-Za-z0-9.+-]+", " ", text).strip().lower())


#: Known sentence to identifier.
SENTENCES = {normal_sentence(opening.format(name)): f"is_{licence}" for licence, names in _NAMES.items() for name in names for opening in _OPENINGS}
SENTENCES |= {normal_sentence(f"SPDX-License-Identifier {licence}"): f"is_{licence}" for licence in _NAMES}
for _id, _notice in _NOTICES.items():
    # a notice is cut as texts are
    for _part in re.split(r"(?<=[.!?;:])[ \t-\r]+", _notice):
        SENTENCES[normal_sentence(_part)] = _id
# what notices of several versions share tells none of them
SENTENCES |= {"this program is free software": "gpl_opening", normal_sentence(_NOTICES["gpl2_free"].split("; ")[1]): "gpl_terms"}
_SPDX = "spdx-license-identifier "
_LINES = max(s.count(" ") + 1 for s in SENTENCES)

#: (licence, identifiers in order), the fuller notices first.
RULES = [
    ("MIT", ("mit_grant", "mit_notice", "as_is")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("ISC", ("isc_grant", "as_is")),
    ("ISC", ("isc_grant",)),
    ("BSD-3-CLAUSE", ("bsd_terms", "bsd_source", "bsd_binary", "bsd_names")),
    ("BSD-2-CLAUSE", ("bsd_terms", "bsd_source", "bsd_binary")),
    ("APACHE-2.0", ("is_apache-2.0", "apache_comply", "apache_copy")),
    ("GPL-3.0", ("gpl_free",)),
    ("GPL-2.0", ("gpl2_free",)),
    ("UNLICENSE", ("unlicense",)),
    *((licence.upper(), (f"is_{licence}",)) for licence in _NAMES),
]


def rule_pattern(ids: tuple[str, ...]) -> tuple[str, str]:
    """(regular expression over ``,id,id,``, replacement that keeps what stood between)."""
    parts = [re.escape(x) + "," for x in ids]
    gaps = len(ids) - 1
    return "(^|,)" + "((?:[^,]+,)*?)".join(parts), "".join(f"${k}" for k in range(1, gaps + 2))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    tagged = F.regexp_replace(text, "(?i)(SPDX-License-Identifier):", "$1")
    parts = F.split(tagged, r"(?<=[.!?;:])[ \t-\r]+|(?:\r\n|\n|\r(?!\n))[^A-Za-z0-9\n\r]*[\n\r]+")
    known = ", ".join(f"'{s}'" for s in SENTENCES)  # letters, digits, blanks, dots, pluses and hyphens only
    table = F.expr(f"map_from_arrays(array({known}), array({', '.join(repr(v) for v in SENTENCES.values())}))")
    openings = {s.split(" ")[0] for s in SENTENCES}

    def end(joined: Column) -> Column:
        return F.regexp_replace(joined, r"[ .]+$", "")

    def known_in(part: Column) -> Column:
        normal = F.transform(F.split(part, r"[\n\r]+"), lambda s: F.regexp_replace(F.lower(F.trim(F.regexp_replace(s, r"[^A-Za-z0-9.+-]+", " "))), r"^[-+. ]+", ""))
        lines = F.filter(normal, lambda s: s != "")

        def run_from(held: Column, i: Column) -> Column:
            """(identifiers of the run that starts at line i, its number of lines)."""
            line = F.element_at(held, i)
            none = F.struct(F.array().cast("array<string>").alias("ids"), F.lit(1).alias("n"))
            names = F.transform(F.split(F.substring(line, len(_SPDX) + 1, 1 << 30), " +"), lambda x: F.element_at(table, F.concat(F.lit(_SPDX), F.regexp_replace(F.regexp_replace(x, r"[.]+$", ""), r"(?:-only|-or-later|\+)$", ""))))
            sizes = F.sequence(F.least(F.lit(_LINES), F.size(held) - i + 1), F.lit(1), F.lit(-1))
            fits = F.filter(sizes, lambda n: end(F.array_join(F.slice(held, i, n), " ")).isin(*SENTENCES))
            run = F.transform(F.slice(fits, 1, 1), lambda n: F.struct(F.array(F.element_at(table, end(F.array_join(F.slice(held, i, n), " ")))).alias("ids"), n.alias("n")))
            spdx = F.struct(F.array_compact(names).alias("ids"), F.lit(1).alias("n"))
            first = F.regexp_replace(F.substring_index(line, " ", 1), r"[.]+$", "")
            return F.when(line.startswith(_SPDX), spdx).when(first.isin(*openings), F.coalesce(F.get(run, F.lit(0)), none)).otherwise(none)

        def step(acc: Column, i: Column, held: Column) -> Column:
            found = F.transform(F.array(run_from(held, i)), lambda x: F.struct(F.concat(acc["ids"], x["ids"]).alias("ids"), (i + x["n"]).cast("int").alias("next")))
            return F.when(i < acc["next"], acc).otherwise(F.element_at(found, 1))

        start = F.struct(F.array().cast("array<string>").alias("ids"), F.lit(1).alias("next"))
        ids = F.transform(F.array(lines), lambda held: F.when(F.size(held) > 0, F.aggregate(F.sequence(F.lit(1), F.size(held)), start, lambda acc, i: step(acc, i, held))["ids"]))
        return F.coalesce(F.element_at(ids, 1), F.array().cast("array<string>"))

    return F.flatten(F.transform(parts, known_in))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, licenses, n_licenses for every row of ``docs`` (doc_id, text)."""
    text = F.col("text").cast("string")
    ids = F.when(text.rlike(f"(?i){MARKERS}"), sentence_ids(text)).otherwise(F.array().cast("array<string>"))
    read = docs.select("doc_id", F.coalesce(ids, F.array().cast("array<string>")).alias("ids"))
    rules = ", ".join(f"named_struct('n', '{name}', 'p', '{p.replace(chr(92), chr(92) * 2)}', 'k', '{k}')" for name, ids_ in RULES for p, k in [rule_pattern(ids_)])
    start = "named_struct('s', concat(array_join(ids, ','), ','), 'f', CAST(array() AS array<string>))"
    step = "IF(regexp_like(acc.s, r.p), named_struct('s', regexp_replace(acc.s, r.p, r.k), 'f', array_union(acc.f, array(r.n))), acc)"
    found = F.expr(f"IF(size(ids) = 0, CAST(array() AS array<string>), aggregate(array({rules}), {start}, (acc, r) -> {step}).f)")
    named = read.withColumn("found", F.array_sort(found))
    return named.select("doc_id", F.array_join("ids", ",").alias("sentence_ids"), F.array_join("found", ",").alias("licenses"), F.size("found").cast("long").alias("n_licenses"))

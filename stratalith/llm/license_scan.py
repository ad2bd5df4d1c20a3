"""Licence scans by sentence rules.

A text's sentences are normalised (letters and digits in lower case, single spaces)
and looked up in a dictionary of known licence sentences; what remains of a text is
a sequence of sentence identifiers. Licence rules are ordered sequences of them: a
rule holds where its sentences occur in its order, with other known sentences in
between or not. Rules of a licence run from its full text down to a mention, and the
first that holds gives the form in which the licence was found.

Texts are cut into sentences twice, at line ends and across them, because a licence's
lines may be wrapped or stand alone; each cut gives a sequence of its own. A sentence that
isn't known as a whole is looked up by its ends, too: what stands behind a line end or a
colon in it ("Notice: ...", or a line without an end before a notice that is wrapped), and
what it says from "licensed under", "released under" and the like on, unless it denies
that. The longest known end counts. Only texts with one of the ``HINTS`` are cut at all:
every known sentence has a hint in it, so nothing is lost.

Besides the sentences that are written out below, the dictionary holds those that every
licence has by rule: its SPDX line and the sentences that mention it under its names. It is
a literal, dealt into buckets by hash, so that a sentence is looked up in one of them.

Everything is a projection of row values by built-in functions: no exchange, and
nothing depends on how often a line occurs. A null text counts as empty. Texts of any
length are read whole; of several forms of one licence the first in the rules' order counts,
whichever comes first in the text. Repeated rows get repeated results, an empty table an
empty one; columns besides doc_id and text aren't read, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known sentences of public licences, by identifier.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-mention": "Released under the MIT License.",
    "mit-mention-2": "Licensed under the MIT License.",
    "mit-mention-3": "This project is licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-title-2": "MIT License",
    "apache-mention": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-mention": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "lgpl-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ccby-mention": "Licensed under CC BY 4.0.",
    "ccbysa-mention": "Licensed under CC BY-SA 4.0.",
    "ccbync-mention": "Licensed under CC BY-NC 4.0.",
    "ccby-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbysa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ccbync-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "rights": "All rights reserved.",
}
#: By SPDX identifier, the names under which a licence is mentioned.
NAMES = {
    "MIT": ["the MIT License", "the MIT Licence", "MIT License", "MIT", "the terms of the MIT License"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache License 2.0", "Apache 2.0", "the Apache 2.0 License", "the terms of the Apache License, Version 2.0"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU General Public License v2.0", "GNU GPL v2", "GPLv2", "the GPLv2", "the GPL v2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3.0", "GNU GPL v3", "GPLv3", "the GPLv3", "the GPL v3", "the terms of the GNU General Public License, version 3"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1", "LGPL v2.1", "LGPLv2.1", "the LGPL v2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "LGPL v3", "LGPLv3", "the LGPL v3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3.0", "AGPL v3", "AGPLv3", "the AGPLv3"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License", "the Modified BSD License", "the BSD License", "BSD-3-Clause"],
    "ISC": ["the ISC License", "ISC License", "ISC"],
    "MPL-2.0": ["the Mozilla Public License, v. 2.0", "the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0", "MPL 2.0", "the MPL 2.0"],
    "EPL-2.0": ["the Eclipse Public License, Version 2.0", "the Eclipse Public License 2.0", "the Eclipse Public License v. 2.0", "EPL 2.0"],
    "BSL-1.0": ["the Boost Software License, Version 1.0", "the Boost Software License 1.0", "the Boost Software License"],
    "Zlib": ["the zlib License", "the zlib/libpng License", "zlib License"],
    "CC0-1.0": ["CC0 1.0", "CC0", "the CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero"],
    "CC-BY-4.0": ["CC BY 4.0", "CC-BY-4.0", "a Creative Commons Attribution 4.0 International License", "the Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "Unlicense": ["the Unlicense"],
    "WTFPL": ["the WTFPL", "WTFPL"],
}
#: What a mention says before a licence's name; other beginnings are cut off.
SAID = ("licensed", "licenced", "released", "distributed", "available", "published", "provided")
#: SPDX lines name some licences in further ways.
SPDX_MORE = ("-only", "-or-later")
#: (licence, form, sentences in order; a set in place of a sentence: any of them), first match of a licence counts.
RULES = [
    ("MIT", "text", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", "text", ["mit-grant", "mit-notice"]),
    ("MIT", "notice", ["mit-grant"]),
    ("MIT", "mention", [{"mit-mention", "mit-mention-2", "mit-mention-3", "mit-title", "mit-title-2"}]),
    ("Apache-2.0", "notice", ["apache-header", "apache-copy", "apache-basis", "apache-see"]),
    ("Apache-2.0", "notice", ["apache-header"]),
    ("Apache-2.0", "mention", ["apache-mention"]),
    ("GPL-3.0", "notice", ["gpl3-free", "gpl-hope", "gpl-see"]),
    ("GPL-3.0", "notice", ["gpl3-free"]),
    ("GPL-3.0", "mention", ["gpl3-mention"]),
    ("GPL-2.0", "notice", ["gpl2-free"]),
    ("LGPL-2.1", "notice", ["lgpl-free"]),
    ("AGPL-3.0", "notice", ["agpl-free"]),
    ("BSD-3-Clause", "text", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", "text", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("ISC", "text", ["isc-grant"]),
    ("MPL-2.0", "notice", ["mpl-header", "mpl-copy"]),
    ("MPL-2.0", "notice", ["mpl-header"]),
    ("CC-BY-4.0", "mention", [{"ccby-mention", "ccby-work"}]),
    ("CC-BY-SA-4.0", "mention", [{"ccbysa-mention", "ccbysa-work"}]),
    ("CC-BY-NC-4.0", "mention", [{"ccbync-mention", "ccbync-work"}]),
    ("Unlicense", "text", ["unlicense"]),
    ("Proprietary", "mention", ["rights"]),
]
#: A licence that another one, if found, includes.
COVERED = {"BSD-2-Clause": "BSD-3-Clause"}
HINTS = ("licen", "permission", "copyright", "warrant", "redistribut", "rights reserved", "public domain", "mpl", *(f"{w} under" for w in SAID))
#: Sentence ends, for Spark and DuckDB alike: closing marks before white space, or the end of a paragraph.
ACROSS_LINES = r"[.!?]+[ \t\n\r]+|:[ \t\r]*\n|\n[ \t\r]*\n"
AT_LINES = r"[.!?]+[ \t\r]+|\n"
_JUNK = "[^a-z0-9]+"


def normal(sentence: str) -> str:
    return re.sub(_JUNK, " ", sentence.lower()).strip()


def mentions() -> dict[str, list[str]]:
    """By licence, the sentences that every licence has by rule, normalised: mentions and SPDX lines."""
    out = {}
    for spdx, names in NAMES.items():
        lines = [f"SPDX-License-Identifier: {spdx}{more}" for more in ("", *(SPDX_MORE if "GPL" in spdx else ()))]
        out[spdx] = list(dict.fromkeys(normal(x) for x in [*lines, *(f"{said} under {name}" for said in SAID for name in names)]))
    return out


def _written() -> tuple[list[str], dict[str, int]]:
    """``SENTENCES``, normalised, and the number of each identifier (from 1).

    A sentence of the table that the cutting would divide is known by its longest part.
    """
    known, number = [], {}
    for name, sentence in SENTENCES.items():
        part = max((normal(p) for p in re.split(ACROSS_LINES, sentence)), key=len)
        if part not in known:
            known.append(part)
        number[name] = known.index(part) + 1
    return known, number


def dictionary() -> tuple[dict[str, int], dict[str, int]]:
    """The number of each known sentence, normalised, and of each identifier.

    The mentions of one licence, where they aren't written out, have one number, under
    its name.
    """
    known, number = _written()
    numbers = {part: k for k, part in enumerate(known, 1)}
    for k, (spdx, parts) in enumerate(mentions().items(), len(known) + 1):
        numbers |= {p: k for p in parts if p not in numbers}
        number[f"{spdx} mentioned"] = k
    for part in numbers:
        if not any(h in part for h in HINTS):
            raise ValueError(f"no hint in: {part}")
    return numbers, number


def rule_patterns() -> list[tuple[str, str, str]]:
    """(licence, form, regex over ",3,17,") by rule."""
    _, number = dictionary()
    out = []
    for licence, form, order in [*RULES, *((spdx, "mention", [f"{spdx} mentioned"]) for spdx in NAMES)]:
        steps = ["(" + "|".join(sorted({str(number[s]) for s in (step if isinstance(step, set) else {step})})) + ")" for step in order]
        out.append((licence, form, "," + ",([0-9]+,)*".join(steps) + ","))
    return out


_BUCKETS = 256
#: Behind these a sentence may begin anew; and where a mention begins, in normalised words.
_INSIDE = r"\n|:[ \t]"
_MARK = "\x01"
_UNMARKED = f"[^a-z0-9{_MARK}]+"
_MENTION = "(?:^|.* )((?:" + "|".join(SAID) + ") under .*)$"
_DENIED = "(^| )(not|never|no longer|formerly|previously)( |$)"


def _looked_up(sentence: Column) -> Column:
    """The number of a normalised sentence, null where it isn't known."""
    numbers, _ = dictionary()
    dealt: list[list[str]] = [[] for _ in range(_BUCKETS)]
    for part in numbers:
        dealt[zlib.crc32(part.encode()) % _BUCKETS].append(part)
    row = F.get(F.from_json(F.lit(json.dumps(dealt)), "array<array<string>>"), F.pmod(F.crc32(sentence), F.lit(_BUCKETS)).cast("int"))
    value = F.get(F.from_json(F.lit(json.dumps([[numbers[p] for p in some] for some in dealt])), "array<array<int>>"), F.pmod(F.crc32(sentence), F.lit(_BUCKETS)).cast("int"))
    return F.get(value, F.array_position(row, sentence).cast("int") - 1)


def _longest() -> int:
    """Characters that a known sentence has at most, with marks between its words."""
    return 3 * max(map(len, dictionary()[0]))


def _number(sentence: Column) -> Column:
    """The number of a sentence as it stands, or of its longest known end; no longer end than a known sentence is tried."""
    marked = F.trim(F.regexp_replace(F.regexp_replace(F.lower(sentence), _INSIDE, _MARK), _UNMARKED, " "))
    parts = F.filter(F.split(F.right(marked, F.lit(_longest())), f" ?{_MARK} ?", -1), lambda x: x != "")
    ends = F.transform(parts, lambda x, k: F.array_join(F.slice(parts, k + 1, F.size(parts)), " "))
    mention = F.transform(ends, lambda x: F.when(~x.rlike(_DENIED), F.regexp_extract(x, _MENTION, 1)))
    known = F.filter(F.transform(F.concat(ends, mention), _looked_up), lambda k: k.isNotNull())
    return F.when(F.lower(sentence).rlike("|".join(HINTS)), F.get(known, F.lit(0)))


def _sequence(text: Column, cut: str) -> Column:
    """The text's known sentences, by number, as ",3,17,"."""
    found = F.filter(F.transform(F.split(text, cut, -1), _number), lambda k: k.isNotNull())
    return F.when(F.size(found) > 0, F.concat(F.lit(","), F.array_join(F.transform(found, lambda k: k.cast("string")), ","), F.lit(","))).otherwise(F.lit(","))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, licenses ("MIT:mention,...", by licence), n_sentences, sequence for every row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hinted = F.lower(text).rlike("|".join(HINTS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(hinted, text).alias("hinted"))
    none = F.lit(",")
    rows = rows.withColumn("across", F.coalesce(F.when(F.col("hinted").isNotNull(), _sequence(F.col("hinted"), ACROSS_LINES)), none))
    rows = rows.withColumn("lines", F.coalesce(F.when(F.col("hinted").isNotNull(), _sequence(F.col("hinted"), AT_LINES)), none))
    forms: dict[str, list[tuple[str, str]]] = {}
    for licence, form, pattern in rule_patterns():
        forms.setdefault(licence, []).append((form, pattern))
    found = {}
    for licence, tries in forms.items():
        case = None
        for form, pattern in tries:
            hit = F.col("across").rlike(pattern) | F.col("lines").rlike(pattern)
            case = F.when(hit, F.lit(f"{licence}:{form}")) if case is None else case.when(hit, F.lit(f"{licence}:{form}"))
        found[licence] = case
    for small, large in COVERED.items():
        found[small] = F.when(found[large].isNull(), found[small])
    some = (F.col("across") != ",") | (F.col("lines") != ",")
    licenses = F.when(some, F.concat_ws(",", *[found[k] for k in sorted(found)])).otherwise(F.lit(""))
    n = F.greatest(*[F.length(c) - F.length(F.replace(F.col(c), F.lit(","), F.lit(""))) - 1 for c in ("across", "lines")]).cast("long")
    return rows.select("doc_id", licenses.alias("licenses"), n.alias("n_sentences"), F.when(F.col("across") != ",", F.col("across")).otherwise(F.col("lines")).alias("sequence"))


def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = "map {" + ", ".join(f"{quoted(part)}: {k}" for part, k in dictionary()[0].items()) + "}"
    marked = f"trim(regexp_replace(regexp_replace(lower(s), {quoted(_INSIDE)}, '{_MARK}', 'g'), '{_UNMARKED}', ' ', 'g'))"
    parts = f"list_filter(string_split_regex(right({marked}, {_longest()}), ' ?{_MARK} ?'), lambda x: x <> '')"
    ends = f"list_transform(range(1, len({parts}) + 1), lambda k: array_to_string(({parts})[k:], ' '))"
    mention = f"list_transform({ends}, lambda x: case when not regexp_matches(x, {quoted(_DENIED)}) then regexp_extract(x, {quoted(_MENTION)}, 1) end)"
    number = f"case when regexp_matches(lower(s), '{'|'.join(HINTS)}') then list_filter(list_transform(list_concat({ends}, {mention}), lambda e: (m)[e]), lambda k: k is not null)[1] end"
    sequence = lambda cut: f"list_filter(list_transform(string_split_regex(t, {quoted(cut)}), lambda s: {number}), lambda k: k is not null)"
    forms: dict[str, list[tuple[str, str]]] = {}
    for licence, form, pattern in rule_patterns():
        forms.setdefault(licence, []).append((form, pattern))
    cases = {
        licence: "case " + " ".join(f"when regexp_matches(a, '{p}') or regexp_matches(l, '{p}') then '{licence}:{form}'" for form, p in tries) + " end" for licence, tries in forms.items()
    }
    for small, large in COVERED.items():
        cases[small] = f"case when ({cases[large]}) is null then {cases[small]} end"
    joined = "concat_ws(',', " + ", ".join(cases[k] for k in sorted(cases)) + ")"
    return f"""
        with d as (select doc_id, coalesce(text, '') as t, {known} as m from documents),
        s as (
            select doc_id, case when regexp_matches(lower(t), '{"|".join(HINTS)}') then {sequence(ACROSS_LINES)} else [] end as across,
                   case when regexp_matches(lower(t), '{"|".join(HINTS)}') then {sequence(AT_LINES)} else [] end as at_lines
            from d
        ), j as (
            select doc_id, case when len(across) > 0 then ',' || array_to_string(across, ',') || ',' else ',' end as a,
                   case when len(at_lines) > 0 then ',' || array_to_string(at_lines, ',') || ',' else ',' end as l, greatest(len(across), len(at_lines))::bigint as n_sentences
            from s
        )
        select doc_id, {joined} as licenses, n_sentences, case when a <> ',' then a else l end as sequence from j
    """


QUERIES = {"op6_license_rules": op6_license_rules}
ORACLES = {"op6_license_rules": _sql()}

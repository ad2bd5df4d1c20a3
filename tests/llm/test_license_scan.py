import oracle
from stratalith.llm import license_scan as L


def scan(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, licenses string")
    return [r.licenses for r in sorted(L.scan_licenses(df).collect(), key=lambda r: r.doc_id)]


def wrapped(name, width=60):
    out, line = [], ""
    for w in L.SENTENCES[name].split():
        if len(line) + len(w) > width:
            out.append(line)
            line = ""
        line = f"{line} {w}".strip()
    return "\n".join([*out, line])


def test_cases(spark):
    mit = "MIT License\n\nCopyright (c) someone\n\n" + "\n\n".join(wrapped(n) for n in ("mit-grant", "mit-notice", "mit-warranty"))
    bsd = "\n".join(wrapped(n) for n in ("bsd-grant", "bsd-source", "bsd-binary"))
    texts = [
        None,
        "",
        "nothing here",
        "a license is mentioned, but no known sentence",
        "words\nreleased UNDER the  MIT license.",
        "First line without an end\nLicensed under CC BY-NC 4.0.\nmore",
        mit,
        mit.replace("included in all copies", "put into all copies"),
        "\n\n".join(wrapped(n) for n in ("mit-notice", "mit-grant")),
        bsd,
        bsd + "\n" + wrapped("bsd-endorse"),
        "x " * 100000 + "\n" + L.SENTENCES["gpl3-mention"],
        L.SENTENCES["apache-mention"] + " " + L.SENTENCES["apache-mention"] + "\n" + L.SENTENCES["ccby-work"],
    ]
    assert scan(spark, texts) == [
        "", "", "", "", "MIT:mention", "CC-BY-NC-4.0:mention", "MIT:text", "MIT:notice", "MIT:notice", "BSD-2-Clause:text", "BSD-3-Clause:text", "GPL-3.0:mention", "Apache-2.0:mention,CC-BY-4.0:mention",
    ]


def test_every_sentence_is_found_alone(spark):
    _, number = L.dictionary()
    df = spark.createDataFrame([(number[k], s) for k, s in L.SENTENCES.items()], "doc_id long, text string")
    for r in L.scan_licenses(df).collect():
        assert f",{r.doc_id}," in r.sequence


def test_ends_mentions_and_spdx_lines(spark):
    texts = [
        "some words without an end\nThis project is licensed under\nthe MIT License.",
        "Notice: this project is licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "// SPDX-License-Identifier: GPL-3.0-or-later",
        "The code in this repository is released under the Apache License 2.0",
        "This is not licensed under the MIT License.",
        "All of it is distributed under the GNU Lesser General Public License, version 2.1.\nData: CC0, available under CC0 1.0.",
        "licensed under the terms of my own license",
        "line\n" * 20000 + "x licensed under the BSD 3-Clause License",
        "Licensed under GPLv2. Licensed under GPLv2. Licensed under GPLv2.",
    ]
    assert scan(spark, texts) == ["MIT:mention", "MIT:mention", "MIT:mention", "GPL-3.0:mention", "Apache-2.0:mention", "", "CC0-1.0:mention,LGPL-2.1:mention", "", "BSD-3-Clause:mention", "GPL-2.0:mention"]


def test_empty(spark):
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sql(spark):
    oracle.compare(spark, "/root/testdata/sf0.01", L.op6_license_rules, L.ORACLES["op6_license_rules"])

import json

import pytest
from pyspark.sql import functions as F

from stratalith import cli
from stratalith.functions import authoring as A
from stratalith.operators import chunking, export, filling, structure
from stratalith.sources import jsonlines, markdown, records

NOTES = """---
format: "1.1"
doc: notes
created: 2024-01-01T00:00:00Z
---

# Notes

First text with $E = mc^2$ and $5 or $10.

## Today

<!-- e9 label=tab page=1 -->
| a | b |
| --- | --- |
| 1 | 2 |

<!-- type=caption reference=tab -->
Table 1: things

A para-

<!-- continues=above -->
graph that goes on.

## Next

Last words, see [the table](#tab).
"""


@pytest.fixture
def notes(tmp_path):
    rows, _ = A.parse(NOTES)
    path = tmp_path / "notes.jsonl"
    cli.write(path, cli.storage(rows))
    return path, rows


def lines(path, spark):
    return [(r.line, r.rule) for r in jsonlines.check_documents(spark, f"file://{path}").collect()]


def test_clean_file_passes(spark, notes):
    assert lines(notes[0], spark) == []


def test_rows_come_back(spark, notes):
    headers, els = jsonlines.read_documents(spark, f"file://{notes[0]}")
    assert headers.first().doc == "notes" and headers.first().elements == els.count()
    got = els.orderBy("pos").collect()
    assert [r.id for r in got] == [r["id"] for r in notes[1][1:]] and [r.md for r in got] == [r["md"] for r in notes[1][1:]]
    wrong = els.where(F.col("hash") != F.substring(F.sha2(F.concat("type", F.lit("\n"), "md"), 256), 1, 16))
    assert wrong.isEmpty()


def broken(rows, n, **change):
    rows = [dict(r) for r in rows]
    for k, v in change.items():
        if v is ...:
            rows[n].pop(k)
        else:
            rows[n][k] = v
    return cli.storage(rows)


BROKEN = [
        (lambda t, r: t.replace("\n", "\r\n"), (1, "line_end")),
        (lambda t, r: "﻿" + t, (1, "bom")),
        (lambda t, r: t.rstrip("\n"), (10, "last_line")),
        (lambda t, r: t.replace("\n", "\n\n", 1), (2, "empty")),
        (lambda t, r: t.replace('{"id"', '{"id', 1), (2, "json")),
        (lambda t, r: broken(r, 0, created="yesterday"), (1, "header")),
        (lambda t, r: broken(r, 0, elements=None), (1, "count")),
        (lambda t, r: broken(r, 0, elements=99), (1, "count")),
        (lambda t, r: broken(r, 0, date="2024-1"), (1, "header")),
        (lambda t, r: broken(r, 0, access=["bad group"]), (1, "header")),
        (lambda t, r: broken(r, 0, lang=...), (1, "required")),
        (lambda t, r: broken(r, 0, last_id=3), (4, "last_id")),
        (lambda t, r: broken(r, 2, characters=1), (3, "characters")),
        (lambda t, r: broken(r, 2, parent="notes#e77"), (3, "parent")),
        (lambda t, r: broken(r, 2, parent="notes#e9"), (3, "parent")),
        (lambda t, r: broken(r, 2, parent=...), (3, "required")),
        (lambda t, r: broken(r, 5, reference=["notes#e9"]), (6, "reference_list")),
        (lambda t, r: broken(r, 5, reference="notes#e55"), (6, "reference")),
        (lambda t, r: broken(r, 2, hash="0" * 16), (3, "hash")),
        (lambda t, r: broken(r, 8, md="see [x](#gone)"), (9, "link")),
        (lambda t, r: broken(r, 2, id="notes#e9"), (5, "duplicate_id")),
        (lambda t, r: broken(r, 2, level=2), (3, "companion")),
        (lambda t, r: broken(r, 1, level=...), (2, "companion")),
        (lambda t, r: broken(r, 3, level=1), (4, "level")),
        (lambda t, r: broken(r, 4, bbox=[1, 2, 3, 4000]), (5, "pattern")),
        (lambda t, r: broken(r, 2, md="two  \nspaces"), (3, "canonical")),
        (lambda t, r: broken(r, 2, type="poem"), (3, "pattern")),
        (lambda t, r: t + t.split("\n")[0] + "\n", (11, "header_line")),
        (lambda t, r: "\n".join(t.split("\n")[1:]), (1, "header_line")),
]
def test_broken_files(spark, notes, tmp_path):
    path, rows = notes
    for k, (change, _) in enumerate(BROKEN):
        (tmp_path / f"bad{k}.jsonl").write_bytes(change(path.read_text(encoding="utf-8"), rows).encode())
    found: dict[str, set] = {}
    for r in jsonlines.check_documents(spark, f"file://{tmp_path}/bad*.jsonl").collect():
        found.setdefault(r.path.rsplit("/", 1)[1], set()).add((r.line, r.rule))
    assert [k for k, (_, want) in enumerate(BROKEN) if want not in found.get(f"bad{k}.jsonl", ())] == []


def test_not_utf8(spark, tmp_path):
    (tmp_path / "x.jsonl").write_bytes(b"\xff\xfe{}")
    assert (1, "utf8") in [(r.line, r.rule) for r in jsonlines.check_files(spark, f"file://{tmp_path}/x.jsonl").collect()]


def test_strict_reading_names_the_line(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"type":"document","doc":"x"}\n{broken\n')
    with pytest.raises(Exception, match="line 2"):
        jsonlines.read_documents(spark, f"file://{tmp_path}/x.jsonl")[1].collect()
    assert jsonlines.read_documents(spark, f"file://{tmp_path}/x.jsonl", strict=False)[1].count() == 0


def test_folder_keeps_the_first_of_two_files(spark, notes, tmp_path):
    (tmp_path / "z_copy.jsonl").write_text(notes[0].read_text())
    headers, els = jsonlines.load_folder(spark, f"file://{tmp_path}/*.jsonl")
    assert headers.count() == 1 and headers.first().path.endswith("notes.jsonl") and els.count() == len(notes[1]) - 1


def test_texts_as_tables_and_back(spark, tmp_path):
    (tmp_path / "a.md").write_text(NOTES)
    (tmp_path / "b.md").write_text("<!-- e1 page=x -->\ntext")
    texts = markdown.read_texts(spark, f"file://{tmp_path}/*.md")
    got = markdown.parse_texts(texts)
    assert [r.error[:6] for r in got.where("error is not null").collect()] == ["line 1"]
    good = got.where("error is null")
    text = markdown.render_documents(good).first().text
    assert A.parse(text)[0][1:] == A.parse(NOTES)[0][1:]
    headers, els = markdown.as_tables(good)
    assert headers.first().doc == "notes" and els.count() == 9


def test_fill_by_columns_equals_fill_by_rows(spark, notes):
    rows = [{k: v for k, v in r.items() if k in ("id", "type", "level", "md")} for r in notes[1][1:]]
    rows[2].pop("id")
    want = A.fill([{"type": "document", "doc": "notes"}, *rows])
    df = spark.createDataFrame([("notes", n, r.get("id"), r["type"], r.get("level"), r["md"]) for n, r in enumerate(rows)], "doc string, pos int, id string, type string, level int, md string")
    heads = spark.createDataFrame([("notes", None)], "doc string, last_id long")
    els, h = filling.fill(df, heads)
    got = [(r.id, r.type, r.level, r.md, r.parent, r.hash, r.characters) for r in els.orderBy("pos").collect()]
    assert got == [(r["id"], r["type"], r.get("level"), r["md"], r["parent"], r["hash"], r["characters"]) for r in want[1:]]
    head = h.first()
    assert (head.sha256, head.elements, head.last_id, head.structure) == (want[0]["sha256"], want[0]["elements"], want[0]["last_id"], True)


def test_chunks(spark, notes):
    _, els = jsonlines.read_documents(spark, f"file://{notes[0]}")
    els = els.withColumn("reference", F.when(~F.col("reference_is_list"), F.col("reference")))
    by = {r.id: r for r in chunking.element_chunks(els).collect()}
    table = by["notes#e9"]
    assert len(table.elements) == 2 and table.md.endswith("Table 1: things") and table.text.startswith("Notes > Today\n\n")
    joined = next(r for r in by.values() if "goes on" in r.md)
    assert joined.md == "A paragraph that goes on." and len(joined.elements) == 2
    sections = chunking.section_chunks(els).orderBy("pos").collect()
    # a deeper heading right behind a heading would join it; here text stands between them
    assert [len(s.elements) for s in sections] == [2, 5, 2]
    parts = chunking.section_chunks(els, max_chars=40).collect()
    assert {p.id for p in parts} >= {f"{sections[1].id}/1", f"{sections[1].id}/2"}


def test_strict_access_never_widens(spark):
    rows = [("d", 0, "d#e1", "heading", 1, "# H", None, None, ["all"]), ("d", 1, "d#e2", "paragraph", None, "open", None, "d#e1", ["all"]), ("d", 2, "d#e3", "paragraph", None, "secret", None, "d#e1", ["staff"])]
    df = spark.createDataFrame(rows, "doc string, pos int, id string, type string, level int, md string, continues string, parent string, access array<string>").withColumn("hash", F.md5("md")).withColumn("page", F.lit(0))
    loose = chunking.section_chunks(df).collect()
    assert len(loose) == 1 and loose[0].access == ["all"] and "secret" in loose[0].md
    strict = chunking.section_chunks(df, strict_access=True).collect()
    assert all("secret" not in c.md for c in strict if c.access == ["all"]) and len(strict) == 2


def test_export(spark, notes):
    headers, els = jsonlines.read_documents(spark, f"file://{notes[0]}")
    md = export.to_markdown(els).first().text
    assert "A paragraph that goes on." in md and md.startswith("# Notes\n\n")
    page = export.to_html(els, headers).first().html
    assert '<span class="math inline">\\(E = mc^2\\)</span> and $5 or $10' in page and "mathjax" in page
    assert '<p class="caption">' in page and "<th>a</th>" in page and '<a href="#tab">the table</a>' in page


def test_records_mails_and_subtitles(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Name,Age\nAnn,3\nBo,\n")
    assert [r.md for r in records.read_csv(spark, f"file://{tmp_path}/t.csv", "t").orderBy("pos").collect()] == ["Name: Ann\nAge: 3", "Name: Bo"]
    (tmp_path / "t.jsonl").write_text(json.dumps({"a": 1, "b": "x"}) + "\n")
    assert records.read_json(spark, f"file://{tmp_path}/t.jsonl", "t").first().md == "a: 1\nb: x"
    (tmp_path / "m.eml").write_text("From: ann@x.org\nSubject: Hi\n\nHello there\n")
    assert records.read_mails(spark, f"file://{tmp_path}/m.eml").first().md == "**ann@x.org**\n\nHi\n\nHello there"
    (tmp_path / "s.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nHello\nyou\n\n2\n00:00:03,000 --> 00:00:04,000\nBye\n")
    assert [r.md for r in records.read_subtitles(spark, f"file://{tmp_path}/s.srt").orderBy("pos").collect()] == ["Hello\nyou", "Bye"]


def test_commands(spark, notes, tmp_path, capsys):
    path, rows = notes
    assert cli.main(["md", str(path), "-o", str(tmp_path / "n.md")]) == 0
    assert cli.main(["md", str(tmp_path / "n.md"), "-o", str(tmp_path / "n.jsonl")]) == 0
    assert [json.loads(s)["id"] for s in (tmp_path / "n.jsonl").read_text().splitlines()[1:]] == [r["id"] for r in rows[1:]]
    assert cli.main(["info", str(path)]) == 0 and "outline:" in capsys.readouterr().out
    assert cli.main(["check", str(path)]) == 0
    path.write_text(path.read_text().replace('"characters":', '"characters":9', 1))
    assert cli.main(["check", str(path)]) == 1 and "characters should be" in capsys.readouterr().out
    assert cli.main(["info", str(tmp_path / "missing.jsonl")]) == 2
    old, changed = cli.upgrade([rows[0] | {"version": "0.5"}, *rows[1:]])
    assert old[0]["version"] == "1.1" and changed == 0
    with pytest.raises(ValueError, match=r"9\.9"):
        cli.upgrade([rows[0] | {"version": "9.9"}])


def test_parents_of_random_rows(spark):
    import random

    rng = random.Random(1)
    rows = [(f"d{k % 3}", k, f"d{k % 3}#e{k}", rng.choice(["heading", "paragraph"]), rng.randrange(1, 7), "x") for k in range(400)]
    df = spark.createDataFrame(rows, "doc string, pos int, id string, type string, level int, md string")
    got = {r.id: r.parent for r in structure.default_parent(df).collect()}
    for doc in ("d0", "d1", "d2"):
        places = A.Places()
        for _, _, i, t, level, _ in (r for r in rows if r[0] == doc):
            row = {"id": i, "type": t, "level": level}
            above = places.parent(row)
            assert got[i] == (above and above["id"])
            places.add(row)

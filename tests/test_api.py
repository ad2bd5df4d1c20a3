import json

import pytest

from stratalith import api, cli
from stratalith.functions import authoring as A

BOOK = """---
doc: book
title: A book
access: ["staff"]
meta: {"x.body": "book#e3"}
---

# Cover

Front words.

# One

First.

![A picture](images/book_e5.png)

<!-- type=caption reference=above -->
Figure 1

## Two

<!-- access=all page=4 bbox=1,2,3,4 -->
Second.
"""


@pytest.fixture
def book(tmp_path):
    path = tmp_path / "book.jsonl"
    cli.write(path, cli.storage(A.parse(BOOK)[0]))
    return path


def test_chunks_carry_the_fields_of_their_documents(spark, book):
    got = {r.id: r for r in api.chunks(spark, book.as_uri()).collect()}
    assert sorted(got) == ["book#e3", "book#e4", "book#e5", "book#e7", "book#e8"]
    assert got["book#e8"].path == ["One", "Two"] and got["book#e8"].access == ["all"] and got["book#e8"].bbox == [1, 2, 3, 4] and got["book#e8"].page == 4
    assert got["book#e4"].access == ["staff"] and got["book#e4"].title == "A book" and got["book#e4"].source == "book.md"
    assert got["book#e5"].file == "images/book_e5.png" and got["book#e5"].md.endswith("Figure 1") and got["book#e5"].elements == ["book#e5", "book#e6"]
    assert len(api.chunks(spark, book.as_uri(), front=True).collect()) == 7
    sections = {r.id: r for r in api.chunks(spark, book.as_uri(), by="section").collect()}
    assert list(sections) == ["book#e3"] or set(sections) == {"book#e3", "book#e7"}
    with pytest.raises(ValueError, match="by page"):
        api.chunks(spark, book.as_uri(), by="page")


def test_folder_for_search_has_no_heading_chunks(spark, book):
    rows = [json.loads(line) for line in book.read_text().splitlines()]
    cli.write(book.parent / "zcopy.jsonl", cli.storage(rows))
    got = api.folder_chunks(spark, f"{book.parent.as_uri()}/*.jsonl", by="element").collect()
    assert got == [] or all(r.type != "heading" for r in got)


def test_missing_images_are_reported(spark, book):
    there = {(r.rule, r.line) for r in api.check(spark, book.as_uri()).collect()}
    lost = {(r.rule, r.line) for r in api.check(spark, book.as_uri(), images=book.parent.as_uri()).collect()}
    assert lost - there == {("file", 6)}
    (book.parent / "images").mkdir()
    (book.parent / "images" / "book_e5.png").write_bytes(b"png")
    assert {(r.rule, r.line) for r in api.check(spark, book.as_uri(), images=book.parent.as_uri()).collect()} == there


def test_info_lines(spark, book):
    lines = api.info_text(*api.load(spark, book.as_uri())).first().text.split("\n")
    assert lines[0] == "A book  (doc: book, version 1.1)" and "elements: 8  (" in "\n".join(lines)
    assert "  heading    3" in lines and lines[lines.index("outline:") + 1 :] == ["- Cover  [e1]", "- One  [e3]", "  - Two  [e7]", ""]


def test_shorthand(spark, tmp_path, capsys):
    (tmp_path / "My Notes.md").write_text("---\ndoc: notes\n---\n\n# A\n\nb\n")
    assert cli.spelled_out(["x.md", "y.jsonl", "--force"]) == ["new", "x.md", "-o", "y.jsonl", "--force"]
    assert cli.spelled_out(["x.jsonl", "y.html"]) == ["export", "x.jsonl", "-o", "y.html", "--to", "html"]
    assert cli.main([str(tmp_path / "My Notes.md"), str(tmp_path / "out.jsonl")]) == 0 and "PASSED" in capsys.readouterr().out
    assert [json.loads(x)["type"] for x in (tmp_path / "out.jsonl").read_text().splitlines()] == ["document", "heading", "paragraph"]
    assert cli.main(["new", str(tmp_path / "fresh")]) == 0 and (tmp_path / "fresh.md").exists()
    assert cli.main(["new", str(tmp_path / "fresh")]) == 2

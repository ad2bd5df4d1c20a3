import json

from stratalith import cli
from stratalith.functions import authoring as A
from stratalith.streaming import incremental as I


def put(folder, name, text):
    cli.write(folder / f"{name}.jsonl", cli.storage(A.parse(text, name)[0]))


def test_only_changed_chunks_are_embedded(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    seen: list[list[str]] = []
    embed = lambda df: seen.append(sorted(r.id for r in df.collect()))

    def go():
        I.follow(spark, f"file://{folder}", f"file://{tmp_path}/state", f"file://{tmp_path}/checkpoint", embed).awaitTermination()

    put(folder, "a", "# One\n\ntext\n\n# Two\n\nmore")
    go()
    put(folder, "b", "# Other\n\nx")
    go()
    # a changed document arrives as a new file
    rows = A.parse("# One\n\ntext\n\n# Two\n\nchanged", "a")[0]
    (folder / "a2.jsonl").write_text(cli.storage(rows))
    go()
    assert seen == [["a#e1", "a#e3"], ["b#e1"], ["a#e3"]]


def test_removed_chunks_are_handed_on(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    gone: list[list[str]] = []

    def go():
        I.follow(spark, f"file://{folder}", f"file://{tmp_path}/state", f"file://{tmp_path}/checkpoint", lambda df: df.collect(), remove=lambda df: gone.append(sorted(r.id for r in df.collect()))).awaitTermination()

    put(folder, "a", "# One\n\ntext\n\n# Two\n\nmore")
    go()
    (folder / "a2.jsonl").write_text(cli.storage(A.parse("# One\n\ntext", "a")[0]))
    go()
    (folder / "a3.jsonl").write_text(cli.storage(A.parse("", "a")[0]))
    go()
    assert gone == [[], ["a#e3"], ["a#e1"]]
    assert I.read_state(spark, f"file://{tmp_path}/state", 9).isEmpty()
    assert I.read_state(spark, f"file://{tmp_path}/state", 1).count() == 2
    assert I.read_state(spark, f"file://{tmp_path}/none", 1).isEmpty()


def test_event_windows(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = I.event_windows(events, "ts", ["event_type"], "1 day", "1 hour")
    assert got.groupBy().sum("n").first()[0] == events.count()
    sliding = I.event_windows(events, "ts", [], "2 days", "1 hour", "1 day")
    assert sliding.groupBy().sum("n").first()[0] == 2 * events.count()
    assert json.dumps(got.columns)

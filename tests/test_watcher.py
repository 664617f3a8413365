"""The folder source: every change once, over restarts and over a batch that is run again."""

import os

from loomstone.streaming import watcher


def test_changes_between_listings(tmp_path):
    (tmp_path / "a.py").write_text("1")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.py").write_text("22")
    (tmp_path / "c.txt").write_text("3")
    first = watcher.listing(str(tmp_path), "*.py")
    assert {k: v[0] for k, v in first.items()} == {"a.py": 1, os.path.join("sub", "b.py"): 2}
    os.remove(tmp_path / "a.py")
    (tmp_path / "sub" / "b.py").write_text("333")
    (tmp_path / "d.py").write_text("")
    assert [x[:3] for x in watcher.changes(first, watcher.listing(str(tmp_path), "*.py"))] == [("a.py", "deleted", 1), ("d.py", "created", 0), (os.path.join("sub", "b.py"), "changed", 3)]
    assert watcher.listing(str(tmp_path / "none"), "*") == {}


def test_restarts_lose_and_repeat_nothing(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()

    def run():
        q = watcher.watch_folder(spark, str(root), str(tmp_path / "snapshots"), "*.py").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        q.processAllAvailable()
        q.stop()
        return sorted((r["path"], r["event"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (root / "a.py").write_text("1")
    (root / "b.py").write_text("1")
    (root / "c.md").write_text("1")
    assert run() == [("a.py", "created"), ("b.py", "created")]
    assert run() == [("a.py", "created"), ("b.py", "created")]
    (root / "a.py").write_text("changed")
    os.remove(root / "b.py")
    want = [("a.py", "changed"), ("a.py", "created"), ("b.py", "created"), ("b.py", "deleted")]
    assert run() == want
    # The last batch was planned but not done: it is run again, though the folder has changed since.
    last = max(int(n) for n in os.listdir(tmp_path / "check" / "commits") if n.isdigit())
    os.remove(tmp_path / "check" / "commits" / str(last))
    os.remove(tmp_path / "out" / "_spark_metadata" / str(last))
    for hidden in (tmp_path / "check" / "commits" / f".{last}.crc", tmp_path / "out" / "_spark_metadata" / f".{last}.crc"):
        hidden.unlink(missing_ok=True)
    (root / "e.py").write_text("late")
    assert run() == sorted([*want, ("e.py", "created")])

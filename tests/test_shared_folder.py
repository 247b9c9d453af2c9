"""Files that executors write need a folder that all of them see."""

from pathlib import Path

import pytest

from polescale.sources import files


class Elsewhere:
    """A session on a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda key, other=None: other)

    class sparkContext:
        master, getCheckpointDir = "yarn", staticmethod(lambda: None)


def test_folder(spark):
    with pytest.raises(ValueError, match="checkpoint.dir"):
        files.shared_folder(Elsewhere, "x")
    assert files.shared_folder(spark, "x") != files.shared_folder(spark, "x")


def test_writing(spark):
    folder = files.shared_folder(spark, "w")
    rows = spark.createDataFrame([("a.txt", "é"), ("b/c.md", ""), ("b/d", "x")], "name string, content string")
    assert files.write_files(rows, folder) == 3
    root = Path(folder.removeprefix("file://"))
    assert sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file()) == ["a.txt", "b/c.md", "b/d"] and (root / "a.txt").read_text(encoding="utf-8") == "é"
    assert files.write_files(rows.where("false"), folder) == 0

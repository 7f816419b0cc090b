from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from thicket import Config
from thicket.plans import declutter, find_edges
from thicket.sources import snapshots


def texts(frame):
    return {r["path"]: r["content"] for r in frame.collect()}


@pytest.fixture
def corpus(notes, tmp_path):
    given = {f"d/n{i}.md": f"text {i} about Topic" for i in range(40)} | {"Topic.md": "x", "empty.md": ""}
    location = str(tmp_path / "corpus")
    assert snapshots.create(notes(given), location, buckets=8) == 0
    return given, location, tmp_path / "corpus"


def written_buckets(folder):
    return sorted(p.name for p in max((folder / "data").iterdir(), key=lambda p: p.stat().st_mtime_ns).glob("bucket=*"))


def test_one_accepted_link_writes_one_bucket(spark, corpus):
    given, location, folder = corpus
    accepted = spark.createDataFrame([("d/n7.md", "Topic")], "path string, target string")
    notes = snapshots.read(spark, location)
    whole = texts(find_edges.insert(notes, Config(), accepted).notes)
    assert find_edges.insert_into(spark, location, Config(), accepted) == 1
    assert len(written_buckets(folder)) == 1
    assert texts(snapshots.read(spark, location)) == whole == given | {"d/n7.md": "text 7 about [[Topic]]"}
    assert texts(snapshots.read(spark, location, 0)) == given  # the earlier version stays
    assert snapshots.versions(spark, location) == [0, 1]
    # Buckets that did not change are the same folders in both manifests.
    old, new = (
        {r["bucket"]: r["folder"] for r in spark.read.parquet(f"{location}/manifest/version={v}").collect()} for v in (0, 1)
    )
    assert sum(old[b] != new[b] for b in old) == 1


def test_all_links_equal_the_full_write(spark, corpus):
    _, location, _ = corpus
    whole = texts(find_edges.insert(snapshots.read(spark, location), Config()).notes)
    find_edges.insert_into(spark, location, Config())
    assert texts(snapshots.read(spark, location)) == whole


def test_moves_equal_the_full_write(spark, notes, tmp_path):
    given = {"a/x.md": "", "b/x.md": "", "c.md": "see [[a/x]] and [[b/x|that]] in five or more words", "d.md": "five words are enough here"}
    location = str(tmp_path / "moved")
    snapshots.create(notes(given), location, buckets=16)
    stored = snapshots.read(spark, location)
    flagged = declutter.scan(stored, Config())
    whole = texts(declutter.trash(stored, flagged, Config(), 1000).notes)
    assert declutter.trash_in(spark, location, flagged, Config(), 1000) == 1
    assert texts(snapshots.read(spark, location)) == whole
    assert "_trash/x.md" in whole and "[[_trash/x" in whole["c.md"]


def test_changes(spark, corpus):
    given, location, _ = corpus
    schema = "path string, new_path string, content string"
    none = spark.createDataFrame([], schema)
    assert snapshots.change(spark, location, none) == 0
    rows = [("Topic.md", None, None), ("empty.md", "e/empty.md", None), ("gone.md", "gone.md", "x"), ("d/n1.md", "d/n1.md", "new")]
    assert snapshots.change(spark, location, spark.createDataFrame(rows, schema)) == 1
    expected = given | {"e/empty.md": "", "d/n1.md": "new"}
    del expected["Topic.md"], expected["empty.md"]
    assert texts(snapshots.read(spark, location)) == expected


def test_versions_are_never_overwritten(spark, notes, corpus):
    _, location, folder = corpus
    with pytest.raises(FileExistsError):
        snapshots.create(notes({"a.md": "x"}), location)
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, location, 7)
    # A version that was not written to the end does not count.
    (folder / "manifest" / "version=1").mkdir()
    assert snapshots.versions(spark, location) == [0]


def test_corpus_without_notes(spark, notes, tmp_path):
    location = str(tmp_path / "none")
    snapshots.create(notes({"a.md": "x"}).filter(F.lit(False)), location)
    assert texts(snapshots.read(spark, location)) == {}
    change = spark.createDataFrame([("a.md", "b.md", "x")], "path string, new_path string, content string")
    assert snapshots.change(spark, location, change) == 0


def test_other_columns_stay(spark, tmp_path):
    location = str(tmp_path / "wide")
    snapshots.create(spark.createDataFrame([("a.md", "x", 7)], "path string, content string, size int"), location)
    change = spark.createDataFrame([("a.md", "b.md", "y")], "path string, new_path string, content string")
    snapshots.change(spark, location, change)
    assert [tuple(r) for r in snapshots.read(spark, location).select("path", "content", "size").collect()] == [("b.md", "y", 7)]

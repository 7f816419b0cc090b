from __future__ import annotations

import pytest

from thicket import Config
from thicket.operators.clutter import flag_clutter
from thicket.sources.tables import merge_changes, read_notes, with_path_parts, write_snapshot
from thicket.sources.vault import list_files, read_vault, write_vault


@pytest.fixture
def vault(tmp_path):
    files = {
        "zero.md": b"",
        "crlf.md": b"---\r\na: 1\r\n---\r\nb",
        "bom.md": b"\xef\xbb\xbftext",
        "deep/er/sp ace \xc3\xa9.md".encode("latin-1").decode("utf-8"): "é".encode(),
        "deep/broken.md": b"a\xffb",
        "pic.png": b"x",
    }
    root = tmp_path / "va ult"
    for path, content in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)
    return root


def test_read_vault(spark, vault):
    found = {r["path"]: r["content"] for r in read_vault(spark, str(vault)).collect()}
    assert found == {
        "zero.md": "",
        "crlf.md": "---\r\na: 1\r\n---\r\nb",
        "bom.md": "﻿text",
        "deep/er/sp ace é.md": "é",
        "deep/broken.md": "a�b",
    }
    everything = {r["path"] for r in list_files(spark, str(vault)).collect()}
    assert everything == set(found) | {"pic.png"}
    flagged = {r["path"]: r["reasons"] for r in flag_clutter(read_vault(spark, str(vault)), Config()).collect()}
    assert flagged["zero.md"] == ["empty"]


def test_folders_are_listed_by_tasks(spark, vault):
    """No list of names goes through the driver, and listing opens no file."""
    listed = list_files(spark, str(vault))
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" not in plan and "Scan binaryFile" not in plan
    assert "pic.png" in {r["path"] for r in listed.collect()}


def test_many_folders(spark, tmp_path):
    for i in range(60):
        folder = tmp_path / f"f{i % 7}" / f"g{i % 3}" / f"h{i}"
        folder.mkdir(parents=True)
        (folder / f"n{i}.md").write_text("" if i % 2 else f"text {i}")
    found = read_vault(spark, str(tmp_path)).collect()
    assert len(found) == 60 and sum(r["content"] == "" for r in found) == 30


def test_folder_named_like_its_parents(spark, tmp_path):
    folder = tmp_path / "notes" / "notes"
    (folder / "notes").mkdir(parents=True)
    (folder / "notes" / "a.md").write_text("x")
    inner = str(folder).lstrip("/")
    (folder / inner).mkdir(parents=True)
    (folder / inner / "b.md").write_text("y")
    assert {r["path"] for r in read_vault(spark, str(folder)).collect()} == {"notes/a.md", f"{inner}/b.md"}


def test_hidden_folders_are_named(spark, vault):
    (vault / "_trash").mkdir()
    (vault / "_trash" / "old.md").write_text("x")
    assert "_trash/old.md" not in {r["path"] for r in list_files(spark, str(vault)).collect()}
    seen = {r["path"] for r in list_files(spark, str(vault), also=["_trash", ".obsidian"]).collect()}
    assert {"_trash/old.md", "pic.png", "zero.md"} <= seen


def test_no_silent_overwrite(spark, vault, notes):
    with pytest.raises(FileExistsError):
        write_vault(notes({"a.md": "x"}), str(vault))


def test_write_vault(spark, vault, tmp_path):
    notes = read_vault(spark, str(vault))
    out = tmp_path / "out"
    written = write_vault(notes, out.as_uri()).agg({"written": "sum"}).first()[0]
    assert written == 5
    again = {r["path"]: r["content"] for r in read_vault(spark, str(out)).collect()}
    assert again == {r["path"]: r["content"] for r in notes.collect()}


def test_snapshots(spark, notes, tmp_path):
    given = notes({"a/x.md": "old", "b.md": "same", "c.txt": "no note"})
    write_snapshot(given, str(tmp_path / "one"))
    stored = read_notes(spark, str(tmp_path / "one"))
    assert stored.count() == 2
    merged = merge_changes(stored, notes({"a/x.md": "new"}))
    assert {tuple(r) for r in merged.collect()} == {("a/x.md", "new"), ("b.md", "same")}
    with pytest.raises(Exception, match="(?i)exist"):
        write_snapshot(merged, str(tmp_path / "one"))
    parts = {r["path"]: (r["name"], r["basename"], r["extension"]) for r in with_path_parts(stored).collect()}
    assert parts["a/x.md"] == ("x.md", "x", "md")

"""Freeze records and digest trees: planted changes are found, and only newer files are read again."""

from __future__ import annotations

import hashlib
import json
import os

import pytest

from tessera.operators import benchmark
from tessera.sources import freeze as Z, tables


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "frozen.v1+x"
    for i in range(12):
        d = root / f"part{i % 3}" / f"run{i % 2}"
        d.mkdir(parents=True, exist_ok=True)
        (d / f"f{i}.txt").write_text(f"content {i}")
    (root / "top.txt").write_text("top")
    for path in root.rglob("*.txt"):
        os.utime(path, (1_700_000_000, 1_700_000_000))
    return root


def tree(spark, folder, recorded=None, thorough=True):
    rows = Z.digest_tree(Z.file_digests(spark, str(folder), recorded, thorough)).collect()
    return spark.createDataFrame(rows, Z.TREE)


def states(a, b):
    return {(r.path, r.state) for r in Z.tree_differences(a, b).collect()}


def test_every_level_has_a_digest_that_names_do_not_bear_on(spark, folder):
    rows = {r.path: r for r in tree(spark, folder).collect()}
    assert {p for p, r in rows.items() if not r.is_file} == {"", *(f"part{i}" for i in range(3)), *(f"part{i}/run{j}" for i in range(3) for j in range(2))}
    assert rows["top.txt"].sha256 == hashlib.sha256(b"top").hexdigest()
    assert rows[""].bytes == sum(p.stat().st_size for p in folder.rglob("*.txt"))
    (folder / "top.txt").rename(folder / "other.txt")
    again = {r.path: r for r in tree(spark, folder).collect()}
    assert again[""].sha256 == rows[""].sha256 and "other.txt" in again


@pytest.mark.parametrize("thorough", [True, False])
def test_planted_changes_are_found_from_the_root_down(spark, folder, thorough):
    before = tree(spark, folder)
    assert states(before, tree(spark, folder, before, thorough)) == set()
    (folder / "part0/run0/f0.txt").write_text("changed 0")  # as long as before
    (folder / "part1/run1/f1.txt").unlink()
    (folder / "part2/run0/new.txt").write_text("new")
    got = states(before, tree(spark, folder, before, thorough))
    assert got == {("part0/run0/f0.txt", "changed"), ("part1/run1/f1.txt", "missing"), ("part2/run0/new.txt", "added"), *((p, "changed") for p in ("", "part0", "part0/run0", "part1", "part1/run1", "part2", "part2/run0"))}


def test_older_files_are_not_read_again(spark, folder):
    """A file that is changed and dated back is seen by a thorough look only, unless its length tells."""
    before = tree(spark, folder)
    path = folder / "part0/run0/f0.txt"
    path.write_text("changed 0")
    os.utime(path, (1_700_000_000, 1_700_000_000))
    assert states(before, tree(spark, folder, before, False)) == set()
    assert ("part0/run0/f0.txt", "changed") in states(before, tree(spark, folder, before, True))
    os.utime(path, (1_600_000_000, 1_600_000_000))
    assert ("part0/run0/f0.txt", "unknown") in states(before, tree(spark, folder, before, False))


@pytest.mark.parametrize("thorough", [True, False])
def test_long_files_are_in_the_tree_as_others_are(spark, folder, monkeypatch, thorough):
    (folder / "part1/long.txt").write_text("a line\n" * 2000)
    before = tree(spark, folder)
    monkeypatch.setattr(tables, "WHOLE_BYTES", 1000)
    assert sorted(tree(spark, folder, before, thorough).collect()) == sorted(before.collect())
    os.utime(folder / "part1/long.txt", (1_900_000_000, 1_900_000_000))
    (folder / "part2/long.txt").write_text("a line\n" * 1000)
    os.utime(folder / "part2/long.txt", (1_900_000_000, 1_900_000_000))
    assert states(before, tree(spark, folder, before, thorough)) == {("part2/long.txt", "added"), ("part2", "changed"), ("", "changed")}


def test_records_are_read_and_held_against_their_artefacts(spark, folder):
    sha = {p: hashlib.sha256((folder / p).read_bytes()).hexdigest() for p in ("top.txt", "part0/run0/f0.txt", "part1/run1/f1.txt")}
    text = tables.freeze_record("protocol", {"top": sha["top.txt"], "zero": sha["part0/run0/f0.txt"], "one": sha["part1/run1/f1.txt"], "n": 5}, ["top"])
    record = folder.parent / "record.json"
    record.write_text(text)
    loaded = Z.load_record(spark, str(record))
    referenced = spark.createDataFrame([("top", "top.txt"), ("zero", "part0/run0/f0.txt"), ("one", "part1/run1/f1.txt"), ("two", "top.txt")], "field string, path string")
    look = lambda required=(): {tuple(r) for r in Z.record_problems(loaded, required, referenced, Z.file_digests(spark, str(folder))).collect()}
    assert look() == {("two", "not in the record")}
    (folder / "part0/run0/f0.txt").write_text("x")
    (folder / "part1/run1/f1.txt").unlink()
    assert look(["n", "budget"]) == {("two", "not in the record"), ("zero", "changed"), ("one", "missing"), ("budget", "unfilled field")}
    record.write_text(text.replace('"n": 5', '"n": 6'))
    with pytest.raises(ValueError, match="edited"):
        Z.load_record(spark, str(record))
    record.write_text("{")
    with pytest.raises(ValueError, match="unreadable"):
        Z.load_record(spark, str(record))


def walked(document):
    """(path, status, value) of the leaves, one node after another."""
    out, todo = [], [("", document)]
    while todo:
        path, node = todo.pop()
        if isinstance(node, dict) and "status" in node:
            s = node["status"]
            out.append((path, "none" if s is None else str(s).strip().lower(), None))
        elif isinstance(node, dict):
            todo += [(f"{path}.{k}" if path else k, v) for k, v in node.items()]
        elif isinstance(node, list) and any(isinstance(v, (dict, list)) for v in node):
            todo += [(f"{path}[{i}]", v) for i, v in enumerate(node) if isinstance(v, (dict, list))]
        else:
            out.append((path, None, json.dumps(node, ensure_ascii=False)))
    return out


def test_protocols_are_walked_as_variants(spark):
    documents = [
        {"a": {"status": " Frozen ", "b": [1]}, "c": [1, "zwei", None, True], "d": {}, "e": [], "f": None},
        {"deep": {"er": {"est": [[1, 2], {"status": None}, 3, {"x": "ü", "y": [{"z": False}]}]}}, "n": 2.5, "m": -7, "status2": {"status": 4}},
        {"status": "tbd"}, [], [[], [[]]], "plain", 5, None, {},
    ]
    rows = [(i, json.dumps(d)) for i, d in enumerate(documents)] + [(99, None)]
    got = sorted((tuple(r) for r in benchmark.protocol_leaves(spark.createDataFrame(rows, "i int, path string"), "i", "path").collect()), key=repr)
    assert got == sorted(((i, *leaf) for i, d in enumerate(documents) for leaf in walked(d)), key=repr)
    with pytest.raises(Exception, match="MALFORMED|JSON"):
        benchmark.protocol_leaves(spark.createDataFrame([(1, "{")], "i int, t string"), "i", "t").collect()

"""Listings of real files against a walk over their folders."""

import os

import pytest

from siftline.sources import listings
from siftline.sources.tables import listing, objects, with_prefix


@pytest.fixture
def tree(tmp_path):
    for name, size in {"a/b/x.txt": 3, "a/b/y.txt": 0, "a/c.txt": 5, "a[1]/z*{q}.txt": 2, "ab.txt": 7, "b/x.txt": 1}.items():
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"k" * size)
    return str(tmp_path)


def walked(tree):
    files = (os.path.join(folder, f) for folder, _, names in os.walk(tree) for f in names)
    return {os.path.relpath(f, tree): os.path.getsize(f) for f in files}


def found(df, tree):
    return {r["path"].split(tree + "/", 1)[1]: r["size"] for r in df.collect()}


@pytest.mark.parametrize("prefix", ["", "a", "a/", "a/b/x", "a[", "a[1]/z*{", "ab", "b/", "none", "a/b/x.txt/no"])
def test_a_prefix_finds_what_a_walk_finds(spark, tree, prefix):
    wanted = {k: v for k, v in walked(tree).items() if k.startswith(prefix)}
    assert found(objects(spark, tree, prefix=prefix), tree) == wanted


@pytest.mark.parametrize("most", [1, 2, 100])
def test_tasks_and_driver_list_alike(tree, most, monkeypatch):
    monkeypatch.setattr(listings, "MOST_FOLDERS", most)
    reader = listings.ListingReader(tree, "a", True)
    rows = [r for part in reader.partitions() for r in reader.read(part)]
    assert {r[0].split(tree + "/", 1)[1]: r[1] for r in rows} == {k: v for k, v in walked(tree).items() if k.startswith("a")}


def test_folders_without_the_prefix_are_not_opened(tree, monkeypatch):
    reader = listings.ListingReader(tree, "a/b", True)
    opened, seen = reader.opened, []
    monkeypatch.setattr(reader, "opened", lambda folder: seen.append(folder) or opened(folder))
    assert [r for part in reader.partitions() for r in reader.read(part)] and set(seen) == {"a/", "a/b/"}


def test_one_level_alone(spark, tree):
    assert found(objects(spark, tree, recursive=False, prefix="a/"), tree) == {"a/c.txt": 5}


def test_the_first_paths_by_prefix(spark, tree):
    first = with_prefix(objects(spark, tree), f"file:{tree}/a", 2)
    assert list(found(first, tree)) == ["a/b/x.txt", "a/b/y.txt"]


def test_a_folder_holds_files_and_folders_of_no_size(spark, tree):
    rows = listing(objects(spark, tree, prefix="a/"), f"file:{tree}/a").collect()
    assert {(r["path"].split(tree)[1], r["is_folder"], r["size"], r["total_count"]) for r in rows} == {("/a/b", True, 0, 2), ("/a/c.txt", False, 5, 2)}

"""Files listed by executors: the rows of the driver's listing."""

import os

import pytest

from doctriage.sources.corpus import list_documents
from doctriage.sources.listing import FolderListing, list_files


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for folder in ("", "a", "a/b", "a/b/c", "d", "d/_hidden", "e f", "ü"):
        os.makedirs(root / folder, exist_ok=True)
        for name in ("x.pdf", "Y.PDF", "z.txt", ".h.pdf", "_u.pdf", "n{o}.pdf", "100% + é.pdf"):
            (root / folder / name).write_bytes(b"x" * (len(folder) + 1))
    os.makedirs(root / "empty")
    return str(root)


def rows(df):
    return sorted((r["path"], r["length"], r["modified"]) for r in df.collect())


@pytest.mark.parametrize("recursive", [False, True])
@pytest.mark.parametrize("pattern", ["*.[pP][dD][fF]", "*", "*.{txt,PDF}", "nothing"])
@pytest.mark.parametrize("partitions", [1, 32])
def test_equals_the_driver_s_listing(spark, tree, recursive, pattern, partitions):
    got = rows(list_files(spark, tree, recursive, pattern, partitions))
    want = rows(list_documents(spark, tree, recursive, pattern))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs((g[2] - w[2]).total_seconds()) < 1 for g, w in zip(got, want))


def test_one_file_whatever_its_name(spark, tree):
    assert [r[0] for r in rows(list_files(spark, f"{tree}/z.txt"))] == [f"{tree}/z.txt"]


def test_missing_folder(spark, tree):
    with pytest.raises(Exception, match="nowhere"):
        list_files(spark, f"{tree}/nowhere").collect()


def test_folders_are_dealt_out(spark, tree):
    reader = FolderListing({"path": tree, "recursive": "true", "partitions": "4"}).reader(None)
    parts = reader.partitions()
    assert len(parts) >= 4 and len({(p.path, p.deep) for p in parts}) == len(parts)


def test_a_hundred_thousand_files(spark, tmp_path):
    for i in range(100):
        os.makedirs(tmp_path / f"f{i}")
        for j in range(1000):
            os.close(os.open(tmp_path / f"f{i}" / f"{j}.pdf", os.O_CREAT | os.O_WRONLY))
    files = list_files(spark, str(tmp_path), recursive=True)
    assert files.select("path").distinct().count() == 100_000
    assert files.rdd.getNumPartitions() >= 32

"""Files that the tests write, read through the binaryFile source."""

import hashlib
import os
from urllib.parse import unquote, urlparse

import pytest

from quire.sources.raw_files import list_files, read_files, scan_files


@pytest.fixture
def folder(tmp_path):
    made = {"a.pdf": b"%PDF-1.4\n\x00\xff", "b.txt": "é and so on".encode(), "sub/c d.docx": b"PK\x03\x04" * 1000, "sub/deep/same.txt": "é and so on".encode(), "none.txt": b"", "big.bin": b"x" * 5000, "no_extension": b"\x00"}
    for name, data in made.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(tmp_path / "in"), made


def by_name(rows, top):
    return {os.path.relpath(unquote(urlparse(r.path).path), top): r for r in rows}


def test_scan_files(spark, folder):
    top, made = folder
    got = by_name(scan_files(spark, top, max_bytes=4500).collect(), top)
    assert set(got) == set(made)
    for name, data in made.items():
        r = got[name]
        assert (r["name"], r["size"]) == (os.path.basename(name), len(data))
        assert r.content_hash == (None if not 0 < len(data) <= 4500 else hashlib.sha256(data).hexdigest())
        assert r.status == ("too large" if len(data) > 4500 else "ok" if data else "empty")
    assert got["b.txt"].content_hash == got["sub/deep/same.txt"].content_hash


def test_files_that_go_away(spark, folder):
    """A file that is deleted after it was listed is a row of its own, and the others are read."""
    top, made = folder
    rows = scan_files(spark, top)
    os.remove(os.path.join(top, "a.pdf"))
    got = by_name(rows.collect(), top)
    assert got["a.pdf"].status == "unreadable" and got["a.pdf"].content_hash is None and got["none.txt"].status == "empty"
    assert sum(r.status == "ok" for r in got.values()) == len(made) - 2


def test_names_by_pattern(spark, folder):
    top, _ = folder
    assert sorted(r["name"] for r in scan_files(spark, top, glob="*.txt").collect()) == ["b.txt", "none.txt", "same.txt"]


def test_contents_are_read_only_where_needed(spark, folder):
    """A listing's scan has no content column; a size limit reaches the source, so that large files aren't opened."""
    top, _ = folder
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    listed = plan(list_files(spark, top))
    assert "content" not in listed.split("ReadSchema")[1]
    assert "LessThanOrEqual(length,100)" in plan(read_files(spark, top, 100))


def test_empty_folder(spark, tmp_path):
    assert scan_files(spark, str(tmp_path)).collect() == []

"""Files with names of their own."""

import json
import os

import pytest
from pyspark.sql import functions as F

from shale.sources import files


def test_named_files(spark, tmp_path):
    at = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"d{i % 3}/f{i}.txt", f"text {i}") for i in range(20)], "file string, content string").repartition(4)
    files.write_named(rows, at)
    assert {(r.file, bytes(r.content).decode()) for r in files.read_named(spark, at).collect()} == {(f"d{i % 3}/f{i}.txt", f"text {i}") for i in range(20)}
    files.write_named(spark.createDataFrame([("d0/f0.txt", "new"), ("e/x", "y"), ("empty", None)], "file string, content string"), at)
    assert (tmp_path / "out/d0/f0.txt").read_text() == "new" and (tmp_path / "out/empty").read_bytes() == b""
    files.write_named(spark.createDataFrame([("only", "z")], "file string, content string"), at, overwrite=True)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["only"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    at = str(tmp_path / "out")
    files.write_named(spark.createDataFrame([("kept", "k")], "file string, content string"), at)
    for bad in ([("a", "x"), ("../out", "y")], [("a", "x"), ("a", "y")]):
        with pytest.raises(Exception, match="not a name|same file name"):
            files.write_named(spark.createDataFrame(bad, "file string, content string").repartition(2), at)
        assert [n for d, _, names in os.walk(at) for n in names] == ["kept"]


def test_chunks_and_captures(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i}", "A/b" if i % 4 else "c") for i in range(11)], "id int, name string, category string")
    files.write_chunks(rows, str(tmp_path), "site", F.lit("20260501"), F.col("category"), ["id"], 3)
    found = {p.name: json.loads(p.read_text()) for p in (tmp_path / "site/chunks").iterdir()}
    assert sorted(found) == ["20260501_A_b-0.json", "20260501_A_b-1.json", "20260501_A_b-2.json", "20260501_c-0.json"]
    assert [r["id"] for r in found["20260501_A_b-0.json"]] == [1, 2, 3] and sum(map(len, found.values())) == 11
    request = spark.createDataFrame([("s1", "post", "http://h/", ["Cookie: a"], '{"k": 1}', 404, "application/json", {"X": "y"}, "body", "note")], "slug string, method string, url string, headers array<string>, request_body string, status int, content_type string, response_headers map<string,string>, body string, notes string")
    files.write_named(files.capture_files(request), str(tmp_path / "cap"))
    at = tmp_path / "cap/s1"
    assert sorted(p.name for p in at.iterdir()) == ["metadata.json", "request.curl", "request_body.json", "response_body.json", "response_headers.txt"]
    assert json.loads((at / "metadata.json").read_text()) == {"slug": "s1", "method": "POST", "request_url": "http://h/", "status": 404, "content_type": "application/json", "body_length": 4, "response_body_file": "response_body.json", "notes": "note", "sensitive_values_stored": False}
    assert (at / "response_headers.txt").read_text() == "HTTP status: 404\nX: y\n" and (at / "request.curl").read_text().startswith("curl -L \\\n  -X POST")


def test_folders_are_moved_whole(spark, tmp_path):
    """The commit touches a folder that one task has written once, whatever its files; nothing lists them to read them back."""
    staged = tmp_path / "out/_writing/job"
    for task in ("a", "b"):
        for folder in ("both", f"only-{task}", "there"):
            (staged / task / folder / "sub").mkdir(parents=True)
            for i in range(5):
                (staged / task / folder / "sub" / f"{task}{i}").write_text(f"{task} {folder} {i}")
        (staged / task / f"{task}.txt").write_text(task)
    (tmp_path / "out/there/sub").mkdir(parents=True)
    (tmp_path / "out/there/sub/a0").write_text("old")
    (tmp_path / "out/there/sub/kept").write_text("kept")
    moved = []
    opened = files._opened

    class Counted:
        def __init__(self, system):
            self.system = system

        def move(self, a, b):
            moved.append(os.path.relpath(b, tmp_path / "out"))
            self.system.move(a, b)

        def __getattr__(self, name):
            return getattr(self.system, name)

    writer = files.Writer(str(tmp_path / "out"), False)
    writer.job = "_writing/job"
    files._opened = lambda path: (Counted(opened(path)[0]), opened(path)[1])
    try:
        writer.commit([files.Written(f"_writing/job/{t}", sorted(["both", f"only-{t}", "there", f"{t}.txt"])) for t in ("a", "b")] + [files.Written()])
    finally:
        files._opened = opened
    assert sorted(x for x in moved if "/" not in x) == ["a.txt", "b.txt", "only-a", "only-b"] and len(moved) == 4 + 20
    want = {f"{f}/sub/{t}{i}": f"{t} {f} {i}" for t in ("a", "b") for f in ("both", f"only-{t}", "there") for i in range(5)} | {"a.txt": "a", "b.txt": "b", "there/sub/kept": "kept"}
    rows = lambda frame: {r.file: bytes(r.content).decode() for r in frame.collect()}
    assert rows(files.read_named(spark, str(tmp_path / "out"))) == want
    names = spark.createDataFrame([(n,) for n in want], "file string").repartition(3)
    listed = files.read_listed(names, str(tmp_path / "out"))
    assert rows(files.read_named(spark, f"//{tmp_path}/out/")) == want  # as a file URI without its scheme
    assert rows(listed) == want and "BinaryFile" not in listed._jdf.queryExecution().toString()

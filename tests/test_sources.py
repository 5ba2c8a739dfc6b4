import json

import pytest

from quillstone.sources import files, jsonl
from tests.conftest import rows


def write(path, data):
    path.write_bytes(data.encode())
    return str(path)


def test_strict_fails_on_a_broken_line(spark, tmp_path):
    good = write(tmp_path / "a.jsonl", '{"a": 1}\n{"a": 2}\n')
    assert jsonl.strict(spark, good, "a int").count() == 2
    bad = write(tmp_path / "b.jsonl", '{"a": 1}\n{"a": "x"}\n')
    with pytest.raises(Exception):
        jsonl.strict(spark, bad, "a int").collect()


def test_file_problems(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '﻿{"a": 1}\n\n{"a": 2}')
    assert {r.problem for r in jsonl.file_problems(spark, path).collect()} == {"byte-order mark", "no final line end", "blank line"}


def test_lenient_counts_lines(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"a": 1}\n\n[1]\n{"a": 2}\n{"a":\n')
    good, bad = jsonl.lenient(spark, path, "a int")
    assert [(r.line, r.a) for r in good.orderBy("line").collect()] == [(1, 1), (4, 2)]
    assert [r.line for r in bad.orderBy("line").collect()] == [3, 5]


def test_uploads_and_pages(spark, tmp_path):
    write(tmp_path / "a.txt", "intro\n--- PAGE 1 ---\none\n--- PAGE 2 ---\n\n--- PAGE 3 ---\nthree\n")
    write(tmp_path / "b.bin", "x")
    (tmp_path / "c.txt").write_bytes(b"broken \xff\xfe text")
    got = files.uploads(spark, str(tmp_path))
    assert [(r.path[-5:], r.text, r.problem) for r in got.where("problem is not null").collect()] == [("c.txt", None, "not UTF-8")]
    got = got.where("problem is null")
    assert {r.kind for r in got.collect()} == {"text", "other"}
    text = got.where("kind = 'text'")
    assert [(r.page, r.text) for r in files.pages(text, "path", "text").orderBy("page").collect()] == [(0, "intro"), (1, "one"), (3, "three")]


def test_publish(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    path = str(tmp_path / "out")
    with pytest.raises(ValueError):
        files.publish(df, path, check=df)
    files.publish(df, path, check=df.where("k > 9"))
    assert rows(spark.read.parquet(path)) == rows(df)
    with pytest.raises(FileExistsError):
        files.publish(df, path)
    assert files.publish_identical(df, path) is False
    with pytest.raises(ValueError):
        files.publish_identical(df.limit(1), path)
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_write_lines(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, a string")
    files.write_lines(df, str(tmp_path / "x"), ["k"])
    found = [json.loads(x) for p in sorted((tmp_path / "x").glob("part-*")) for x in p.read_text().splitlines()]
    assert found == [{"a": "a", "k": 1}, {"a": "b", "k": 2}]
